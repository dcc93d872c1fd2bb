"""Programs that loop: PageRank and k-means, as DataFrame rounds with a cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and reread, so that plans stay short and lost executors cost one round."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(id, rank) from edges (src, dst); dangling rank is spread evenly.  Two equi joins a round, no hub is gathered."""
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    out = e.groupBy("src").agg(F.count("*").alias("d"))
    links = cut(e.join(out, "src"))
    nodes = cut(nodes.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        sent = links.join(ranks, links.src == ranks.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        held = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        ranks = nodes.join(sent, "id", "left").crossJoin(F.broadcast(held)).select("id", "dangling", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("rank"))
        if k % cut_every == cut_every - 1:
            ranks = cut(ranks)
    return ranks.select("id", "rank")


def kmeans(points: DataFrame, centers: list[tuple[float, float]], rounds: int = 10) -> DataFrame:
    """(cluster, x, y, n) after `rounds` of Lloyd's algorithm over points (x, y); only the k centers reach the driver."""
    for _ in range(rounds):
        moved = assign_clusters(points, centers).groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()
        new = list(centers)
        for r in moved:
            new[r["cluster"]] = (r["x"], r["y"])
        if new == centers:
            break
        centers = new
    sizes = assign_clusters(points, centers).groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return sizes


def assign_clusters(points: DataFrame, centers: list[tuple[float, float]]) -> DataFrame:
    near = F.array(*(F.struct(((F.col("x") - F.lit(float(a))) ** 2 + (F.col("y") - F.lit(float(b))) ** 2).alias("d"), F.lit(k).alias("cluster")) for k, (a, b) in enumerate(centers)))
    return points.withColumn("cluster", F.array_min(near)["cluster"])

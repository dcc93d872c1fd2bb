"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing is collected but two counters a round, observed by the job that writes the round to the shared
folder.  A hub's neighbours are never gathered into one row or one task: a step joins edges with an
aggregated minimum, and both go by node and salt.  A round's table is deleted when the next one stands.

Defined results: null ends and loops are ignored; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize_counted

#: Tasks that a hub's edges are dealt to.
SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """Directed edges (u, v) and m, the least of u and all its v."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = dealt.groupBy("u", "salt").agg(F.min("v").alias("part"))
    least = parts.groupBy("u").agg(F.least(F.col("u"), F.min("part")).alias("m"), F.collect_list("salt").alias("salts"))  # SALTS at most
    return dealt.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).drop("salt")


def _both(rows: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two edges (u, v) of each row, in one pass."""
    edge = lambda c: F.struct(F.col(c[0]).alias("u"), F.col(c[1]).alias("v"))
    return rows.select(F.explode(F.array(edge(first), edge(second))).alias("e")).select("e.*")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    for _ in range(most_rounds):
        both = _both(e, ("u", "v"), ("v", "u"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large)
        nxt = _both(small, ("v", "m"), ("u", "m")).where("u <> v").distinct()
        # the sum is a hash of the edge set; equal twice means that the stars stand
        last = e
        e, state = materialize_counted(nxt, "cc", F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash"))
        if before is not None:
            drop_table(last)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

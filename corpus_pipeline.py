"""A corpus pipeline: toxicity, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns to the
shared folder, rereads it as the next stage's docs and deletes what the stage left there besides.  All
stages but the last return the columns of docs, whatever further ones there are and however they are called.

Defined results: null and empty texts aren't toxic, aren't near copies of anything and stay; rows that repeat a
doc_id, or have none, are rows of their own (of near copies the first row stays); an empty table gives an
empty result of the same columns; very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import near_dedup, packing, pii, toxicity
from brindle.llm.common import documents, drop_table, fresh, materialize, scratch, tokenizer_path

#: Documents with this score or more go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below TOXIC; the model learns from labels outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id"), 4, 2))
    name = fresh(docs, "toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    copies = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1")
    key = "doc_id"
    if not copies.isEmpty():  # ids don't name rows here: number the rows, and store the numbers before they are used
        key = fresh(docs, "row")
        # in order of doc_id, so that of near copies the one with the least stays
        docs = materialize(docs.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last()).withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = near_dedup.near_components(docs, width=5, percent=80, id_col=key)
    stay = found.where("kept").select(F.col("doc_id").alias(key))
    return docs.join(stay, key, "left_semi").select(*[c for c in docs.columns if key == "doc_id" or c != key])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into sequences; see brindle.llm.packing."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("personal_data", redact_personal_data), ("packing", pack)]

#: No SQL: stages learn a model, hash and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
        drop_table(before)  # a stage's table; the input isn't one
    return docs

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and word pairs with a gap.  The model is
learnt online with per-coordinate rates; the L1 term leaves few weights other than zero, so the model is a
short list (at most 2**BITS pairs, whatever the corpus) that is broadcast to score every text in one narrow
pass.  Learning takes a bounded sample of labelled rows (MOST_TOXIC, MOST_CLEAN, and MOST_FEATURE_BYTES of their
features; the choice is by a hash of doc_id and each kept row is weighted by what it stands for, the mean
weight being 1, so rates and sparsity don't depend on the number of labels); the sample's ids are
broadcast, texts aren't shuffled.

Defined results: null or empty text has no features and gets the model's base rate; null doc_id is scored
and never learnt from; a document labelled more than once is toxic if any label says so; documents that
repeat a doc_id are each learnt from; without labelled rows of both kinds every score is the share of toxic
ones (0 without labels); an empty table gives no rows; very long texts are treated whole; further columns
are kept, and one that has the score's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, documents, drop_table, lean, materialize_counted, slices, texts_of

BITS = 22
MOST_TOXIC, MOST_CLEAN, MOST_FEATURE_BYTES = 8_000, 10_000, 256 << 20
#: Characters that don't belong to a word at its ends.
EDGES = ".,;:!?\"'()[]{}|*#&%$…«»“”"
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1e-6
    epochs: int = 2


class Hasher:
    """Text -> feature numbers; word hashes are remembered up to a bound."""

    def __init__(self):
        self.known = WordCache(lambda chunk: xxhash.xxh3_64_intdigest((chunk.lower().strip(EDGES) or chunk).encode()))

    def features(self, text: str) -> np.ndarray:
        """Feature numbers, with repeats."""
        h = self.known(text.split())
        near, gap = (h[:-1] * MIX_A) ^ (h[1:] * MIX_B), (h[:-2] * MIX_C) ^ (h[2:] * MIX_B)
        return (np.concatenate((h * MIX_A, near * MIX_C, gap * MIX_A)) >> np.uint64(64 - BITS)).astype(np.uint32)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Learner:
    """FTRL-proximal; coordinate 2**BITS is the bias (no L1)."""

    def __init__(self, p: Ftrl):
        self.p, self.z, self.n = p, np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n, p = self.z[at], self.n[at], self.p
        l1 = np.where(at == 2**BITS, 0.0, p.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    def learn(self, at: np.ndarray, toxic: int, weight: float) -> None:
        at = np.append(at, np.uint32(2**BITS))
        w = self.weights(at)
        g = (sigmoid(w.sum()) - toxic) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z[:-1]) > self.p.l1).astype(np.uint32)
        return at, self.weights(at).astype(np.float32), float(self.weights(np.array([2**BITS], np.uint32))[0])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(labels: DataFrame, learn: Column, most_toxic: int, most_clean: int) -> tuple[DataFrame, float]:
    """(doc_id, toxic, weight) of at most about that many labelled rows, weights of mean 1, and the share of toxic ones."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    p1, p0 = min(1.0, most_toxic / n1) if n1 else 0.0, min(1.0, most_clean / n0) if n0 else 0.0
    share = F.when(F.col("toxic") == 1, p1).otherwise(p0)
    kept = rows.where((F.xxhash64("doc_id", F.lit(17)).cast("double") / 2.0**64 + 0.5) < share)
    mean = (n1 + n0) / (n1 * p1 + n0 * p0) if n1 + n0 else 1.0  # rows that a kept one stands for
    weight = F.when(F.col("toxic") == 1, F.lit(1 / p1 / mean if p1 else 0.0)).otherwise(F.lit(1 / p0 / mean if p0 else 0.0))
    return kept.select("doc_id", "toxic", weight.alias("weight")), (n1 / (n1 + n0) if n1 + n0 else 0.0)


def train(docs: DataFrame, labels: DataFrame, learn: Column, params: Ftrl = Ftrl(), most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_FEATURE_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias).  The sample's features meet in one task: its size is bounded, not the corpus's."""
    chosen, share = sample(labels, learn, most_toxic, most_clean)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "weight", "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([np.unique(h.features(t)).tobytes() for t in texts_of(b)], pa.binary())], names=["doc_id", "toxic", "weight", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["doc_id"], r["toxic"], r["weight"], np.frombuffer(r["features"], np.uint32)) for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[1], len(r[3])))
        learner = Learner(params)
        for _ in range(params.epochs):
            for _, toxic, weight, at in rows:
                learner.learn(at, toxic, weight)
        at, w, bias = learner.model()
        if len({r[1] for r in rows}) < 2:
            at, w, bias = at[:0], w[:0], float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["at", "w", "bias"])

    made = joined.mapInArrow(lean(featurize), "doc_id long, toxic int, weight double, features binary")
    made, seen = materialize_counted(made, "toxicity", F.coalesce(F.sum(F.octet_length("features")), F.lit(0)).alias("bytes"))
    features = made
    if seen["bytes"] > most_bytes:  # long texts: fewer of them, of both kinds alike
        features = made.where(F.xxhash64("doc_id", F.lit(23)).cast("double") / 2.0**64 + 0.5 < most_bytes / seen["bytes"])
    got = features.repartition(1).mapInArrow(lean(fit), "at binary, w binary, bias double").collect()
    drop_table(made)
    if not got:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    return np.frombuffer(got[0]["at"], np.uint32), np.frombuffer(got[0]["w"], np.float32), got[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], column: str = "score") -> DataFrame:
    """All columns of docs and `column` (0 to 1) of the whole text, which replaces one of that name; narrow."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()))
    at, w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, w))  # at most 2**BITS pairs
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        table, h = np.zeros(2**BITS, np.float32), Hasher()
        table[at] = w
        for whole in batches:
            for b in slices(whole, "text"):
                out = []
                for t in texts_of(b):
                    f = h.features(t)
                    f = f[table[f] != 0]
                    out.append(sigmoid(float(table[np.unique(f)].sum(dtype=np.float64)) + bias))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(lean(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

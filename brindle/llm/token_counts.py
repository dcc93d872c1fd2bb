"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string is put through the merges on its own; those that end
as one token are *whole*.  A pre-token that is whole counts 1 without merging; only the rest is merged.
Counts of distinct chunks are kept in a bounded per-worker cache, so there is no shuffle and no state
that grows with the input.

Defined results: null text counts as empty (0 bytes, 0 tokens); null doc_id is carried; repeated rows give
repeated rows; an empty table gives no rows; very long texts are counted whole; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import documents, slices, texts_of, tokenizer_path


class Counter:
    def __init__(self, path: str):
        self.front = bpe.ByteFront(path)
        self.whole, _ = bpe.whole_tokens(self.front)
        self.model = self.front.library.model
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def of_chunk(self, chunk: str) -> int:
        whole, tokenize = self.whole, self.model.tokenize
        return sum(1 if p in whole else len(tokenize(p)) for p in self.front.pieces(chunk))

    def count(self, text: str) -> int:
        n = 0
        for k, segment in enumerate(self.front.segments(text)):
            if k % 2:
                n += 1
            elif segment:
                head, rest = self.front.chunks(segment)
                if (x := self.first.get(head)) is None:
                    x = self.first[head] = self.of_chunk(head)
                later = self.later
                new = {*rest}.difference(later)
                for c in new:
                    later[c] = self.of_chunk(" " + c)
                n += x + sum(map(later.__getitem__, rest))
                bpe.forget_long(later, new)
                bpe.forget_long(self.first, {head})
        for cache in (self.first, self.later):
            if len(cache) > bpe.CACHE_CHUNKS:
                cache.clear()
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_bytes (UTF-8) and n_tokens of every whole text; narrow, no shuffle."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = texts_of(b)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    got = count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > limit)

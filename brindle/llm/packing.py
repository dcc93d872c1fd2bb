"""Sequence packing: shortest-pack-first over the length histogram.

Documents are encoded and cut: whole sequences first, then one remainder.  Only the histogram of piece
lengths (at most `room` rows) reaches the driver, whatever the number of documents.  Lengths are placed
longest first, each onto the pattern with the fewest tokens so far that still has room; patterns carry
counts, so a step places many pieces at once.  Patterns become slots (length, ranks from..to, first sequence, offset), and pieces meet their slot by
their rank among the pieces of their length.  Ranks are counted in salted groups, so a length that a third
of all pieces share is still dealt over many tasks.

Defined results: null text is an empty document (its end id alone); null doc_id is carried; repeated rows
are packed each time (they may exchange places); an empty table gives no pieces; very long texts are cut into
as many pieces as they need; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import documents, lean, materialize, slices, texts_of, tokenizer_path

#: Tokens in a sequence; salt groups for ranks within a length.
ROOM, SALTS = 2048, 256
#: Slots stay few (each step of the packer ends a length or a pattern); beyond this the join isn't broadcast.
MOST_SLOTS = 200_000


def cut_documents(docs: DataFrame, path: str, end_id: int = 1, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text: doc_id, start, length, ids_crc32, doc_tokens, salt; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = bpe.word_encoder(path), struct.pack("<I", end_id)
        for whole in batches:
            for b in slices(whole, "text"):
                out: list[tuple] = []
                for d, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                    ids = e.encode(t) + end
                    n = len(ids) // 4
                    out += [(d, k, min(room, n - k), zlib.crc32(ids[4 * k : 4 * (k + room)]), n) for k in range(0, n, room)]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, list[int]]]:
    """(count, lengths) patterns that hold each length as often as the histogram has it."""
    open_by_left: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    full: list[tuple[int, list[int]]] = []

    def put(count: int, pattern: list[int], left: int) -> None:
        (open_by_left[left] if left else full).append((count, pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if n and not 0 < length <= room:
            raise ValueError(f"a piece of {length} tokens can't be packed into {room}")
        for left in range(room, length - 1, -1):
            while n and open_by_left.get(left):
                count, pattern = open_by_left[left].pop()
                used = min(count, n)
                if count > used:
                    open_by_left[left].append((count - used, pattern))
                put(used, [*pattern, length], left - length)
                n -= used
            if not n:
                break
        if n:
            put(n, [length], room - length)
    return full + [x for left in sorted(open_by_left) for x in open_by_left[left]]


def slots_of(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset): each length's ranks are dealt over the patterns in turn."""
    given: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            out.append((length, given[length], given[length] + count, sequence, offset))
            given[length] += count
            offset += length
        sequence += count
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank, from 0, among the pieces of a length; a length's pieces are counted in SALTS groups."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = salted.withColumn("local", F.row_number().over(inside) - 1)
    return local.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("local")).drop("salt", "base", "local")


def assign(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """Adds sequence_id and offset to pieces (which must be stored: they are read twice)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(shortest_pack_first(histogram, room))
    table = spark.createDataFrame(slots, "length long, low long, high long, first long, offset long")
    if len(slots) <= MOST_SLOTS:
        table = F.broadcast(table)
    r = ranked(pieces)
    met = r.join(table, (r.length == table.length) & (r["rank"] >= table.low) & (r["rank"] < table.high))
    return met.select("doc_id", "start", r.length, "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, room: int = ROOM) -> DataFrame:
    return assign(materialize(cut_documents(docs, path, end_id, room), "pieces"), room)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))

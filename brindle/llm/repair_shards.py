"""Token-id output compressed by Re-Pair grammars, one grammar per shard file row.

Documents are range-partitioned by doc_id, encoded, and gathered into shards of whole documents.  Within a
shard the frequent pairs of neighbouring symbols are replaced by nonterminals again and again; each round
counts all pairs and replaces every pair that is frequent enough, from left to right.  The rounds end when no pair
is frequent enough, or no 16-bit symbol is left.  A pair whose slot of the round's table is taken waits for the
next round; a round takes at least one pair, so none is dropped.  A shard stores its rules, the expansion
length of each rule, the final symbol sequence, the expansion offset of every STRIDE-th symbol and the
documents' offsets: a document is found by a search in the sampled offsets and decoded alone.

File format (little-endian), one blob per shard, in the column `blob` of a Parquet table that also has the
columns part, shard, start (ids before the shard in its part), n_docs, n_ids:
    magic "BRDLRP2\\0", u32 first nonterminal, u32 rules, u32 symbols, u32 documents, u64 ids
    u8  symbol width (2 or 4)
    rules   (left, right) pairs of that width
    u32     expansion length of each rule
    symbols of that width
    u64     ids before every STRIDE-th symbol
    i64     doc ids,  u8 null flags,  u64 ids before each document, and all (ends with the number of ids)

Defined results: null text is an empty document (its end id alone); null doc_id sorts first; repeated rows
are written again; ties of doc_id follow the text; an empty table gives no shards and no rows; very long
texts make a shard of their own; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import documents, new_path, slices, texts_of, tokenizer_path

MAGIC = b"BRDLRP2\0"
HEAD = struct.Struct("<8sIIIIQB")
#: ids that a shard gathers before it is written; least count and most new rules a round of a grammar; symbols between sampled offsets.
SHARD_IDS, LEAST, RULES_A_ROUND, STRIDE = 1 << 20, 8, 5000, 256

#: Slots of the table that finds chosen pairs, and its multipliers.
SLOT_BITS = 18
FACTOR = {np.dtype(np.uint32): np.uint32(0x9E3779B1), np.dtype(np.uint64): np.uint64(0x9E3779B97F4A7C15)}


def runs_to_take(at: np.ndarray) -> np.ndarray:
    """Places to replace: of ascending places that overlap (neighbours), every other one from the left."""
    if not len(at):
        return at
    begins = np.ones(len(at), bool)
    begins[1:] = np.diff(at) != 1
    start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - start) % 2 == 0]


def compress(ids: np.ndarray, first: int, least: int = LEAST, most: int = RULES_A_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k stands for the pair rules[k], written as symbol first + k.  Rounds go on until no pair is frequent.

    A round that took all frequent pairs leaves none but those with one of its own symbols, so the next one looks at these alone.
    """
    seq, rules, n_rules, newest = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], 0, 0
    narrow = first <= 0xFFFF
    kind, shift = (np.dtype(np.uint32), np.uint32(16)) if narrow else (np.dtype(np.uint64), np.uint64(32))
    room = 0x10000 - first if narrow else 1 << 22
    while True:
        most = min(most, room - n_rules)
        if len(seq) < 2 or most <= 0:
            break
        if newest:
            new = np.flatnonzero(seq >= newest)
            where = np.unique(np.concatenate((new[new > 0] - 1, new[new < len(seq) - 1])))
            keys = (seq[where].astype(kind) << shift) | seq[where + 1]
        else:
            where, keys = None, (seq[:-1].astype(kind) << shift) | seq[1:]
        ordered = np.sort(keys)
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(edges, append=len(ordered))
        often = counts >= least
        chosen, counts = ordered[edges[often]], counts[often]
        if not len(chosen):
            break
        whole = len(chosen) <= most
        if not whole:
            keep = np.argsort(-counts, kind="stable")[:most]
            chosen = np.sort(chosen[keep])
        # a table of one key a slot finds the chosen pairs; a key whose slot is taken waits for the next round
        slot_of = lambda k: ((k * FACTOR[k.dtype]) >> k.dtype.type(8 * k.itemsize - SLOT_BITS)).astype(np.int32)
        slots = slot_of(chosen)
        _, once = np.unique(slots, return_index=True)
        whole &= len(once) == len(chosen)
        chosen, slots = chosen[np.sort(once)], slots[np.sort(once)]
        table, number = np.zeros(1 << SLOT_BITS, keys.dtype), np.zeros(1 << SLOT_BITS, np.uint32)
        table[slots], number[slots] = chosen, np.arange(len(chosen), dtype=np.uint32)
        own = slot_of(keys)
        hits = table[own] == keys
        if chosen[0]:  # an empty slot holds 0, which is also the pair (0, 0)
            hits &= keys != 0
        left, right = (chosen >> shift).astype(np.uint32), (chosen & ((kind.type(1) << shift) - kind.type(1))).astype(np.uint32)
        found = np.flatnonzero(hits)
        taken = runs_to_take(found if where is None else where[found])
        of = own[taken] if where is None else own[np.searchsorted(where, taken)]
        seq[taken] = number[of] + np.uint32(first + n_rules)
        keep = np.ones(len(seq), bool)
        keep[taken + 1] = False
        seq = seq[keep]
        rules.append(np.stack([left, right], 1))
        newest = first + n_rules if whole else 0
        n_rules += len(chosen)
    return seq, np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids under each rule; a rule refers to earlier rounds' rules only."""
    out = np.zeros(len(rules), np.uint32)
    todo = np.ones(len(rules), bool)
    while todo.any():
        l, r = rules[:, 0].astype(np.int64) - first, rules[:, 1].astype(np.int64) - first
        ll = np.where(l < 0, 1, out[np.maximum(l, 0)])
        rr = np.where(r < 0, 1, out[np.maximum(r, 0)])
        ready = todo & (ll > 0) & (rr > 0)
        out[ready] = (ll + rr)[ready]
        todo &= ~ready
    return out


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for; one level of all rules at a time."""
    seq = seq.astype(np.uint32)
    while True:
        rule = seq >= first
        if not rule.any():
            return seq
        at = np.arange(len(seq)) + np.concatenate(([0], np.cumsum(rule)[:-1]))
        out = np.empty(len(seq) + int(rule.sum()), np.uint32)
        out[at] = seq
        pair = rules[seq[rule] - first]
        out[at[rule]] = pair[:, 0]
        out[at[rule] + 1] = pair[:, 1]
        seq = out


def symbol_lengths(seq: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """Ids under each symbol."""
    sizes = np.ones(len(seq), np.int64)
    rule = seq >= first
    sizes[rule] = lengths[seq[rule] - first]
    return sizes


def pack(doc_ids: list[int | None], encoded: list[bytes], first: int) -> tuple[bytes, int]:
    ids = np.frombuffer(b"".join(encoded), dtype="<u4")
    seq, rules = compress(ids, first)
    lengths = expansion_lengths(rules, first)
    ends = np.cumsum(symbol_lengths(seq, lengths, first))
    offsets = np.concatenate(([0], ends))[: len(seq) : STRIDE] if len(seq) else np.zeros(0, np.int64)
    kind = "<u2" if first + len(rules) <= 0x10000 else "<u4"
    return b"".join((
        HEAD.pack(MAGIC, first, len(rules), len(seq), len(encoded), len(ids), int(kind[2])), rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), seq.astype(kind).tobytes(), offsets.astype("<u8").tobytes(),
        np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype("<u8").tobytes(),
    )), len(ids)


class Shard:
    """A blob opened for reading; columns are views of it.  The rules are expanded once, documents when asked for."""

    def __init__(self, blob: bytes):
        magic, self.first, n_rules, n_seq, n_docs, self.n_ids, width = HEAD.unpack_from(blob)
        if magic != MAGIC or width not in (2, 4):
            raise ValueError("not a shard")
        at, out = HEAD.size, []
        for kind, n in ((f"<u{width}", 2 * n_rules), ("<u4", n_rules), (f"<u{width}", n_seq), ("<u8", -(-n_seq // STRIDE)), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs + 1)):
            out.append(np.frombuffer(blob, kind, n, at))
            at += out[-1].nbytes
        rules, self.lengths, self.seq, self.offsets, docs, nulls, self.starts = out
        self.rules, self.starts = rules.reshape(-1, 2), self.starts.astype(np.int64)
        self.sizes = np.diff(self.starts)
        self.doc_ids = [None if z else int(d) for d, z in zip(docs, nulls, strict=True)]
        self.flat = expand(np.arange(self.first, self.first + n_rules), self.rules, self.first)  # the rules' ids, one after another
        self.places = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def ids(self, a: int, b: int) -> np.ndarray:
        """ids from place a to b: a search in the sampled offsets, then the symbols between two samples."""
        low = max(0, int(np.searchsorted(self.offsets, a, "right")) - 1)
        high = int(np.searchsorted(self.offsets, b, "left"))
        base, seq = int(self.offsets[low]) if len(self.offsets) else 0, self.seq[low * STRIDE : high * STRIDE]
        sizes = symbol_lengths(seq, self.lengths, self.first)
        ends = base + np.cumsum(sizes)
        x, y = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1
        start, seq, sizes = int(ends[x - 1]) if x else base, seq[x:y], sizes[x:y]
        out = np.repeat(seq.astype(np.uint32), sizes)
        long = np.flatnonzero(out >= self.first)
        rule = out[long].astype(np.int64) - self.first
        begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[long] = self.flat[self.places[rule] + long - begins[long]]
        return out[a - start : b - start]

    def document(self, k: int) -> np.ndarray:
        """ids of the k-th document alone."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> int:
    """Encode every whole text and write shards in ascending doc_id order; returns the number of parts.

    One range shuffle of (doc_id, text); a part is encoded and compressed as it streams by.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.byte_encoder(path)
        first = max(e.front.library.get_vocab_size(), end_id + 1)
        end, part, shard, start = struct.pack("<I", end_id), TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        encoded: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, start, held
            blob, n = pack(names, encoded, first)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "start": pa.array([start], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([n], pa.int64()), "blob": pa.array([blob], pa.binary())})
            shard, start, held = shard + 1, start + n, 0
            names.clear()
            encoded.clear()
            return row

        for whole in batches:
            for b in slices(whole, "text"):
                for d, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                    names.append(d)
                    encoded.append(e.encode(t) + end)
                    held += len(encoded[-1]) // 4
                    if held >= SHARD_IDS:
                        yield flush()
        if names:
            yield flush()

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(run, "part int, shard int, start long, n_docs long, n_ids long, blob binary").write.parquet(out)
    return parts


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each decoded by random access in the shard files.

    Only per-part totals (at most one row per part of the range shuffle) reach the driver.
    """
    table = spark.read.schema("part int, shard int, start long, n_docs long, n_ids long, blob binary").parquet(out)
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, base = {}, 0
    for part, n in totals:
        before[part], base = base, base + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row["blob"])
                at = before[row["part"]] + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1] + at), pa.array(s.sizes), pa.array([zlib.crc32(s.document(k).astype("<u4")) for k in range(len(s.doc_ids))], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "start", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "shards")
    write_shards(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), out)
    return read_shards(spark, out)

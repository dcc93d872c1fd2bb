"""Document fingerprints: Order MinHash.

Each k-mer of a text is numbered by its occurrence, so repeats count.  For each of SKETCHES hash functions
the TUPLE smallest numbered k-mers are selected, put back into text order, and hashed as a tuple: equal
tuples need the same k-mers in the same order, so likeness follows edit distance rather than mere content.

Edited texts need each document's successor by doc_id.  Bounds taken from the data (approximate quantiles;
one value a part) deal documents into parts; the first document of a part is also sent to the part
before (and the very first to the last), so each part is worked through in order by itself.  There is one
shuffle, of compressed texts.

Defined results: null text is empty; an empty text's fingerprint is the hash of nothing and is like other
empty texts only; a text shorter than K is one k-mer; null doc_id comes first; ties of doc_id are in a fixed
order of their texts; a single document follows itself; repeated rows follow each other; an empty table gives
no rows; very long texts are fingerprinted whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts_of

K, TUPLE, SKETCHES = 8, 2, 32
#: Elements of the hash matrix held at once; expected survivors a sketch before the exact selection.
CELLS, SURVIVORS = 120_000, 24

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
STEP = [np.uint64(x | 1) for x in _rng.integers(2**62, 2**63, 8)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def kmers(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of all k-mers of code points, in text order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(c) <= k:
        h = len(c)
        for x in c.tolist():
            h = (h * int(STEP[0]) ^ x) & (2**64 - 1)
        return mix(np.array([h], np.uint64)) if len(c) else np.zeros(0, np.uint64)
    out, done, power, part = None, 0, 1, c
    while power <= k:
        if k & power:
            n = len(c) - k + 1
            piece = part[done : done + n]
            out = piece if out is None else out * STEP[3] + piece
            done += power
        if power * 2 <= k:
            part = part[:-power] * STEP[power.bit_length() % 8] + part[power:]
        power *= 2
    return mix(out)


def numbered(h: np.ndarray) -> np.ndarray:
    """k-mer hashes with the number of the occurrence mixed in (the first occurrence stays)."""
    order = np.argsort(h)
    s = h[order]
    again = s[1:] == s[:-1]
    if not again.any():
        return h
    member = np.concatenate((again, [False])) | np.concatenate(([False], again))
    at, value = order[member], s[member]
    by = np.lexsort((at, value))
    at, value = at[by], value[by]
    first = np.concatenate(([True], value[1:] != value[:-1]))
    index = np.arange(len(at))
    number = index - np.maximum.accumulate(np.where(first, index, 0))
    out = h.copy()
    later = number > 0
    out[at[later]] = mix(h[at[later]] + number[later].astype(np.uint64) * STEP[5])
    return out


def fingerprint(text: str) -> np.ndarray:
    """SKETCHES tuple hashes (uint32)."""
    x = numbered(kmers(text)) if text else np.zeros(0, np.uint64)
    n, want = len(x), min(TUPLE, len(x))
    if not n:
        return np.zeros(SKETCHES, np.uint32)
    out = np.empty(SKETCHES, np.uint64)
    limit = np.uint64(min(1.0, SURVIVORS * want / 2 / n) * (2**64 - 2**12))
    step = min(SKETCHES, max(1, CELLS // n))
    room = np.empty((step, n), np.uint64)
    for a in range(0, SKETCHES, step):
        b = min(a + step, SKETCHES)
        values = np.multiply(x, FACTORS[a:b, None], out=room[: b - a])
        hit = np.flatnonzero(values <= limit)
        row = hit // n
        count = np.bincount(row, minlength=b - a)
        if count.min() < want:
            picked = np.argsort(values, axis=1, kind="stable")[:, :want]
        else:
            v, begin = values.ravel()[hit], np.concatenate(([0], np.cumsum(count)[:-1]))
            picked = np.empty((b - a, want), np.int64)
            for j in range(want):
                at = np.flatnonzero(v == np.minimum.reduceat(v, begin)[row])
                at = at[np.concatenate(([True], np.diff(row[at]) > 0))]
                picked[:, j] = hit[at] - row[at] * n
                v[at] = np.uint64(2**64 - 1)
        picked.sort(axis=1)
        h = np.full(b - a, 0x51ED270B, np.uint64)
        for j in range(want):
            h = mix(h * STEP[6] + x[picked[:, j]])
        out[a:b] = h
    got = (out >> np.uint64(32)).astype(np.uint32)
    return np.where(got == 0, np.uint32(1), got)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """(part, tail, key, doc_id, text compressed): one part's documents in order, then (tail = 1) the next part's first."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    at = [k / parts for k in range(1, parts)] or [0.5]
    low, cuts = keyed.agg(F.min(key), F.percentile_approx(key, at, 10 * parts)).first()
    bounds = np.array(sorted({c for c in (cuts or []) if c > low}) if parts > 1 else [], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for b in slices(whole, "text"):
                key = np.asarray(b.column(0).fill_null(-(2**63)), np.int64)
                part = np.searchsorted(bounds, key, side="right")
                blobs = [squeeze(t.encode("utf-8", "surrogatepass")) for t in texts_of(b)]
                first = np.isin(key, bounds) | (key == low)
                more = np.flatnonzero(first)
                before = np.where(key[more] == low, len(bounds), part[more] - 1)
                take = np.concatenate((np.arange(len(key)), more))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((part, before)).astype(np.int32)), pa.array((np.arange(len(take)) >= len(key)).astype(np.int32)), pa.array(key[take]), b.column(0).take(pa.array(take)), pa.array([blobs[k] for k in take], pa.binary())], names=["part", "tail", "key", "doc_id", "blob"])

    return keyed.mapInArrow(deal, "part int, tail int, key long, doc_id long, blob binary")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness; see the module's head."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        held: tuple | None = None  # (part, doc_id, text, fingerprint) waiting for its successor
        out: list[tuple] = []
        for b in batches:
            for part, tail, doc_id, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if tail and (held is None or held[0] != part):
                    continue
                text = grow(blob).decode("utf-8", "surrogatepass")
                own = fingerprint(text)
                if held is not None and held[0] == part:
                    _, name, before, print_before = held
                    changed = edited(before, text)
                    print_changed = fingerprint(changed)
                    out.append((name, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), print_before.tobytes().hex(), print_changed.tobytes().hex(), likeness(print_before, print_changed), likeness(print_before, own)))
                held = None if tail else (part, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=SCHEMA.replace(",", "").split()[::2])
                out = []

    ordered = dealt(docs, parts or 4 * n).repartition(n, "part").sortWithinPartitions("part", "tail", "key", "blob")
    return ordered.mapInArrow(run, SCHEMA)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))

"""MinHash near-dedup by fast similarity sketching.

A document's set is its distinct word shingles (64-bit hashes).  Sketch: in each round every element is
hashed to one of COORDINATES places and the least value stays; the rounds after the COORDINATES-th place all
elements at one given coordinate, so each coordinate fills; an earlier round always wins, so the work stops
as soon as nothing is empty (about n + t ln t values in all).  BANDS bands of ROWS coordinates give
candidates, which are confirmed on full sets.

Hot keys: a bucket's members and a leader's pairs are dealt over several tasks; the components' hubs likewise.

Copies (equal sets) become one class first.  Classes that share a band bucket are compared with one leader
of the bucket, not with each other; a bucket whose members are then in one component is done.  In the
others a second leader is taken.  What then still shares a bucket across components goes through an exact
prefix filter: with shingles ordered from rare to frequent, two sets that are similar enough share one
among the first few of each, so a line or passage that very many documents have makes no pairs.  No link
between documents that share a bucket is lost.  Components come from star contraction.  No pair list of a group, set or
component is ever collected; sets are built in a second pass only for classes that share a bucket, chosen
by a bitmap of fixed size.

Defined results: null text is empty; an empty set has no links and is its own component; a null doc_id never
names a component unless all its members are null, and is not kept; rows that repeat a doc_id are all kept
or all not; ties of doc_id share the component's name; an empty table gives no rows; very long texts are
treated whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordCache, documents, lean, materialize, materialize_counted, scratch, slices, texts_of
from .components import connected_components

#: 42 bands of 6: a pair at 0.8 is missed once in 3e5, one at 0.85 once in 4e8.
COORDINATES, BANDS, ROWS = 256, 42, 6
#: Bits of the bitmap that chooses whose sets are built (2 MB); when it is full, more sets are built than needed.
FILTER_BITS = 24
LEADER_ROUNDS = 2
#: Pairs up to this many may be broadcast (16 bytes each) to pick sets.
FEW_PAIRS = 50_000
#: Parts that the members of a bucket, and the pairs of a leader, are dealt to; holders of a shingle that one task takes.
MEMBER_SALTS, PAIR_SALTS, HOLDERS = 8, 64, 2000


def salt(column: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts).cast("long")).alias("salt")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


SEEDS = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Shingler:
    """Text -> sorted distinct 64-bit shingle hashes."""

    def __init__(self, width: int):
        self.width, self.known = width, WordCache(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        h = self.known(words)
        k = min(self.width, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + n])
        return np.unique(out)


def sketch(x: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of a set that isn't empty; round in the high 16 bits, hash below."""
    best = np.full(t, 2**64 - 1, np.uint64)
    n, bits, i = len(x), np.uint64(64 - t.bit_length() + 1), 0
    low = np.uint64(2**48 - 1)
    at_once = max(1, int(1.3 * t * np.log(t) / n))
    while i < t:
        r = min(at_once, t - i)
        h = _mix(x[None, :] ^ SEEDS[i : i + r, None])
        place = (h >> bits).astype(np.intp)
        value = (h & low) | (np.arange(i, i + r, dtype=np.uint64) << np.uint64(48))[:, None]
        np.minimum.at(best, place.ravel(), value.ravel())
        if best.max() != np.uint64(2**64 - 1):
            return best
        i += r
        at_once = max(at_once, 16)
    for b in np.flatnonzero(best == np.uint64(2**64 - 1)):
        best[b] = (_mix(x ^ SEEDS[t + b]) & low).min() | np.uint64((t + int(b)) << 48)
    return best


def bands(s: np.ndarray) -> np.ndarray:
    """One 64-bit key a band (the band's number is part of it)."""
    parts = s[: BANDS * ROWS].reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return h


def digest(x: np.ndarray) -> int:
    """A class: signed 64-bit hash of the whole sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64))


def squeezed(x: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """A sorted set of 64-bit hashes: differences in byte planes, compressed."""
    return press.compress(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueezed(blob: bytes, grow: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(grow.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), node (class, null for an empty set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for whole in batches:
            for b in slices(whole, "text"):
                n, node, keys = [], [], []
                for t in texts_of(b):
                    x = shingles(t)
                    n.append(len(x))
                    node.append(digest(x) if len(x) else None)
                    keys.append(bands(sketch(x)).view(np.int64) if len(x) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, node long, bands array<long>")


def _bitmap(nodes: DataFrame) -> bytes:
    """Bitmap of FILTER_BITS bits over classes; at most 2**(FILTER_BITS-6) rows reach the driver."""
    word = F.shiftrightunsigned("node", 64 - FILTER_BITS + 6)
    bit = F.shiftrightunsigned("node", 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int")
    rows = nodes.select(word.alias("w"), F.expr("shiftleft(1L, 0)").alias("one"), bit.alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("bits")).collect()
    out = np.zeros(2 ** (FILTER_BITS - 6), np.int64)
    for r in rows:
        out[r["w"]] = r["bits"]
    return out.tobytes()


def _sets(docs: DataFrame, width: int, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """node, blob: the set of each wanted class, built from its first document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bitmap(wanted))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shingles, press = np.frombuffer(shared.value, np.uint64), Shingler(width), zstandard.ZstdCompressor(level=1)
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, "text"):
                node, blob = [], []
                for t in texts_of(b):
                    x = shingles(t)
                    if not len(x):
                        continue
                    d = digest(x)
                    u = d & (2**64 - 1)
                    if d in seen or not int(bits[u >> (64 - FILTER_BITS + 6)]) >> ((u >> (64 - FILTER_BITS)) & 63) & 1:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(d)
                    node.append(d)
                    blob.append(squeezed(x, press))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(blob, pa.binary())], names=["node", "blob"])

    built = docs.mapInArrow(lean(run), "node long, blob binary")
    # copies in other partitions: one stays (partial aggregation comes first, so a hot class is not gathered)
    return materialize(built.groupBy("node").agg(F.any_value("blob").alias("blob")), "sets")


def _prefix_pairs(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components whose sets may be similar enough: they share a shingle among their prefixes.

    With s = percent / 100 the prefix of a set of n has n - ceil(s n) + 1 shingles, those in fewest live sets
    first; of the smaller set n - ceil(2 s n / (1 + s)) + 1 are enough.  What can still follow the shared
    shingle must make up the intersection that is needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                x = unsqueezed(batch.column(2)[r].as_py(), grow)
                node, component = (pa.array(np.full(len(x), batch.column(c)[r].as_py())) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([node, component, pa.array(np.full(len(x), len(x))), pa.array(x.astype(np.int64))], names=["node", "component", "n", "shingle"])

    each, _ = materialize_counted(live.join(sets, "node").select("node", "component", "blob").mapInArrow(lean(run), "node long, component long, n long, shingle long"), "shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node").orderBy("often", "shingle")
    ranked = each.join(often, "shingle").withColumn("place", F.row_number().over(order))
    whole = 100 + percent
    probe, index = f"n - (({percent} * n + 99) div 100) + 1", f"n - (({2 * percent} * n + {whole - 1}) div {whole}) + 1"
    ranked = ranked.where((F.col("place") <= F.expr(probe)) & (F.col("often") > 1))
    # a shingle that many hold is dealt over as many tasks: one side by salt, the other copied to each
    salts = F.ceil(F.col("often") / HOLDERS)
    columns = ["shingle", "node", "component", "n", "place"]
    x = ranked.where(F.col("place") <= F.expr(index)).select(*columns, F.pmod(F.xxhash64("node"), salts).alias("salt")).alias("x")
    y = ranked.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")).alias("y")
    need = f"({percent} * (x.n + y.n) + {whole - 1}) div {whole}"
    met = x.join(y, F.expr(f"x.shingle = y.shingle and x.salt = y.salt and x.component <> y.component and (x.n < y.n or (x.n = y.n and x.node < y.node)) and 100 * x.n >= {percent} * y.n and 1 + least(x.n - x.place, y.n - y.place) >= {need}"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """(a, b), and how many, of those pairs whose sets have 100 * intersection >= percent * union."""
    pairs, seen = materialize_counted(pairs, "pairs")
    if not seen["rows"]:
        return pairs, 0
    if seen["rows"] <= FEW_PAIRS:
        names = F.broadcast(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        sets = sets.join(names, "node", "left_semi")
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("blob").alias("blob_b")), "b").select("a", "b", salt("b", PAIR_SALTS), "blob_b")
    # a leader's set goes to as many tasks as its pairs need
    names = pairs.select("a", salt("b", PAIR_SALTS)).distinct().join(sets.select(F.col("node").alias("a"), F.col("blob").alias("blob_a")), "a")
    joined = joined.join(names, ["a", "salt"]).select("a", "b", "blob_a", "blob_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        last: tuple[bytes, np.ndarray] | None = None
        for batch in batches:
            a, b = [], []
            for r in range(batch.num_rows):
                blob = batch.column(2)[r].as_py()
                if last is None or last[0] != blob:
                    last = (blob, unsqueezed(blob, grow))
                x, y = last[1], unsqueezed(batch.column(3)[r].as_py(), grow)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    a.append(batch.column(0)[r].as_py())
                    b.append(batch.column(1)[r].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links, seen = materialize_counted(joined.mapInArrow(lean(run), "a long, b long"), "links")
    return links, seen["rows"]


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    with scratch(docs.sparkSession) as keep:
        rows, classes, merged = _classified(docs, width, percent, id_col, text_col)
        keep += [rows, classes, *([] if merged is None else [merged])]
    component = classes.select("node", F.col("node").alias("component"))  # each class by itself
    if merged is not None:
        component = classes.select("node").join(merged, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    firsts = classes.select("node", "first_id").join(component, "node").withColumn("salt", salt("node", MEMBER_SALTS))
    # a component's name goes to each salt that its members have
    least = firsts.groupBy("component").agg(F.min("first_id").alias("component_id"), F.collect_set("salt").alias("salts"))
    named = firsts.join(least.select("component", "component_id", F.explode("salts").alias("salt")), ["component", "salt"]).select("node", "component_id")
    out = rows.select("doc_id", "n", "node").join(named, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(False)).alias("kept"))


def _classified(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows with their class, classes, and (node, component) of the classes that have links."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    all_rows = materialize(_sketched(kept, width), "sketches")
    classes = materialize(all_rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "classes")
    member = classes.select(F.explode("bands").alias("key"), "node", "n", "first_id", salt("node", MEMBER_SALTS))
    shared = member.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    # only keys that are shared get salts; their members are dealt by key and salt
    places = shared.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MEMBER_SALTS - 1).cast("long"))).alias("salt"))
    buckets = materialize(member.join(places, ["key", "salt"], "left_semi"), "buckets")
    sets = _sets(kept, width, buckets.select("node").distinct(), classes)

    merged: DataFrame | None = None

    def fits(n_a: str, n_b: str):
        return F.expr(f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b})")

    for turn in range(LEADER_ROUNDS + 1):
        m = buckets if merged is None else buckets.join(merged, "node", "left")
        m = m.withColumn("component", F.coalesce(F.col("component"), F.col("node"))) if merged is not None else m.withColumn("component", F.col("node"))
        order = F.struct("first_id", "node", "component", "n") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)).alias("first_id"), "node", "component", "n")
        live = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(order).alias("leader"), F.collect_set("salt").alias("salts")).where("lo < hi")
        # the leader goes to each salt that the bucket has, so the members of one key meet it in several tasks
        m = m.join(live.select("key", "leader", F.explode("salts").alias("salt")), ["key", "salt"])
        if turn < LEADER_ROUNDS:
            m, seen = materialize_counted(m, "live")
            pairs = m.where("node <> leader.node and component <> leader.component").where(fits("n", "leader.n")).select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct()
            buckets = m.where("node <> leader.node").select("key", "node", "n", "first_id", "salt")
        else:
            m, seen = materialize_counted(m.select("node", "component").distinct(), "live")
            pairs = _prefix_pairs(m, sets, percent)
        if not seen["rows"]:
            break
        links, n_links = _confirmed(pairs, sets, percent)
        if not n_links:
            continue
        if merged is None:
            merged = materialize(connected_components(links), "merged")
        else:
            of = merged
            ends = links.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            joined = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("into"))
            places = joined.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MEMBER_SALTS - 1).cast("long"))))
            moved = of.withColumn("salt", salt("node", MEMBER_SALTS)).join(places, ["component", "salt"], "left").select("node", F.coalesce("into", "component").alias("component"))
            fresh = joined.select(F.col("component").alias("node"), F.col("into").alias("component")).join(of.select("node"), "node", "left_anti")
            merged = materialize(moved.unionByName(fresh), "merged")

    return all_rows, classes, merged


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), width=4, percent=80)

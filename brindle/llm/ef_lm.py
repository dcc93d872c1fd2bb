"""Language-model scoring with a sharded Elias-Fano n-gram trie of order 3.

Model: interpolated absolute discounting (one discount an order, DISCOUNTS) over additive unigrams.  Sentences
are whole texts between a begin mark and an end mark.  The trie holds words, pairs and triples that the
training texts have:
    lexicon   word hashes (64 bits, in shards by hash), Elias-Fano coded; a word's number follows its frequency
    level 1   words that begin something; a quantised backoff weight each
    level 2   successors of each: numbers as low parts, the degrees in unary, which are the pointers; a
              quantised discounted probability and a quantised backoff weight each
    level 3   successors of each pair: as level 2, a quantised discounted probability each
Levels 1 to 3 are in key order (numbers of the three words), cut into shards; a shard's levels lie in one
memory map.  A query selects in the unary bits for [pointer, next pointer) and looks for the successor
there, relative to its context; nothing is decoded.

Flow: texts become blocks of words (one narrow pass, written once); a block sends its distinct words with their
counts to the lexicon, whose shards answer with numbers and corpus counts; numbered blocks send each distinct
triple once, with its training count, to the shard of its key; a shard merges counts, builds its levels and
answers each block's entries in order; a block joins the answers and sums logarithms per document.  No
vocabulary and no model is broadcast or collected.

Skew: shards are ranges of the key order, cut at a sample of at most SAMPLE_BLOCKS * SAMPLE_EVENTS triples, so the
successors of a frequent word, or of a frequent pair, lie in as many shards as they need.  A context that is
cut this way has its total and degree put together on the driver from at most four figures a shard; blocks
mend what its shards answered.  The sample decides where shards end and nothing else: scores don't depend
on the number of shards.  Broadcast: 120 bytes a shard (MOST_SHARDS of them at most), 512 bytes a
lexicon shard (MOST_LEXICON_SHARDS).  Tables that later steps no longer need are deleted.

Defined results: null text is empty (its end mark alone); null doc_id counts as a training document;
repeated rows count and are scored each; an empty table gives no rows; without training tokens every
probability falls back to the unseen word's, with N and V zero; very long texts make a block of their own;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, documents, drop_table, materialize, materialize_counted, slices, texts_of
from .elias_fano import EliasFano, mapped

#: Tokens that make a block.  Tokens a shard has on average: small ones spread small corpora over the cores, and from FEW_SHARDS
#: shards on they grow to large ones, as a block sends a row to each (100 bytes a token while one is built); the most shards.
BLOCK_TOKENS, SMALL_SHARD, LARGE_SHARD, FEW_SHARDS, MOST_SHARDS = 1 << 20, 1 << 20, 1 << 23, 1 << 10, 1 << 20
#: Words of blocks that make a lexicon shard on average, and the most of them; classes of frequency (powers of two).
LEXICON_WORDS, MOST_LEXICON_SHARDS, CLASSES = 1 << 20, 1 << 16, 64
#: Blocks that say where shards end, and places that each names.
SAMPLE_BLOCKS, SAMPLE_EVENTS = 1024, 64
#: Entries that a shard looks up at a time.
BATCH = 1 << 17
#: Step of the logarithmic quantiser, additive smoothing of unigrams, discounts of pairs and triples.
STEP, ADD, DISCOUNTS = 0.001, 0.1, (0.8, 0.9)
#: Hash of the end mark, which words never get; numbers of the marks, and the first number of a word.
END = 2**64 - 1
BEGIN_ID, END_ID, FIRST_ID = 0, 1, 2


def hash_word(w: bytes) -> int:
    return min(xxhash.xxh3_64_intdigest(w), END - 1)


# -- packing of integer columns -------------------------------------------------------------------------


def put(*columns: np.ndarray) -> bytes:
    """Integer columns as byte planes, compressed together."""
    head = struct.pack("<I", len(columns)) + b"".join(struct.pack("<4sQ", c.dtype.str.encode().ljust(4), len(c)) for c in columns)
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns if len(c))
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def get(data: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    heads = [struct.unpack_from("<4sQ", data, 4 + 12 * k) for k in range(n)]
    planes, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[4 + 12 * n :]), np.uint8), [], 0
    for kind, size in heads:
        dtype = np.dtype(kind.decode().strip())
        to = at + size * dtype.itemsize
        out.append(np.ascontiguousarray(planes[at:to].reshape(dtype.itemsize, size).T).view(dtype).ravel())
        at = to
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of an ascending column (its first entry stays)."""
    return np.diff(x, prepend=x.dtype.type(0))


# -- the trie --------------------------------------------------------------------------------------------


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities in (0, 1] as 16-bit codes from 1, down to 10^-65; 0 stays for "none"."""
    return (1 + np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 65534)).astype("<u2")


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0.0, 10.0 ** (-(code.astype(np.float64) - 1) * STEP))


def heads_of(key: np.ndarray) -> np.ndarray:
    """Where each run of equal entries begins, and the end."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)


class Trie:
    """One shard, from its entries: three columns of word numbers (below 2**bits), and counts; entries may repeat."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray, bits: int):
        shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        contexts, of = np.unique(u, return_inverse=True)
        pairs, of = np.unique((of.astype(np.uint64) << shift) | v.astype(np.uint64), return_inverse=True)
        key = (of.astype(np.uint64) << shift) | w.astype(np.uint64)
        order = np.argsort(key)
        key, count = key[order], count[order].astype(np.int64)
        runs = heads_of(key)
        key, c3 = key[runs[:-1]], np.add.reduceat(count, runs[:-1]) if len(count) else count
        at2, at1 = heads_of(key >> shift), heads_of(pairs >> shift)
        c2 = np.add.reduceat(c3, at2[:-1]) if len(c3) else c3
        c1 = np.add.reduceat(c2, at1[:-1]) if len(c2) else c2
        d1, d2 = np.diff(at1), np.diff(at2)
        of1, of2 = np.repeat(np.arange(len(c1)), d1), np.repeat(np.arange(len(c2)), d2)
        d_two, d_three = DISCOUNTS
        part = mapped([
            *EliasFano.build(contexts), *EliasFano.build(pairs, bits, len(c1)), *EliasFano.build(key, bits, len(c2)),
            quantise(d_two * d1 / np.maximum(c1, 1)).tobytes(), quantise((c2 - d_two) / np.maximum(c1, 1)[of1]).tobytes(),
            quantise(d_three * d2 / np.maximum(c2, 1)).tobytes(), quantise((c3 - d_three) / np.maximum(c2, 1)[of2]).tobytes(),
        ])
        self.contexts, self.two, self.three = (EliasFano(part[k].tobytes(), *part[k + 1 : k + 4]) for k in (0, 4, 8))
        self.backoff1, self.code2, self.backoff2, self.code3 = (p.view("<u2") for p in part[12:])
        # the first and last contexts, which a neighbouring shard may share
        ends = [(0, 0), (-1, -1)] if len(c1) else []
        self.edges = [[int(contexts[j]), int(c1[j]), int(d1[j]), int(contexts[j]), int(pairs[i] & mask), int(c2[i]), int(d2[i])] for j, i in ends]

    def answer(self, u: np.ndarray, n_v: np.ndarray, v: np.ndarray, n_w: np.ndarray, w: np.ndarray) -> tuple:
        """Word numbers: u, the n_v successors v of each, the n_w successors w of each pair.

        Codes of triples, codes and backoff codes of pairs, backoff codes of words (0: unseen).
        """

        def hit(level: EliasFano, at: np.ndarray, end: np.ndarray | int, want: np.ndarray, read) -> np.ndarray:
            found = at < end
            found[found] = read(level, at[found]) == want[found]
            return np.where(found, at, -1)

        def down(level: EliasFano, context: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> np.ndarray:
            first, last = level.run(np.maximum(context, 0))
            first, last = np.repeat(first, sizes), np.repeat(np.where(context >= 0, last, first), sizes)
            return hit(level, level.within(word, first, last), last, word, EliasFano.lows)

        k1 = hit(self.contexts, self.contexts.successor(u), self.contexts.n, u, EliasFano.at)
        k2 = down(self.two, k1, n_v, v)
        k3 = down(self.three, k2, n_w, w)
        pick = lambda column, k: np.where(k >= 0, column[np.maximum(k, 0)], 0) if len(column) else np.zeros(len(k), column.dtype)
        return pick(self.code3, k3), pick(self.code2, k2), pick(self.backoff2, k2), pick(self.backoff1, k1)


# -- blocks ----------------------------------------------------------------------------------------------


class Block:
    """The distinct triples of a block's texts, in key order.  token: places among the block's words (0 the begin mark, 1 the end mark)."""

    def __init__(self, sizes: np.ndarray, token: np.ndarray, n_words: int):
        self.sizes, self.token, self.bits = sizes, token, np.uint64((n_words + 1).bit_length())
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        before = np.concatenate(([0], token[:-1]))
        before[self.starts] = 0
        after = np.concatenate((token[1:], [0]))
        after[self.starts + sizes - 1] = END_ID
        pair = (before.astype(np.uint64) << self.bits) | token.astype(np.uint64)
        del before
        if 3 * int(self.bits) <= 64:
            key, self.of_event = np.unique((pair << self.bits) | after.astype(np.uint64), return_inverse=True)
            runs = heads_of(key >> self.bits)
            self.pair, self.pair_of = (key >> self.bits)[runs[:-1]], np.repeat(np.arange(len(runs) - 1), np.diff(runs))
            self.key = (self.pair_of.astype(np.uint64) << self.bits) | (key & np.uint64((1 << int(self.bits)) - 1))
        else:
            self.pair, of = np.unique(pair, return_inverse=True)
            self.key, self.of_event = np.unique((of.astype(np.uint64) << self.bits) | after.astype(np.uint64), return_inverse=True)
            self.pair_of = (self.key >> self.bits).astype(np.int64)
        mask = np.uint64((1 << int(self.bits)) - 1)
        self.u, self.v, self.w = (self.pair >> self.bits).astype(np.int64), (self.pair & mask).astype(np.int64), (self.key & mask).astype(np.int64)

    def counts(self, held: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_event[np.repeat(held == 0, self.sizes)], minlength=len(self.key))

    def cuts(self, names: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the triples of each shard begin; names: the words' numbers; ends: first keys of the shards after the first."""
        place = [np.searchsorted(names, ends[:, k]) for k in range(3)]
        same = [names[np.minimum(p, len(names) - 1)] == ends[:, k] for k, p in enumerate(place)]
        pair = (place[0].astype(np.uint64) << self.bits) | np.where(same[0], place[1], 0).astype(np.uint64)
        at = np.searchsorted(self.pair, pair)
        whole = same[0] & same[1] & (at < len(self.pair))
        whole[whole] = self.pair[at[whole]] == pair[whole]
        key = (at.astype(np.uint64) << self.bits) | np.where(whole, place[2], 0).astype(np.uint64)
        return np.concatenate(([0], np.searchsorted(self.key, key), [len(self.key)]))


def _blocks(docs: DataFrame) -> DataFrame:
    """docs: doc_id, held_out, text.  Rows: block, vocab (hashes, training counts), blob (texts' ids, marks, sizes, places in vocab), tokens, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCache(hash_word)
        names: list = []
        held: list = []
        rows: list[np.ndarray] = []
        size, number, part = 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            vocab, at = np.unique(np.concatenate(rows), return_inverse=True)
            sizes, marks = np.array([len(r) for r in rows], np.int64), np.array(held, np.uint8)
            count = np.bincount(at[np.repeat(marks == 0, sizes)], minlength=len(vocab))
            blob = put(np.array([d or 0 for d in names], np.int64), np.array([d is None for d in names], np.uint8), marks, sizes, at.astype(np.uint32))
            out = pa.RecordBatch.from_arrays([pa.array([part << 24 | number], pa.int64()), pa.array([put(steps(vocab), count.astype(np.uint32))], pa.binary()), pa.array([blob], pa.binary()), pa.array([size], pa.int64()), pa.array([len(vocab)], pa.int64())], names=["block", "vocab", "blob", "tokens", "words"])
            size, number = 0, number + 1
            for x in (names, held, rows):
                x.clear()
            return out

        for whole in batches:
            for b in slices(whole, "text"):
                for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b), strict=True):
                    words = t.encode("utf-8", "surrogatepass").lower().split()
                    rows.append(np.concatenate((known(words), [np.uint64(END)])))
                    names.append(d)
                    held.append(bool(h))
                    size += len(rows[-1])
                    if size >= BLOCK_TOKENS:
                        yield flush()
        if rows:
            yield flush()

    return docs.mapInArrow(run, "block long, vocab binary, blob binary, tokens long, words long")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows (shard, block, blob) that are ordered by shard, one shard at a time."""
    shard, names, blobs = None, [], []
    for b in batches:
        for s, name, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if s != shard and blobs:
                yield shard, names, blobs
                names, blobs = [], []
            shard = s
            names.append(name)
            blobs.append(blob)
    if blobs:
        yield shard, names, blobs


def to_shards(block: int, out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["shard", "block", "blob"])


# -- the lexicon -------------------------------------------------------------------------------------------


def frequency_class(count: np.ndarray) -> np.ndarray:
    """0 for the most frequent words, CLASSES - 1 for those without a training count."""
    return np.where(count > 0, CLASSES - 1 - np.frexp(np.maximum(count, 1).astype(np.float64))[1], CLASSES - 1).astype(np.uint8)


def _lexicon(blocks: DataFrame, shards: int, n: int) -> DataFrame:
    """(block, shard, blob) classes, ranks within the shard's class and corpus counts of a block's words; a row of block -1 with the shard's class sizes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                vocab, count = get(batch.column(1)[r].as_py())
                vocab = np.cumsum(vocab)
                shard = ((vocab >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                yield to_shards(batch.column(0)[r].as_py(), [(int(s), put(steps(vocab[cut[s] : cut[s + 1]]), count[cut[s] : cut[s + 1]])) for s in np.flatnonzero(np.diff(cut))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, names, blobs in by_shard(batches):
            words, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for k in range(0, len(blobs), 64):
                parts = [get(b) for b in blobs[k : k + 64]]
                words, of = np.unique(np.concatenate([words, *(np.cumsum(p[0]) for p in parts)]), return_inverse=True)
                count = np.bincount(of, np.concatenate([count, *(p[1] for p in parts)]), len(words)).astype(np.int64)  # exact below 2**53
            level = mapped(EliasFano.build(words))
            lexicon, kind = EliasFano(level[0].tobytes(), *level[1:]), frequency_class(count)
            order = np.argsort(kind, kind="stable")
            sizes = np.bincount(kind, minlength=CLASSES)
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for name, blob in zip(names, blobs, strict=True):
                at = lexicon.successor(np.cumsum(get(blob)[0]))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([shard], pa.int32()), pa.array([put(kind[at], rank[at], count[at].astype(np.uint64))], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], names=["block", "shard", "blob", "tokens", "words"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([shard], pa.int32()), pa.array([sizes.astype("<i8").tobytes()], pa.binary()), pa.array([int(count.sum())], pa.int64()), pa.array([int((count > 0).sum())], pa.int64())], names=["block", "shard", "blob", "tokens", "words"])

    asked = blocks.select("block", "vocab").mapInArrow(ask, "shard int, block long, blob binary").repartition(n, "shard").sortWithinPartitions("shard", "block")
    return asked.mapInArrow(number, "block long, shard int, blob binary, tokens long, words long")


def _numbered(blocks: DataFrame, lexicon: DataFrame, firsts: np.ndarray, n: int) -> DataFrame:
    """Blocks again: block, names (numbers), blob (ids, marks, sizes, places among names, corpus counts), sample (keys).  firsts: by shard and class."""
    shared = blocks.sparkSession.sparkContext.broadcast(firsts)  # 512 bytes a lexicon shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, shards, blobs in rows_of_blocks(batches):
            parts = [get(b) for b in blobs[1:]]
            names = np.concatenate([np.array([BEGIN_ID], np.int64), *(shared.value[s][kind] + rank for s, (kind, rank, _) in zip(shards[1:], parts, strict=True))])
            names[-1] = END_ID  # the end mark has the last hash
            count = np.concatenate([np.zeros(1, np.uint64), *(c for _, _, c in parts)])
            count[0] = count[-1]
            order = np.argsort(names)
            place = np.empty(len(names), np.uint32)
            place[order] = np.arange(len(names))
            ids, nulls, held, sizes, at = get(blobs[0])
            token, names = place[at.astype(np.int64) + 1], names[order].astype(np.uint64)
            events = np.linspace(0, len(token) - 1, SAMPLE_EVENTS).astype(np.int64)
            ends = np.cumsum(sizes)
            text = np.searchsorted(ends, events, "right")
            u = np.where(events == ends[text] - sizes[text], 0, token[events - 1])
            w = np.where(events == ends[text] - 1, END_ID, token[np.minimum(events + 1, len(token) - 1)])
            sample = np.stack([names[u], names[token[events]], names[w]], 1)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([put(steps(names))], pa.binary()), pa.array([put(ids, nulls, held, sizes, token, count[order])], pa.binary()), pa.array([sample.tobytes()], pa.binary())], names=["block", "names", "blob", "sample"])

    both = blocks.select("block", F.lit(-1).alias("shard"), "blob").unionByName(lexicon.where("block >= 0").select("block", "shard", "blob"))
    return both.repartition(n, "block").sortWithinPartitions("block", "shard").mapInArrow(run, "block long, names binary, blob binary, sample binary")


def rows_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows (block, shard, blob) that are ordered, one block at a time; the block's own row has shard -1 and comes first."""
    name, shards, blobs = None, [], []
    for b in batches:
        for block, s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if s < 0 and blobs:
                yield name, shards, blobs
                shards, blobs = [], []
            name = block
            shards.append(s)
            blobs.append(blob)
    if blobs:
        yield name, shards, blobs


# -- shards of triples ---------------------------------------------------------------------------------------


def shard_ends(blocks: DataFrame, shards: int) -> np.ndarray:
    """First keys of the shards after the first, at even steps of a bounded sample of the corpus's triples."""
    rows = blocks.select("sample", F.xxhash64("block").alias("h"), "block").orderBy("h", "block").limit(SAMPLE_BLOCKS).select("sample").collect()
    seen = np.concatenate([np.frombuffer(r["sample"], np.uint64).reshape(-1, 3) for r in rows] or [np.zeros((0, 3), np.uint64)])
    seen = seen[np.lexsort((seen[:, 2], seen[:, 1], seen[:, 0]))]
    at = np.unique(np.arange(1, shards) * len(seen) // shards)
    return np.unique(seen[at], axis=0)


def narrowest(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 2**32 else x.astype(np.uint64)


def _queries(blocks: DataFrame, ends: np.ndarray) -> DataFrame:
    """(shard, block, blob): a block's triples in a shard's range, as a little trie of their own, with training counts."""
    shared = blocks.sparkSession.sparkContext.broadcast(ends)  # 24 bytes a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names = np.cumsum(get(batch.column(1)[r].as_py())[0])
                _, _, held, sizes, token, _ = get(batch.column(2)[r].as_py())
                b = Block(sizes, token.astype(np.int64), len(names))
                count, cut, out = b.counts(held), b.cuts(names, shared.value), []
                for s in np.flatnonzero(np.diff(cut)):
                    x, y = cut[s], cut[s + 1]
                    p, q = b.pair_of[x], b.pair_of[y - 1] + 1
                    at = heads_of(b.u[p:q])
                    u = narrowest(names[b.u[p:q][at[:-1]]])
                    out.append((int(s), put(steps(u), np.diff(at).astype(np.uint32), narrowest(names[b.v[p:q]]), np.bincount(b.pair_of[x:y] - p, minlength=q - p).astype(np.uint32), narrowest(names[b.w[x:y]]), count[x:y].astype(np.uint32))))
                    if len(out) == 256:
                        yield to_shards(batch.column(0)[r].as_py(), out)
                        out = []
                if out:
                    yield to_shards(batch.column(0)[r].as_py(), out)

    return blocks.select("block", "names", "blob").mapInArrow(run, "shard int, block long, blob binary")


def opened(blob: bytes) -> list[np.ndarray]:
    """u, n_v, v, n_w, w, counts of a block's entries for a shard."""
    u, n_v, v, n_w, w, count = get(blob)
    return [np.cumsum(u, dtype=np.uint64), n_v.astype(np.int64), v.astype(np.uint64), n_w.astype(np.int64), w.astype(np.uint64), count]


def merge(blobs: list[bytes], bits: int) -> Trie:
    """The trie of a shard's entries that training texts have."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for b in blobs:
        u, n_v, v, n_w, w, count = opened(b)
        seen = count > 0
        for c, x in zip(columns, (np.repeat(np.repeat(u, n_v), n_w), np.repeat(v, n_w), w, count), strict=True):
            x = x[seen]
            c.append(narrowest(x) if x.dtype == np.uint64 else x)
    return Trie(*(np.concatenate(c) for c in columns), bits)


SHARD_ROW = ["block", "shard", "blob"]


def _answers(queries: DataFrame, bits: int, ends: np.ndarray) -> DataFrame:
    """queries ordered by shard.  (block, shard, blob) answers, and a row of block -1 with the shard's edges.

    An answer also says where the contexts stand that the shard's range begins and ends in (words, then pairs; -1: nowhere).
    """
    shared = queries.sparkSession.sparkContext.broadcast(ends)  # 24 bytes a shard

    def borders(shard: int, u: np.ndarray, n_v: np.ndarray, v: np.ndarray) -> list[int]:
        out = [-1] * 4
        for k, (end, at, last) in enumerate(((shard - 1, 0, 0), (shard, -1, len(u) - 1))):
            if 0 <= end < len(shared.value) and u[at] == shared.value[end, 0]:
                out[k] = last
                if v[at] == shared.value[end, 1]:
                    out[2 + k] = len(v) - 1 if k else 0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, names, blobs in by_shard(batches):
            trie, at = merge(blobs, bits), 0
            while at < len(blobs):
                cells, n, to = [], 0, at
                while to < len(blobs) and (n < BATCH or not cells):
                    cells.append(opened(blobs[to]))
                    n, to = n + len(cells[-1][4]), to + 1
                got = trie.answer(*(np.concatenate([c[k] for c in cells]) for k in range(5)))
                cuts = [np.cumsum([0, *(len(c[k]) for c in cells)]) for k in (4, 2, 2, 0)]
                answers = [put(*(g[e[j] : e[j + 1]].astype("<u2") for g, e in zip(got, cuts, strict=True)), np.array(borders(shard, *cell[:3]), np.int64)) for j, cell in enumerate(cells)]
                yield pa.RecordBatch.from_arrays([pa.array(names[at:to], pa.int64()), pa.array([shard] * len(answers), pa.int32()), pa.array(answers, pa.binary())], names=SHARD_ROW)
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([shard], pa.int32()), pa.array([np.array(trie.edges, np.int64).tobytes()], pa.binary())], names=SHARD_ROW)

    return queries.mapInArrow(run, "block long, shard int, blob binary")


def put_together(edges: list[tuple[int, np.ndarray]], ends: np.ndarray) -> np.ndarray:
    """For each shard and the contexts that its range begins and ends in (two words, two pairs): the whole training count
    and degree, and the shard's part of the count.  edges: of the shards with training triples, in order."""
    words, pairs, parts, before = {}, {}, {}, None
    for s, e in edges:
        if not len(e):
            continue
        first, last = (tuple(map(int, x)) for x in e.reshape(2, 7))
        again = before is not None and before[3:5] == first[3:5]  # this pair was counted among its word's successors already
        for k, edge in enumerate((first, last)):
            if not k or edge[0] != first[0]:
                c, d = words.get(edge[0], (0, 0))
                words[edge[0]] = (c + edge[1], d + edge[2] - (again if not k else 0))
                parts[s, edge[0]] = edge[1]
            if not k or edge[3:5] != first[3:5]:
                c, d = pairs.get(edge[3:5], (0, 0))
                pairs[edge[3:5]] = (c + edge[5], d + edge[6])
                parts[s, edge[3:5]] = edge[5]
        before = last
    out = np.zeros((len(ends) + 1, 4, 3), np.int64)
    for k, (u, v, _) in enumerate(ends.tolist()):
        for shard, side in ((k, 1), (k + 1, 0)):
            out[shard, side] = (*words.get(u, (0, 0)), parts.get((shard, u), 0))
            out[shard, 2 + side] = (*pairs.get((u, v), (0, 0)), parts.get((shard, (u, v)), 0))
    return out


def assembled(block: Block, total: np.ndarray, got: list[tuple[int, list[np.ndarray]]], mend: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each event's log10 probability by the model and by the unigrams, and whether its token is known.  total: training counts of the block's words."""
    d_two, d_three = DISCOUNTS
    p3, p2, back2 = np.zeros(len(block.key)), np.zeros(len(block.pair)), np.ones(len(block.pair))
    total, back1 = total.astype(np.float64), np.ones(len(total))
    weights = lambda code: np.where(code == 0, 1.0, restore(code))
    at = 0
    for shard, (code3, code2, b2, b1, flags) in got:
        x, y = at, at + len(code3)
        p, q = block.pair_of[x], block.pair_of[y - 1] + 1
        at, u_here, code2, b1 = y, block.u[p:q], code2.copy(), b1.copy()
        names = u_here[heads_of(u_here)[:-1]]
        here3, here2, weight2, weight1 = restore(code3), restore(code2), weights(b2), weights(b1)
        # contexts that go on in a neighbouring shard: figures of the whole, here for this shard's part, there perhaps for all
        own = mend[shard]
        for k in (0, 1):
            f, (whole, degree, part) = flags[k], own[k]
            if f >= 0 and whole and not (k and flags[0] == f):
                i, j = np.searchsorted(u_here, [names[f], names[f] + 1])
                here2[i:j] *= part / whole
                weight1[f], b1[f] = d_two * degree / whole, 1
        for k in (2, 3):
            f, (whole, degree, part) = flags[k], own[k]
            if f >= 0 and whole and not (k == 3 and flags[2] == f):
                i, j = np.searchsorted(block.pair_of[x:y], [p + f, p + f + 1])
                here3[i:j] *= part / whole
                here2[f], weight2[f], code2[f] = (whole - d_two) / total[u_here[f]], d_three * degree / whole, 1
        p3[x:y] = here3
        seen2, seen1 = code2 != 0, b1 != 0
        p2[p:q][seen2], back2[p:q][seen2], back1[names[seen1]] = here2[seen2], weight2[seen2], weight1[seen1]
    unigram = ((total + ADD) / norm)[block.token]
    pair = block.pair_of[block.of_event]
    each = p2[pair] + back1[block.u][pair] * unigram
    later = np.ones(len(each), bool)
    later[block.starts] = False
    k = np.flatnonzero(later)
    each[k] = p3[block.of_event[k - 1]] + back2[pair[k - 1]] * each[k]
    return np.log10(each), np.log10(unigram), total[block.token] > 0


def score_documents(docs: DataFrame, held_out: Column, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    raw, seen = materialize_counted(_blocks(rows), "lm-blocks", *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words")))
    lexicon_shards = shards or min(MOST_LEXICON_SHARDS, -(-seen["words"] // LEXICON_WORDS) or 1)
    lexicon = materialize(_lexicon(raw, lexicon_shards, n), "lm-lexicon")
    sizes = np.zeros((lexicon_shards, CLASSES), np.int64)
    all_tokens = distinct = 0
    for r in lexicon.where("block = -1").select("shard", "blob", "tokens", "words").collect():  # one row a lexicon shard
        sizes[r["shard"]] = np.frombuffer(r["blob"], "<i8")
        all_tokens, distinct = all_tokens + r["tokens"], distinct + r["words"]
    norm = all_tokens + ADD * (distinct + 1)
    # numbers go by class, then shard, then rank: frequent words have small ones
    by_class = sizes.T.ravel()
    blocks = materialize(_numbered(raw, lexicon, FIRST_ID + (np.cumsum(by_class) - by_class).reshape(CLASSES, -1).T, n), "lm-numbered")
    drop_table(raw)
    drop_table(lexicon)

    shards = shards or min(MOST_SHARDS, -(-seen["tokens"] // min(max(seen["tokens"] // FEW_SHARDS, SMALL_SHARD), LARGE_SHARD)) or 1)
    ends = shard_ends(blocks, shards)
    asked = _queries(blocks, ends).repartition(n, "shard").sortWithinPartitions("shard", "block")
    answers = materialize(_answers(asked, int(FIRST_ID + sizes.sum()).bit_length(), ends), "lm-answers")
    edges = answers.where("block = -1").select("shard", "blob").collect()  # 112 bytes a shard
    shared = spark.sparkContext.broadcast(put_together([(r["shard"], np.frombuffer(r["blob"], np.int64)) for r in sorted(edges, key=lambda r: r["shard"])], ends))  # 96 bytes a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, blobs in rows_of_blocks(batches):
            ids, nulls, held, sizes, token, total = get(blobs[0])
            b = Block(sizes, token.astype(np.int64), len(total))
            each = assembled(b, total, [(s, get(x)) for s, x in zip(at[1:], blobs[1:], strict=True)], shared.value, norm)
            sums = [np.add.reduceat(x.astype(kind), b.starts) for x, kind in zip(each, (np.float64, np.float64, np.int64), strict=True)]
            names = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(held.astype(bool)), pa.array(sizes), pa.array(sums[2]), pa.array(np.full(len(sizes), all_tokens)), pa.array(sums[1]), pa.array(sums[0])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = blocks.select("block", F.lit(-1).alias("shard"), "blob").unionByName(answers.where("block >= 0").select("block", "shard", "blob"))
    return both.repartition(n, "block").sortWithinPartitions("block", "shard").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_ef_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return score_documents(documents(spark, sf_dir), held)

"""BPE encoding and decoding by a prefix-sharing trie.

The distinct pre-tokens of a batch go into one trie.  A depth-first walk carries, for each prefix, the last
token of the prefix's own encoding; since a prefix of an encoding is the encoding of that prefix, the last
token is the one suffix of the prefix that is a token and may stand after the last token of what precedes
it.  Two tokens may stand together if merging their joined symbols gives those two back (remembered per
pair).  So every shared prefix is encoded once, and a word's ids follow from the states on its path.

Defined results: null text counts as empty (0 ids, empty decoding); repeated rows and null doc_id are
carried; an empty table gives no rows; very long texts are encoded whole; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .bpe import WORD_END
from .common import documents, slices, texts_of, tokenizer_path

#: Pairs of tokens whose verdict a worker remembers.
PAIRS = 500_000
#: Rank of a pair that no merge joins.
NEVER = 1 << 30


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles within: what is made here has none."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


class TrieEncoder:
    def __init__(self, path: str):
        self.front = bpe.WordFront(path)
        self.vocab = self.front.vocab
        self.rank = {pair: k for k, pair in enumerate(self.front.merges)}
        self.inner = {t for t in self.vocab if not t.endswith(WORD_END)}
        self.final = {t.removesuffix(WORD_END) for t in self.vocab if t.endswith(WORD_END)}
        self.longest = max(map(len, self.inner | self.final))
        self.inner_ends, self.final_ends = self.lengths(self.inner), self.lengths(self.final)
        self.may: dict[tuple[str, str], bool] = {}
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.front.special.items()}

    @staticmethod
    def lengths(tokens: set[str]) -> dict[str, tuple[int, ...]]:
        """Last three (or fewer) characters -> lengths of the tokens to try for a prefix that ends so, longest first."""
        ends: dict[str, set[int]] = {}
        for t in tokens:
            ends.setdefault(t[-3:], set()).add(len(t))
        full = {e: {*n} for e, n in ends.items()}
        for e in ends:
            for k in range(1, len(e)):
                full[e] |= {n for n in ends.get(e[k:], ()) if n <= len(e) - k}
        return {e: tuple(sorted(n, reverse=True)) for e, n in full.items()}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE merging, for the short strings that pair verdicts need."""
        rank, symbols = self.rank, list(symbols)
        ranks = [rank.get(p, NEVER) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((symbols[at - 1], symbols[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank.get((symbols[at], symbols[at + 1]), NEVER)
        return symbols

    def symbols(self, token: str) -> list[str]:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token.removesuffix(WORD_END)
            return [*body[:-1], body[-1] + WORD_END]
        return [*token]

    def stand(self, left: str, right: str) -> bool:
        """May `right` follow `left` ("" for the word's start)?"""
        key = (left, right)
        if (known := self.may.get(key)) is None:
            known = self.may[key] = self.merged((self.symbols(left) if left else []) + self.symbols(right)) == ([left, right] if left else [right])
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """ids of each distinct pre-token (strings of the byte alphabet)."""
        with uncollected():  # a trie is many small dicts without cycles; collecting while it grows doubles the time
            return self.walk(words)

    def walk(self, words: Iterable[str]) -> dict[str, list[int]]:
        root: dict = {}
        for w in words:
            node = root
            for c in w:
                if (child := node.get(c)) is None:
                    child = node[c] = {}
                node = child
            node[""] = w
        out: dict[str, list[int]] = {}
        inner, final, longest, vocab, may, stand = self.inner, self.final, self.longest, self.vocab, self.may, self.stand
        inner_ends, final_ends = self.inner_ends, self.final_ends
        last: list[str] = [""]
        todo = [(child, 1, c) for c, child in root.items()]
        while todo:
            node, depth, tail = todo.pop()
            del last[depth:]
            most = len(tail)
            if "" in node:
                for n in final_ends.get(tail[-3:]) or final_ends.get(tail[-2:]) or final_ends[tail[-1:]]:
                    if n <= most and (t := tail[most - n :]) in final:
                        t += WORD_END
                        left = last[depth - n]
                        if (ok := may.get((left, t))) is None:
                            ok = stand(left, t)
                        if ok:
                            break
                else:
                    raise ValueError(f"no token ends {node['']!r}")
                ids, at = [vocab[t]], depth - n
                while at:
                    t = last[at]
                    ids.append(vocab[t])
                    at -= len(t)
                ids.reverse()
                out[node[""]] = ids
                if len(node) == 1:
                    continue
            for n in inner_ends.get(tail[-3:]) or inner_ends.get(tail[-2:]) or inner_ends[tail[-1:]]:
                if n <= most and (t := tail[most - n :]) in inner:
                    left = last[depth - n]
                    if (ok := may.get((left, t))) is None:
                        ok = stand(left, t)
                    if ok:
                        break
            else:
                raise ValueError(f"no token ends the prefix {tail!r}")
            last.append(t)
            keep = tail[-longest + 1 :] if most >= longest else tail
            todo += [(child, depth + 1, keep + c) for c, child in node.items() if c]
        if len(may) > PAIRS:
            may.clear()
        return out

    def encode_chunks(self, chunks: Iterable[str]) -> dict[str, list[int]]:
        """ids of distinct white-space-free chunks."""
        whole: dict[str, list[int]] = {}
        parts: dict[str, list[str]] = {}
        for c in chunks:
            if "<|" in c and any(s in c for s in self.front.special):
                whole[c] = self.front.library.encode(c, add_special_tokens=False).ids
            else:
                parts[c] = self.front.pieces(c)
        known = self.encode_words({p for ps in parts.values() for p in ps})
        for c, ps in parts.items():
            whole[c] = known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]]
        return whole

    def decode(self, ids: Iterable[int]) -> str:
        """As the library: the file has no decoder, so token strings are joined by spaces."""
        return " ".join([self.name[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


class IdBytes:
    """Chunk -> ids as little-endian uint32 bytes, remembered per worker up to a bound."""

    def __init__(self, path: str):
        self.trie, self.known = encoder(path), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.trie.front.chunks(t) for t in texts]
        known = self.known
        if len(known) > bpe.CACHE_CHUNKS:
            known.clear()
        fresh = set().union(*cut).difference(known)
        known.update((c, np.array(ids, dtype="<u4").tobytes()) for c, ids in self.trie.encode_chunks(fresh).items())
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        bpe.forget_long(known, fresh)
        return out


@lru_cache(maxsize=2)
def id_bytes(path: str) -> IdBytes:
    return IdBytes(path)


class Digests:
    """Chunk -> (count, ids as decimals, decoding); all three join over the chunks of a text, and over the pre-tokens of a chunk."""

    def __init__(self, path: str):
        self.trie, self.known, self.parts = encoder(path), {}, {}
        self.decimal = {i: str(i) for i in self.trie.name}

    def shown(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.decimal[i] for i in ids]), self.trie.decode(ids)

    def learn(self, fresh: set[str]) -> set[str]:
        """Remembers the new chunks; pre-tokens that other chunks had aren't walked again.  Returns the new pre-tokens."""
        known, parts, front = self.known, self.parts, self.trie.front
        cut: dict[str, list[str]] = {}
        for c in fresh:
            if "<|" in c and any(s in c for s in front.special):
                known[c] = self.shown(front.library.encode(c, add_special_tokens=False).ids)
            else:
                cut[c] = front.pieces(c)
        new = {p for ps in cut.values() for p in ps}.difference(parts)
        shown = self.shown
        parts.update((p, shown(ids)) for p, ids in self.trie.encode_words(new).items())
        for c, ps in cut.items():
            known[c] = parts[ps[0]] if len(ps) == 1 else joined([parts[p] for p in ps])
        return new

    def of(self, texts: list[str]) -> list[tuple[int, str, str]]:
        cut = [self.trie.front.chunks(t) for t in texts]
        known, parts = self.known, self.parts
        if len(known) > bpe.CACHE_CHUNKS // 2:
            known.clear()
        if len(parts) > bpe.CACHE_CHUNKS // 2:
            parts.clear()
        fresh = set().union(*cut).difference(known)
        with uncollected():
            new = self.learn(fresh)
            out = [joined([*map(known.__getitem__, c)]) for c in cut]
        bpe.forget_long(known, fresh)
        bpe.forget_long(parts, new)
        return out


COUNT, IDS, DECODED = itemgetter(0), itemgetter(1), itemgetter(2)


def joined(got: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    return sum(map(COUNT, got)), " ".join(map(IDS, got)), " ".join(map(DECODED, got))


@lru_cache(maxsize=2)
def digests(path: str) -> Digests:
    return Digests(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every whole text; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = id_bytes(path)
        for whole in batches:
            for b in slices(whole, "text"):
                ids = [np.frombuffer(x, dtype="<u4").astype("<i4") for x in e.encode(texts_of(b))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded (string) of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; returns counts and digests, so that ids need not leave the worker."""

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = digests(path)
        for whole in batches:
            for b in slices(whole, "text"):
                got = d.of(texts_of(b))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([sha(i) for _, i, _ in got], pa.string()), pa.array([sha(t) for _, _, t in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))

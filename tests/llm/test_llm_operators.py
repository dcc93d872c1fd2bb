"""The training-data operators on odd inputs and against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import bpe, components, ef_lm, elias_fano, media_ogg, near_dedup, order_minhash, packing, pii, repair_shards, token_counts, toxicity, trie_bpe
from brindle.llm.common import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, component_id long"
RNG = random.Random(3)
LONG = " ".join(RNG.choice(["alpha", "beta", "gamma", "delta,", "Épsilon", "zeta.\n", "42"]) for _ in range(6000))
BASE = " ".join(f"word{k} other{k % 7}" for k in range(40))
TEXTS = [
    None, "", " ", "a", "  two  spaces \n\n and\ttabs ", "a <|endoftext|> b<|startoftext|>c", "don't we'll 's", "日本語 テキスト é ½ ² 🎉 Σας İ ẞ", "x" * 3000, LONG,
    BASE, BASE, BASE + " tail", BASE.replace("word3", "wird3"), "a\x1cb c d", "mail me: jo.doe+x@ex-ample.co.uk, +1 (212) 555-0123 or 10.0.255.1, 4111 1111 1111 1111",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ties, repeated rows, clashing extra columns."""
    rows = [(k, t, None if k % 3 else "en", None, None, 0.5, 1, 7) for k, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "nobody's text " + BASE, None, None, None, None, None, None), (3, "another text under a used id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def some(rows):
    return Counter(map(tuple, rows))


# -- tokenizers (4, 6, 7, 8) -----------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'é.aAbtse<|>")), max_size=60))
def test_encoders_equal_the_library(text):
    word, byte = trie_bpe.encoder(WORD), bpe.byte_encoder(BYTE)
    want = word.front.library.encode(text, add_special_tokens=False).ids
    for got in (trie_bpe.id_bytes(WORD).encode([text])[0], bpe.word_encoder(WORD).encode(text)):
        assert np.frombuffer(got, "<u4").tolist() == want
    want = byte.front.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(byte.encode(text), "<u4").tolist() == want
    assert token_counts.counter(BYTE).count(text) == len(want)


def test_whole_tokens_are_proved():
    front = bpe.ByteFront(BYTE)
    whole, rest = bpe.whole_tokens(front)
    assert len(whole) + len(rest) == len(front.vocab)
    for t in RNG.sample(sorted(whole), 300):
        assert [x.id for x in front.library.model.tokenize(t)] == [whole[t]]


def test_op4_walks_a_pre_token_once(monkeypatch):
    """Pre-tokens that earlier chunks had are remembered, in this batch and in later ones."""
    d, walked = trie_bpe.Digests(WORD), []
    monkeypatch.setattr(d.trie, "encode_words", lambda words, plain=d.trie.encode_words: (walked.extend(words := [*words]), plain(words))[1])
    library = tokenizers.Tokenizer.from_file(WORD)
    texts = ["some words, here", "(Some) WORDS. here! \u00c9t\u00e9, \u00e9t\u00e9 it's x\x1cy", "words " + "z" * 90 + " <|endoftext|>here", "z" * 90]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert d.of([t]) == [(len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
    assert Counter(walked)["words"] == Counter(walked)["some"] == 1
    assert all(len(p) <= bpe.CACHE_LENGTH for p in d.parts)


def test_op4_digests(odd, empty):
    library = tokenizers.Tokenizer.from_file(WORD)
    want = []
    for d, t in texts(odd):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert some(trie_bpe.round_trip_digests(odd, WORD).collect()) == Counter(want)
    assert trie_bpe.round_trip_digests(empty, WORD).count() == 0
    encoded = trie_bpe.encode_documents(odd, WORD)
    decoded = trie_bpe.decode_documents(encoded, WORD)
    assert {(r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in decoded.collect()} == {(w[0], w[3]) for w in want}


def test_op8_counts(odd, empty):
    library = tokenizers.Tokenizer.from_file(BYTE)
    want = Counter((d, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts(odd))
    assert some(token_counts.count_tokens(odd, BYTE).collect()) == want
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_op7_shards_read_back(spark, odd, empty, tmp_path):
    out = f"file://{tmp_path}/shards"
    repair_shards.write_shards(odd, BYTE, out, parts=3)
    library = tokenizers.Tokenizer.from_file(BYTE)
    key = lambda d: -(2**63) if d is None else d
    ids = [(d, library.encode(t, add_special_tokens=False).ids + [0]) for d, t in texts(odd)]
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids)
    got = sorted(map(tuple, repair_shards.read_shards(spark, out).collect()), key=lambda r: r[1])
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert [key(r[0]) for r in got] == sorted(key(r[0]) for r in got)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    none = f"file://{tmp_path}/none"
    repair_shards.write_shards(empty, BYTE, none, parts=3)
    assert repair_shards.read_shards(spark, none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.sampled_from([50257, 70000]))
def test_repair_round_trip(ids, first):
    x = np.array(ids * 3, np.uint32)
    seq, rules = repair_shards.compress(x, first, least=2)
    assert repair_shards.expand(seq, rules, first).tolist() == x.tolist()
    lengths = repair_shards.expansion_lengths(rules, first)
    assert [len(repair_shards.expand(np.array([first + k]), rules, first)) for k in range(len(rules))] == lengths.tolist()


def test_shard_random_access():
    docs = [np.random.default_rng(k).integers(0, 40, k * 37 % 900).astype("<u4") for k in range(30)]
    blob, n = repair_shards.pack(list(range(30)), [d.tobytes() for d in docs], 50257)
    shard = repair_shards.Shard(blob)
    assert shard.n_ids == n and len(shard.rules) and len(shard.offsets) > 1
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d.tolist()
    every = np.concatenate(docs)
    for a, b in [(0, n), (5, 5), (n, n), *(sorted(RNG.sample(range(n), 2)) for _ in range(60))]:
        assert shard.ids(a, b).tolist() == every[a:b].tolist()


def test_repair_leaves_no_frequent_pair():
    """Repeated documents become few symbols; a pair whose slot was taken is not lost."""
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50_000, 3000).astype(np.uint32)
    seq, rules = repair_shards.compress(np.concatenate([np.append(passage, k) for k in range(64)]).astype(np.uint32), 50257)
    assert len(seq) < 64 * 30 and repair_shards.expansion_lengths(rules, 50257).max() > 100
    pairs = Counter()
    for a, b in zip(seq.tolist(), seq.tolist()[1:]):
        pairs[a, b] += 1
    assert max(pairs.values()) < 2 * repair_shards.LEAST  # overlapping places count twice


def test_op6_packing(odd, empty):
    library = tokenizers.Tokenizer.from_file(WORD)
    got = packing.pack_documents(odd, WORD).collect()
    pieces = Counter()
    for d, t in texts(odd):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4")
        pieces.update((d, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()), len(ids)) for k in range(0, len(ids), 2048))
    assert Counter(tuple(r)[:5] for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, WORD).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_shortest_pack_first_places_all(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    held = Counter()
    for n, p in patterns:
        assert sum(p) <= 64 and n > 0
        for x in p:
            held[x] += n
    assert held == Counter(histogram)
    ranks = {}
    for length, low, high, _, _ in packing.slots_of(patterns):
        ranks.setdefault(length, []).append((low, high))
    for length, spans in ranks.items():
        assert sorted(spans)[0][0] == 0 and max(h for _, h in spans) == histogram[length]
        assert all(a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))


# -- media (5) --------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 300))
def test_ogg_round_trip(data, times):
    payload = (data or b"x") * (times + 1)
    payload += bytes(-len(payload) % 64)
    back, seen = media_ogg.demux(media_ogg.mux(payload))
    assert back == payload and seen["streams"] == 2 and seen["seconds"] == pytest.approx(len(payload) / 8000)


def test_ogg_blocks_alternate():
    """Every second block goes to the second stream, also in short payloads."""
    for n in (1, 2, 3, 16, 33, 100):
        payload = b"".join(bytes([k % 251]) * 64 for k in range(n))
        packets, media = {}, media_ogg.mux(payload)
        for _, _, serial, seq, lacing, start, end in media_ogg.pages_of(media):
            packets.setdefault(serial, []).append(media[start:end] if seq else b"")
        first, second = ([x[k] for k in range(0, len(x), 64)] for x in (b"".join(p) for p in packets.values()))
        assert first == [k % 251 for k in range(0, n, 2)] and second == [k % 251 for k in range(1, n, 2)]
        assert media_ogg.demux(media)[0] == payload


def test_ogg_checksum_is_the_containers():
    def slow(data):
        reg = 0
        for b in data:
            reg ^= b << 24
            for _ in range(8):
                reg = ((reg << 1) ^ 0x04C11DB7 if reg >> 31 else reg << 1) & 0xFFFFFFFF
        return reg

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert media_ogg.checksum(data) == slow(data)


def test_ogg_damage_is_found():
    media = bytearray(media_ogg.mux(bytes(range(256)) * 400))
    for at in (5, 40, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(media_ogg.OggError):
            media_ogg.demux(bytes(bad))
    with pytest.raises(media_ogg.OggError):
        media_ogg.demux(bytes(media[:-10]))


def test_op5_media(odd, empty):
    got = media_ogg.read_media(media_ogg.store_media(odd))
    want = Counter()
    for d, t in texts(odd):
        p = t.encode()
        p += bytes(-len(p) % 64 if p else 64)
        want[(d, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter(tuple(r)[:5] for r in got.collect()) == want
    assert media_ogg.read_media(media_ogg.store_media(empty)).count() == 0


# -- near-dedup (1), components -----------------------------------------------------------------------------------


def brute_components(rows, width, percent):
    sets, parent = [], list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return Counter((d, len(s), (least.get(find(k)) if s else d), d is not None and d == (least.get(find(k)) if s else d)) for k, ((d, _), s) in enumerate(zip(rows, sets)))


def test_op1_odd(odd, empty):
    assert some(near_dedup.near_components(odd, 4).collect()) == brute_components(texts(odd), 4, 80)
    assert near_dedup.near_components(empty, 4).count() == 0


def test_op1_near_groups(spark):
    rng, rows = random.Random(5), []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 60, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(words)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (4, 5):
        assert some(near_dedup.near_components(df, width).collect()) == brute_components(rows, width, 80)


def test_op1_prefix_filter_deals_hot_shingles(spark, monkeypatch):
    """Without leaders, and with shingles that more hold than one task takes, the exact step alone finds every link."""
    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "HOLDERS", 3)
    rng, rows = random.Random(12), []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(50)]
        for k in range(25):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(50)] = f"v{rng.randrange(30)}"
            rows.append((100 * g + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert some(near_dedup.near_components(df, 4).collect()) == brute_components(rows, 4, 80)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 3000):
        assert (near_dedup.sketch(rng.integers(0, 2**63, n, dtype=np.uint64)) != np.uint64(2**64 - 1)).all()
    x = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    same = (near_dedup.sketch(x[:1000]) == near_dedup.sketch(x[200:])).mean()
    assert abs(same - 800 / 1200) < 0.12


def test_set_squeeze_round_trip():
    import zstandard

    for n in (1, 500):
        x = np.unique(np.random.default_rng(2).integers(0, 2**64, n, dtype=np.uint64))
        assert near_dedup.unsqueezed(near_dedup.squeezed(x, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor()).tolist() == x.tolist()


def test_op1_large_groups(spark):
    """Thousands of near copies, and thousands of fillings of a template that are not near copies of each other."""
    rng, rows = random.Random(11), []
    passage = [f"p{k}" for k in range(90)]
    for k in range(2000):  # one word changed near the end: all linked
        rows.append((k, " ".join([*passage[:86], f"x{k}", *passage[87:]])))
    frame = [f"f{k}" for k in range(60)]
    for k in range(2000):  # 60 words in common, a paragraph of one's own: similarity about 0.56
        rows.append((10_000 + k, " ".join([*frame, *(f"s{rng.randrange(10**7)}" for _ in range(18))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(df, 4).collect()}
    assert all(got[k] == 0 for k in range(2000)) and all(got[10_000 + k] == 10_000 + k for k in range(2000))


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (300, 250)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{100 + k: 100 for k in range(30)}, 250: 250, 300: 250}


# -- toxicity (2) ---------------------------------------------------------------------------------------------------


def test_op2_learns_and_holds_out(spark):
    rng, rows, labels = random.Random(1), [], []
    for k in range(600):
        toxic = k % 5 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(40)] + (["vile", "scum"] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~toxicity.held_out(F.col("doc_id"), 4, 2))
    got = toxicity.score(docs, model).select("doc_id", "score", toxicity.held_out(F.col("doc_id"), 4, 2).alias("h")).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in got if r["h"]} == {r["doc_id"] for r in held}
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held)
    assert len(model[0]) < 500


def test_op2_odd(spark, odd, empty):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (9, 0)], "doc_id long, toxic int")
    for lab in (nothing, labels):
        scored = toxicity.score(odd, toxicity.train(odd, lab, F.lit(True)), "toxicity")
        assert scored.columns == [*odd.columns, "toxicity"] and scored.count() == odd.count()
        assert all(0 <= r["toxicity"] <= 1 for r in scored.collect())
        assert toxicity.score(empty, toxicity.train(empty, lab, F.lit(True)), "toxicity").count() == 0
    clash = toxicity.score(odd.withColumn("SCORE", F.lit("theirs")), toxicity.train(odd, labels, F.lit(True)))
    assert clash.select("score").schema[0].dataType.typeName() == "double" and clash.select("score").count() == odd.count()
    long = spark.createDataFrame([(1, LONG * 20)], "doc_id long, text string")
    assert toxicity.score(long, toxicity.train(long, labels, F.lit(True))).count() == 1


def test_ftrl_bounded_sample(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    kept, share = toxicity.sample(labels, F.lit(True), 200, 300)
    n = {r["toxic"]: (r["n"], r["w"]) for r in kept.groupBy("toxic").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()}
    assert abs(n[1][0] - 200) < 60 and abs(n[0][0] - 300) < 80 and share == pytest.approx(1 / 3, abs=0.01)
    assert n[0][1] / n[1][1] == pytest.approx((3333 / 300) / (1667 / 200), rel=0.01)
    assert (n[0][0] * n[0][1] + n[1][0] * n[1][1]) / (n[0][0] + n[1][0]) == pytest.approx(1, rel=0.05)


def plain_ftrl(rows, p, bits):
    """FTRL-proximal as published, a dict per vector: rows of (features, label, weight), in order."""
    z, n, bias = {}, {}, 2**bits

    def weight(i):
        if i not in z or (i != bias and abs(z[i]) <= p.l1):
            return 0.0
        l1 = 0.0 if i == bias else p.l1
        return -(z[i] - math.copysign(l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for at, label, importance in rows:
            x = [*at, bias]
            g = (1 / (1 + math.exp(-sum(map(weight, x)))) - label) * importance
            w = {i: weight(i) for i in x}
            for i in x:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_against_the_plain_algorithm(spark):
    rng, p = random.Random(8), toxicity.Ftrl(l1=0.4)
    rows = [(k, " ".join(rng.choice("abcdefghij") * 2 for _ in range(12)) + (" foul" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    at, w, bias = toxicity.train(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"), F.lit(True), p)
    hasher = toxicity.Hasher()
    order = sorted(rows, key=lambda r: xxhash.xxh3_64_intdigest(str(r[0])))
    want = plain_ftrl([(sorted(set(hasher.features(t).tolist())), y, 1.0) for _, t, y in order], p, toxicity.BITS)
    assert bias == pytest.approx(want.pop(2**toxicity.BITS), rel=1e-6)
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(want, rel=1e-5) and len(want) > 5


def test_op2_does_not_depend_on_the_number_of_labels(spark):
    """A hundred times the labels under the same bounds: the same sparsity and scores, up to the sample."""
    rng = random.Random(9)
    base = [(" ".join(f"w{rng.randrange(300)}" for _ in range(30)) + (" vile scum" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(300)]
    models = []
    for times in (1, 100):
        docs = spark.createDataFrame([(j * 300 + k, t) for j in range(times) for k, (t, _) in enumerate(base)], "doc_id long, text string")
        labels = spark.createDataFrame([(j * 300 + k, y) for j in range(times) for k, (_, y) in enumerate(base)], "doc_id long, toxic int")
        models.append(toxicity.train(docs, labels, F.lit(True), most_toxic=60, most_clean=240))
    test = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(base)], "doc_id long, text string")
    a, b = ([r["score"] for r in toxicity.score(test, m).orderBy("doc_id").collect()] for m in models)
    assert 0.3 < len(models[0][0]) / len(models[1][0]) < 3
    assert all((x >= 0.5) == (y >= 0.5) == bool(t) for x, y, (_, t) in zip(a, b, base))


def test_op2_bound_in_bytes(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(200)) + (" vile" if k % 2 else "")) for k in range(80)], "doc_id long, text string")
    labels = spark.range(80).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    at, w, bias = toxicity.train(docs, labels, F.lit(True), toxicity.Ftrl(l1=0.5), most_bytes=60_000)  # of 190,000
    assert len(at) and np.isfinite(w).all() and np.isfinite(bias)


# -- fingerprints (3) ----------------------------------------------------------------------------------------------


def test_op3_odd(odd, empty):
    got = order_minhash.fingerprint_documents(odd, parts=3).collect()
    rows = texts(odd)
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((d, len(t)) for d, t in rows)
    prints = {}
    for d, t in rows:
        prints.setdefault(order_minhash.fingerprint(t).tobytes().hex(), set()).add((d, len(t)))
    assert all((r["doc_id"], r["n_chars"]) in prints[r["fingerprint"]] for r in got)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert order_minhash.fingerprint_documents(empty).count() == 0


def test_op3_successors(spark):
    rng = random.Random(2)
    rows = [(k * 3 - 50, "".join(rng.choice("abc dé") for _ in range(rng.randrange(0, 200)))) for k in range(60)]
    want = {}
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 4
        want[d] = hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["edited_sha256"] for r in order_minhash.fingerprint_documents(df, parts=9).collect()} == want
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert order_minhash.fingerprint_documents(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_order_minhash_against_brute_force():
    text = "the cat sat on the mat and the cat sat on the mat again, " * 3
    x = order_minhash.numbered(order_minhash.kmers(text))
    assert len(set(x.tolist())) == len(x) > len(set(order_minhash.kmers(text).tolist()))
    want = []
    for j in range(order_minhash.SKETCHES):
        h = x * order_minhash.FACTORS[j]
        at = sorted(np.argsort(h)[: order_minhash.TUPLE])
        v = np.full(1, 0x51ED270B, np.uint64)
        for k in at:
            v = order_minhash.mix(v * order_minhash.STEP[6] + x[k])
        want.append(int(v[0]) >> 32)
    assert order_minhash.fingerprint(text).tolist() == want


def test_likeness_falls_with_the_size_of_an_edit():
    """Replacing a growing share of the words lowers the likeness, step by step on average over texts."""
    rng, means = random.Random(14), []
    texts_ = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(12)]
    for share in (0.0, 0.02, 0.1, 0.3, 0.8):
        total = 0.0
        for t in texts_:
            words = t.split()
            for k in rng.sample(range(300), int(300 * share)):
                words[k] = f"v{rng.randrange(5000)}"
            total += order_minhash.likeness(order_minhash.fingerprint(t), order_minhash.fingerprint(" ".join(words)))
        means.append(total / len(texts_))
    assert means[0] == 1 and all(a > b for a, b in zip(means, means[1:])) and means[-1] < 0.1


def test_order_matters():
    a = [f"sentence number {k} of this text." for k in range(60)]
    b = a[30:] + a[:30]
    f = order_minhash.fingerprint
    assert order_minhash.likeness(f(" ".join(a)), f(" ".join(b))) < 0.85
    assert order_minhash.likeness(f(" ".join(a)), f(" ".join(a))) == 1


# -- personal data (9) -----------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, r in PATTERNS.items() for m in re.finditer(r, t) if valid(k, m[0])]


def spans_of(df):
    return df.select("doc_id", F.expr(pii._joined(pii.KINDS, False)).alias("base"), F.expr(pii._joined(pii.ALL_KINDS, True)).alias("spans")).collect()


def test_op9_base_against_brute_force(spark, odd, empty):
    rng, extra = random.Random(4), []
    for k in range(400):
        extra.append((1000 + k, "".join(rng.choice(["a@b.c", "@", ".", "1", "22", "255", "0.", " ", "-", "+", "(", ")", "x", "é", "🎉", "4111111111111111", "_", "d@e.f-g.h"]) for _ in range(rng.randrange(1, 40)))))
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = spans_of(pii.find_personal_data(df))
    assert Counter((r["doc_id"], r["base"]) for r in got) == Counter((d, ",".join(brute_spans(t))) for d, t in texts(df))
    assert pii.find_personal_data(empty).count() == 0


def test_op9_bootstraps(spark):
    rng, rows = random.Random(6), []
    for k in range(30):
        rows.append((k, f"text {k} and call me +1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)} today {k}"))
    rows += [(100, "then call me 212 555 0199 instead"), (101, "the year was 212 555 0199 elsewhere"), (102, "write to jo (at) example.org now")]
    found = {r["doc_id"]: r["spans"] for r in spans_of(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert found[100] == "phone:13:25" and found[101] == "" and found[102] == ""
    assert all(found[k].startswith("phone:") and "," not in found[k] for k in range(30))


def test_op9_patterns_count_each_value_once(spark):
    rows = [(k, f"please call me +1 212 555 {1000 + k} today") for k in range(20)]
    rows += [(100 + k, "then call me 212 555 0199 instead") for k in range(300)]  # one unseen number in many copies
    rows += [(1000 + k, f"my direct line +1 312 555 {1000 + k} now") for k in range(10)]
    rows += [(1100 + k, f"my direct line 312 556 {1000 + k} now") for k in range(10)]  # half of the values unseen
    rows += [(2000 + k, f"see item code +1 412 555 {1000 + k} here") for k in range(5)]
    rows += [(2100 + k, f"see item code u{k}@example.org here") for k in range(5)]  # labelled of two kinds
    rows += [(2200, "see item code 412 556 1000 here")]
    rows += [(3000 + k, f"read page two +1 512 555 {1000 + k % 2} there") for k in range(50)]  # copies of two values lend no support
    rows += [(3100, "read page two 512 556 1000 there")]
    found = {r["doc_id"]: r["spans"] for r in spans_of(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert {found[100 + k] for k in range(300)} == {"phone:13:25"}
    assert all(found[1100 + k] == "phone:15:27" for k in range(10))
    assert found[2200] == "" and found[3100] == ""


def test_op9_general_patterns(spark):
    """One word, start of text, the word after, glued keys, free slots; far and long contexts."""
    far = "x" * 500 + " "
    rows = [(k, f"Phone: +1 212 555 {1000 + k}") for k in range(20)] + [(100, "Phone: 212 555 0199"), (101, "Zahl: 212 555 0199")]
    rows += [(200 + k, f"{far * (k % 3)}caller +1 212 556 {1000 + k} rang") for k in range(10)] + [(300, f"{far}caller 212 556 0199 rang")]
    rows += [(400 + k, f'it says token = "{0xABCDEF1234 * 16**30 + k:040x}" here') for k in range(6)] + [(500, "and password=ab12cd34ef56ab78 too"), (501, "chapter ab12cd34ef56ab78 too"), (502, "AKIA" + "Z9" * 8 + " alone")]
    rows += [(600, "call 10.0.0.1, 10.0.0.2, 212 555 0199 0000, +1 212 555 4444")]
    found = {r["doc_id"]: r["spans"] for r in spans_of(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert found[100] == "phone:7:19" and found[101] == ""
    assert found[300] == "phone:508:520"
    assert all(found[400 + k] == "secret:17:57" for k in range(6))
    assert found[500] == "secret:13:29" and found[501] == "" and found[502] == "secret:0:20"
    assert found[600].startswith("ip:5:13,ip:15:23,phone:")


def test_op9_many_spans(spark):
    """Starts are right beyond a block of running sums."""
    text = " ".join(f"é10.0.{k % 256}.7 mail{k}@x.org" for k in range(3 * pii.BLOCK + 5))
    got = spans_of(pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got[0]["base"] == ",".join(brute_spans(text))


def test_op9_finds_spans_on_documents(spark, sf):
    """Assignments are learnt from long keys, and found where the key and the length are new."""
    table = "/root/testdata/check_s/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("the larger tables are not here")
    docs = spark.read.parquet(table).select("doc_id", "text").where("text like '%password=%' or text like '%token = %' or text like '%AKIA%' or doc_id % 20 = 0")
    got = pii.find_personal_data(docs).select("doc_id", F.explode("added").alias("x")).select("doc_id", "x.*").join(docs, "doc_id").select("doc_id", "kind", F.expr("substring(text, greatest(s - 8, 1), least(s, 9))").alias("front"), F.expr("substring(text, s + 1, e - s)").alias("v")).collect()
    fronts = Counter(("password=" if r["front"].endswith("password=") else "format") for r in got)
    want = sum(len(re.findall("password=[0-9a-f]+", r["text"])) for r in docs.where("text like '%password=%'").collect())
    assert fronts["password="] == want > 10 and {r["kind"] for r in got} == {"secret"}


def test_op9_redacts(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    text = next(r["text"] for r in out.collect() if r["text"] and r["text"].startswith("mail me"))
    assert text == "mail me: [email], [phone] or [ip], [card]"
    assert out.where("text is null").count() == odd.where("text is null").count()
    clash = odd.select("doc_id", "text", F.lit(5).alias("pii_row"), F.lit("s").alias("PII_SPANS"), F.lit(6).alias("__pii_row"))
    out = pii.redact(clash)
    assert out.columns == clash.columns and {(r["pii_row"], r["PII_SPANS"], r["__pii_row"]) for r in out.collect()} == {(5, "s", 6)}


def test_op9_runs_no_python(odd):
    plan = pii.base_spans(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# -- language model (10) ----------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=120), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_elias_fano(values, asked):
    v = np.array(sorted(values), np.uint64)
    head, *rest = elias_fano.mapped(elias_fano.EliasFano.build(v))
    ef = elias_fano.EliasFano(head.tobytes(), *rest)
    assert ef.at(np.arange(len(v))).tolist() == v.tolist()
    x = np.array([*asked, *values], np.uint64)
    assert ef.successor(x).tolist() == np.searchsorted(v, x).tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 31), max_size=90, unique=True), max_size=40))
def test_elias_fano_pointers(successors):
    """Low parts of five bits, one high part a context: the unary bits are the pointers."""
    v = np.array([k << 5 | x for k, xs in enumerate(successors) for x in sorted(xs)], np.uint64)
    head, *rest = elias_fano.mapped(elias_fano.EliasFano.build(v, 5, len(successors)))
    ef = elias_fano.EliasFano(head.tobytes(), *rest)
    ends = np.cumsum([0, *map(len, successors)])
    first, last = ef.run(np.arange(len(successors)))
    assert first.tolist() == ends[:-1].tolist() and last.tolist() == ends[1:].tolist()
    for k, xs in enumerate(successors):
        want = [ends[k] + sum(y < x for y in xs) for x in range(32)]
        assert ef.within(np.arange(32, dtype=np.uint64), *(np.full(32, e[k]) for e in (first, last))).tolist() == want


def test_columns_round_trip():
    cols = [np.arange(7, dtype=np.uint32), np.zeros(0, np.uint64), np.array([2**63], np.uint64)]
    assert [c.tolist() for c in ef_lm.get(ef_lm.put(*cols))] == [c.tolist() for c in cols]


def brute_lm(rows):
    """rows: (doc_id, words with None as the end, held out) -> (doc_id, held, tokens, known, N), base, score."""
    one, two, three = Counter(), Counter(), Counter()
    for _, w, h in rows:
        if not h:
            s = [0, *w, None]
            one.update(w)
            two.update(zip(s, w))
            three.update(zip(s, w, s[2:]))
    n, v = sum(one.values()), len(one)
    c1, k1, c2, k2 = Counter(), Counter(), Counter(), Counter()
    for (a, _), x in two.items():
        c1[a] += x
        k1[a] += 1
    for (a, b, _), x in three.items():
        c2[a, b] += x
        k2[a, b] += 1
    d2, d3 = ef_lm.DISCOUNTS
    uni = lambda x: (one[x] + 0.1) / (n + 0.1 * (v + 1))
    bi = lambda a, x: (max(two[a, x] - d2, 0) + d2 * k1[a] * uni(x)) / c1[a] if c1[a] else uni(x)
    tri = lambda a, b, x: (max(three[a, b, x] - d3, 0) + d3 * k2[a, b] * bi(b, x)) / c2[a, b] if c2[a, b] else bi(b, x)
    for d, w, h in rows:
        s = [0, *w]
        p = [bi(0, w[0]), *(tri(a, b, x) for a, b, x in zip(s, s[1:], w[1:]))]
        yield (d, h, len(w), sum(x in one for x in w), n), sum(math.log10(uni(x)) for x in w), sum(map(math.log10, p))


def held_tenth():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def lm_rows(df):
    return [(d, [*t.encode().lower().split(), None], d is not None and zlib.crc32(str(d).encode()) % 10 == 0) for d, t in texts(df)]


@pytest.mark.parametrize("shards", [1, 5, 64, 512])
def test_op10_against_brute_force(odd, empty, shards):
    got = ef_lm.score_documents(odd, held_tenth(), shards=shards).collect()
    want = list(brute_lm(lm_rows(odd)))
    for name, base, score in want:
        assert any(tuple(r)[:5] == name and r["base_score"] == pytest.approx(base, abs=1e-6) and abs(r["score"] - score) <= 0.0011 * name[2] for r in got), name
    assert Counter(tuple(r)[:5] for r in got) == Counter(n for n, _, _ in want)
    assert ef_lm.score_documents(empty, held_tenth()).count() == 0


def test_op10_shards_agree(spark, sf):
    """Hot words and pairs are cut over many shards; scores stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.range(10_000, 10_200).select(F.col("id").alias("doc_id"), F.concat(F.lit("of the "), F.concat_ws(" of the ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: (k * F.col("id") % 997).cast("string")))).alias("text")))
    one, *more = ({r["doc_id"]: (r["score"], r["base_score"], r["n_known"], r["train_tokens"], r["n_tokens"]) for r in ef_lm.score_documents(docs, held_tenth(), shards=s).collect()} for s in (1, 64, 512))
    for other in more:
        assert one.keys() == other.keys()
        for d, (score, *exact) in other.items():
            assert exact == pytest.approx(list(one[d][1:]), rel=1e-12) and abs(score - one[d][0]) <= 0.0022 * exact[-1], d
    held = [v for d, v in one.items() if d < 10_000 and zlib.crc32(str(d).encode()) % 10 == 0]
    assert sum(v[0] for v in held) > sum(v[1] for v in held)


def test_op10_blocks_of_any_size():
    block = ef_lm.Block(np.array([3, 1]), np.array([5, 5, 1, 1]), 10)
    assert [(int(u), int(v), int(w)) for u, v, w in zip(block.u[block.pair_of], block.v[block.pair_of], block.w)] == [(0, 1, 1), (0, 5, 5), (5, 1, 1), (5, 5, 1)]
    wide = ef_lm.Block(np.array([3, 1]), np.array([5, 2**22 - 1, 1, 1]), 2**22)
    assert [(int(u), int(v), int(w)) for u, v, w in zip(wide.u[wide.pair_of], wide.v[wide.pair_of], wide.w)] == [(0, 1, 1), (0, 5, 2**22 - 1), (5, 2**22 - 1, 1), (2**22 - 1, 1, 1)]


def test_op10_mass_is_one():
    """Discounted mass and backoff of each context make 1, also where one successor has 20 million."""
    u, v, w, count = [], [], [], []
    for a in range(5):
        for b in range(40):
            for c in range(1 + (a * b) % 7):
                u.append(a), v.append(b), w.append(c + 40), count.append(20_000_000 if (a, b, c) == (1, 6, 0) else 1 + (a + b + c) % 3)
    trie = ef_lm.Trie(*(np.array(x, np.uint32) for x in (u, v, w, count)), 6)
    code3, code2, back2, back1 = trie.answer(*(np.array(x, np.uint64) for x in (range(5),)), np.full(5, 40), np.tile(np.arange(40, dtype=np.uint64), 5), np.full(200, 10), np.tile(np.arange(40, 50, dtype=np.uint64), 200))
    assert np.abs(ef_lm.restore(code3).reshape(200, 10).sum(1) + ef_lm.restore(back2) - 1).max() < 0.0013
    assert np.abs(ef_lm.restore(code2).reshape(5, 40).sum(1) + ef_lm.restore(back1) - 1).max() < 0.0013
    assert trie.edges[0][1] == sum(c for a, c in zip(u, count) if a == 0) and trie.edges[1][2] == 40
    low = np.array([1.0, 1e-3, 1e-9, 1e-20])
    assert np.abs(np.log10(ef_lm.restore(ef_lm.quantise(low)) / low)).max() <= ef_lm.STEP

"""The pipeline's stages and registration."""

from __future__ import annotations

import math
import os
import re
import sys
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.llm import common, queries, toxicity
from brindle.llm.common import tokenizer_path

sys.path.insert(0, os.path.dirname(__file__))
from test_llm_operators import brute_components, brute_spans  # noqa: E402


def test_ten_operators_and_the_pipeline_are_registered():
    known = entry.queries()
    assert {int(n.split("_")[0][2:]) for n in queries.queries()} == set(range(1, 11))
    assert set(queries.queries()) | {"pipeline"} <= known.keys()


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] > 0.8 * sizes[0]


def test_stages_python_steps_give_memory_back(spark, sf, monkeypatch):
    """Workers stay idle beside the next stage, so every step trims its worker when a task ends."""
    calls, steps = [], []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.lean(lambda batches: iter(batches))([1, 2])) == [1, 2] and calls == [1]
    kind = type(spark.range(0))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, plain=kind.mapInArrow, **k: (steps.append(f), plain(self, f, *a, **k))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf)
    assert len(steps) >= 6 and all(hasattr(f, "__wrapped__") for f in steps)


def test_stage_on_odd_rows(spark, sf):
    rows = [(1, "same words here and there", "en", None, 5), (1, "same words here and there", "en", None, 5), (None, "same words here and there", None, "s", None), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted(r["text"] or "" for r in out.collect()) == ["", "", "same words here and there"]
    assert corpus_pipeline.redact_personal_data(spark, docs, sf).count() == 5
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), sf).count() == 0


CLASH = "doc_id long, text string, toxicity string, row int, pii_row int, pii_spans string, score double, node long, component_id long, sequence_id int"


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_tables(spark, tmp_path, stage):
    """Nulls in any column, repeated rows, empty tables, clashing and missing columns, a very long text."""
    spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    name, fn = corpus_pipeline.STAGES[stage]
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, "one two three four five six", "t", 1, 1, "s", 0.5, 1, 1, 1), (2, None, None, None, None, None, None, None, None, None), (None, "seven eight", "t", 2, 2, "s", 0.5, 1, 1, 1), (4, "", "t", 3, 3, "s", 0.5, 1, 1, 1), (5, long, "t", 4, 4, "s", 0.5, 1, 1, 1), (5, "mail a@b.org or +1 212 555 0199", "u", 5, 5, "s", 0.5, 1, 1, 1)]
    docs = spark.createDataFrame(rows, CLASH)
    out = fn(spark, docs, f"file://{tmp_path}")
    if name == "packing":
        assert {r["doc_id"] for r in out.collect()} == {1, 2, None, 4, 5}
    else:
        assert out.columns == docs.columns and out.schema == docs.schema
        got = out.collect()
        assert len(got) == 6 and [r for r in map(tuple, got) if r[0] == 2] == [rows[1]]
        assert sorted(r["row"] or 0 for r in got) == [0, 1, 2, 3, 4, 5]
    assert fn(spark, docs.limit(0), f"file://{tmp_path}").count() == 0


def test_near_copies_keep_the_least_doc_id(spark, sf):
    text = "a line that three documents have in common, word for word"
    docs = spark.createDataFrame([(7, text, "b"), (3, text, "a"), (3, text, "c"), (9, "x y", "d"), (None, text, "e")], "doc_id long, text string, lang string").repartition(4)
    out = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(3, text), (9, "x y")]


def test_run_against_its_stages_done_plainly(spark, sf):
    """The whole run, each stage replaced by a plain version of its decisions."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    at, w, bias = toxicity.train(frame, labels, ~toxicity.held_out(F.col("doc_id"), 4, 2))
    weight, hasher = dict(zip(at.tolist(), w.tolist())), toxicity.Hasher()
    score = lambda t: 1 / (1 + math.exp(-(bias + sum(weight.get(x, 0.0) for x in set(hasher.features(t).tolist())))))
    docs = [d for d in docs if score(d["text"] or "") < 0.3]
    found = brute_components([(d["doc_id"], d["text"] or "") for d in docs], 5, 80)
    stay = {d for d, _, _, kept in found if kept}
    docs = [d for d in docs if d["doc_id"] in stay]
    library, pieces = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
    for d in docs:
        spans, text, done = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in plain_spans(d["text"]))), "", 0
        for a, b, k in spans:
            if a >= done:
                text += d["text"][done:a] + f"[{k}]"
            done = max(done, b)
        ids = np.array(library.encode(text + d["text"][done:], add_special_tokens=False).ids + [1], "<u4")
        pieces.update((d["doc_id"], k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()), len(ids)) for k in range(0, len(ids), 2048))
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == pieces


def plain_spans(text):
    secrets = [f"secret:{m.start()}:{m.end()}" for m in re.finditer(r"(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,})(?![0-9A-Za-z_-])", text)]
    return brute_spans(text) + secrets


def test_run_leaves_one_table(spark, sf):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, sf)
    assert len(set(os.listdir(folder)) - before) == 1


def test_run_gives_pieces(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"

"""Language ID: held-out accuracy, defined cases, and the optimiser."""

import os

import numpy as np
import pytest

from kinfold.llm import op5_language_id as op

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = op.query(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_defined_cases(spark):
    rows = [(i, t, lang, 0) for i, (t, lang) in enumerate([("the cat sat", "en"), ("der hund lief", "de"), ("the dog ran", "en"), ("die katze sass", "de")] * 10)]
    rows += [(100, None, "en", 0), (101, "", None, 0), (102, "123 !?", "en", 0), (None, "the cat", "en", 0), (103, "the " * 50_000, None, 0), (1, "der hund lief", "de", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = op.train(docs)
    got = op.predict(docs, model).collect()
    assert len(got) == len(rows) and model["langs"] == ["de", "en"]
    assert [r["lang_pred"] for r in got if r["doc_id"] in (100, 101, 102)] == ["und"] * 3
    assert all(r["lang_pred"] == "en" for r in got if r["doc_id"] in (0, 103, None))
    empty = op.predict(docs, op.train(docs.limit(0)))
    assert {r["lang_pred"] for r in empty.collect()} == {"und"}
    assert op.predict(docs.limit(0), model).collect() == []


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 10 + rng.integers(200)]), np.array([0.9, 0.4]), y) for y in rng.integers(0, 3, 300)]
    w = op.fit_ftrl(rows, 3)
    assert all((x @ w[at]).argmax() == y for at, x, y in rows)
    assert (w == 0).mean() > 0.9


def test_temperature_cools_overconfident_scores():
    rng = np.random.default_rng(0)
    scores = [(np.array([8.0, 0.0]), int(rng.random() < 0.3)) for _ in range(400)]
    assert op.fit_temperature(scores) > 5

"""Co-training: accuracy against labels and defined cases."""

import os

import numpy as np
import pytest

from kinfold.llm import op4_co_training as op

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_accuracy_on_labels_left_out_and_the_exchange(spark):
    """Every fifth label is left out of fitting; without the exchange other models come out."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    seen = op.stored(op.views(docs))
    model = op.train(seen, labels.where("doc_id % 5 <> 0"))
    alone = op.train(seen, labels.where("doc_id % 5 <> 0"), rounds=0)
    for view in ("content", "metadata"):
        assert np.abs(model[view] - alone[view]).max() > 1e-3
    rows = op.score(seen, model).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    good, bad = ([r["keep"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(bad) >= 5 and np.mean(good) > 0.97 and np.mean(bad) < 0.15


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    rows = op.query(spark, DATA).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["keep"] for r in good]) > 0.98 and np.mean([r["keep"] for r in bad]) < 0.1


def test_share_of_short_words_is_of_all_words():
    at = 6 + len(op.SIGNS) + 9
    for n, every in ((300, 3), (600, 3), (1200, 6), (4000, 20)):
        text = " ".join("ab" if i % every == 0 else "longer" for i in range(n))
        assert op.content_view(text)[at] == pytest.approx(1 / every, abs=1e-3)


def test_defined_cases(spark):
    good = [(i, "A plain sentence of words, and then some more of them.", "a", "en", 54) for i in range(40)]
    bad = [(100 + i, "BUY!! NOW!! BUY!! NOW!! $$$ %%% " * 3, "b", "en", 90) for i in range(40)]
    odd = [(200, None, None, None, None), (201, "", "a", "en", 0), (None, "x", "a", None, 1), (202, "word " * 40_000, "a", "en", 200_000), (1, "A plain sentence of words.", "a", "en", 26)]
    docs = spark.createDataFrame([(*r, 0.5) for r in good + bad + odd], "doc_id long, text string, source string, lang string, n_chars long, score double")
    labels = spark.createDataFrame([(r[0], 1, 9) for r in good] + [(r[0], 0, 9) for r in bad] + [(None, 1, 9), (5, None, 9), (999, 1, 9)], "doc_id long, quality int, keep int")
    got = op.classify(docs, labels).collect()
    assert len(got) == len(good + bad + odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["keep"] == (r["doc_id"] < 100) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert {r["score"] for r in op.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in op.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert op.classify(docs.limit(0), labels).collect() == []

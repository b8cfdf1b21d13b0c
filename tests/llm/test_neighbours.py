"""Nearest neighbours against brute force."""

import os

import numpy as np
import pytest

from kinfold.llm import op3_balanced_postings as op

DATA = "/root/testdata/sf0.1"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        out[ids[q]] = sorted((d[i], ids[i]) for i in range(len(ids)) if i != q)[:k]
    return out


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, [i for i, k in enumerate(ids) if k % 100 == 0], 10)
    got = op.query(spark, DATA).collect()
    assert len(got) == 10 * len(want)
    hits = sum(r["vec_id"] in {k for _, k in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * len(got)
    place = {k: i for i, k in enumerate(ids)}
    for r in got:
        assert r["score"] == pytest.approx(np.sqrt(((x[place[r["vec_id"]]] - x[place[r["query_id"]]]) ** 2).sum()), abs=1e-12)


def scanned(x, k=10):
    """Recall, share of all vectors that queries scan, and copies a vector, by the module's own parts."""
    graph = op.Graph(op.balanced(x, max(1, len(x) // (len(x) // 32))))
    prune = op.tuned(graph, x, k)
    lists = {}
    for row, at in op._lists(graph, x):
        lists.setdefault(at, []).append(row)
    sizes = np.array([len(lists.get(i, ())) for i in range(len(graph.x))])
    hits = work = 0
    asked = range(0, len(x), 20)
    for q in asked:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        found = [lists.get(at, []) for _, at in op._probes(graph, x[[q]], prune, sizes, 1)]
        work += sum(map(len, found))
        hits += len({*np.argsort(d)[:k].tolist()} & {r for f in found for r in f})
    return hits / k / len(asked), work / len(asked) / len(x), sizes.sum() / len(x) - 1


def test_lists_select_on_clustered_vectors():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 24)), 70, 0) + 0.35 * rng.normal(size=(4200, 24))
    recall, share, copies = scanned(x)
    assert recall >= 0.9 and share < 0.15 and copies > 0.05, (recall, share, copies)


def test_uniform_vectors_are_the_hard_case():
    recall, share, _ = scanned(np.random.default_rng(5).normal(size=(4000, 24)))
    assert recall >= 0.9 and share < 0.75, (recall, share)


def test_the_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(6)
    graph = op.Graph(rng.normal(size=(700, 12)))
    q = rng.normal(size=(80, 12))
    at, d = graph.search(q, 24)
    full = op.distances(q, graph.x)
    assert (np.diff(d) >= 0).all() and np.allclose(np.take_along_axis(full, at, 1), d)
    assert np.mean([len({*a.tolist()} & {*np.argsort(f)[:10].tolist()}) for a, f in zip(at, full)]) >= 9.5


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    monkeypatch.setattr(op, "QUERIES", 2)
    rng = np.random.default_rng(1)
    x = [rng.normal(size=8) for _ in range(150)] + [np.ones(8)] * 60 + [np.ones(8) * 2] * 3
    rows = [(i * 10, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5100, [0.0] * 8, 1), (5200, [None] * 8, 1), (5300, [float("nan")] * 8, 1), (5400, [1.0], 1), (None, [1.0] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = op.search(frame, frame.where("vec_id % 100 = 0"), prune=50.0).collect()
    want = brute([i * 10 for i in range(len(x))], np.array(x), range(0, len(x), 10), 10)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, i + 1, k) for q, found in want.items() for i, (_, k) in enumerate(found)}


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in sorted(op.search(frame, frame.where("vec_id = 100")).collect(), key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert op.search(frame.limit(0), frame.limit(0)).collect() == []
    assert op.search(frame.where("vec_id = 100"), frame.where("vec_id = 100")).collect() == []

"""Embedding near duplicates against all pairs."""

import numpy as np

from kinfold.llm import op9_cross_polytope as op


def brute(rows, threshold):
    good = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in good:
        for j in good:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 24)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=32)
        rows += [(centre + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.15, 0.6]), int(rng.integers(2))) for _ in range(12)]
    hub = rng.normal(size=32)
    rows += [(hub + rng.normal(size=32) * 0.05, 1) for _ in range(80)]
    rows += [(rows[0][0], rows[0][1])] * 15 + [(rows[0][0] * 3, rows[0][1]), (rows[0][0], None), (rows[0][0][:16], 0), (rows[0][0][:16] * 1.0001, 0)]
    rows = [[i * 3, v.tolist(), y] for i, (v, y) in enumerate(rows)]
    rows += [[2000, None, 1], [2001, [0.0] * 32, 1], [2002, [float("nan")] * 32, 1], [2003, [None] * 32, 1], [2004, [], 1], [2005, [float("inf")] + [0.0] * 31, 1]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in op.near_duplicates(frame).collect())
    want = brute(rows, op.THRESHOLD)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert [r[0] for r in got] == [r[0] for r in want] and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert found >= 0.97 * there
    assert op.near_duplicates(frame.limit(0)).collect() == []


def test_rotation_keeps_lengths_and_dot_products():
    x = np.random.default_rng(0).normal(size=(5, 20))
    y = op.rotations(x, 3, 9)
    assert np.allclose(x @ x.T, y @ y.T)


def test_planted_pairs_are_found():
    """Pairs at a cosine of 0.93 to 0.98 share a bucket and pass by their sketches."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.93, 0.98, 3000)[:, None]
    (a, s), (b, t) = op.hashes(x), op.hashes(cosine * x + np.sqrt(1 - cosine**2) * side)
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    near = np.bitwise_count(s ^ t).sum(1) <= op.most_bits(op.THRESHOLD, 256)
    assert met.mean() > 0.995 and near.all()
    apart = np.bitwise_count(s[1:] ^ s[:-1]).sum(1) <= op.most_bits(op.THRESHOLD, 256)
    assert not apart.any()


def test_odd_ids_and_clashing_names(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(None, v, 1, 7, 7, 7), (None, [2.0 * x for x in v], 1, 7, 7, 7), (5, v, 1, 7, 7, 7), (5, v, 1, 7, 7, 7), (6, [4.0, -3.0, 2.0, -1.0], 1, 7, 7, 7), (None, None, 1, 7, 7, 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cid int, v int, n int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], bool(r["kept"])) for r in op.near_duplicates(frame).collect())
    assert [g[:2] for g in got] == [(0, 0), (0, 3), (0, 3), (5, 3), (5, 3), (6, 0)]
    assert {g[2] for g in got if g[1] == 3} == {5} and got[-1] == (6, 0, 6, True)

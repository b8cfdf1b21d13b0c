"""The n-gram join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinfold.llm import op1_prefix_order_join as op


def sets_of(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def brute(ids, texts, words, percent):
    sets = sets_of(texts, words)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        g = find(i)
        if k is not None:
            least[g] = min(k, least.get(g, k))
    return sorted(((k is None, k or 0), len(s), least.get(find(i), k)) for i, (k, s) in enumerate(zip(ids, sets, strict=True)))


def corpus(rng, n):
    vocabulary = [f"W{i}" for i in range(400)]
    line = rng.choices(vocabulary, k=14)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            w = (rng.choice(texts) or "a").split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(" ".join([*line, *rng.choices(vocabulary, k=rng.randrange(0, 9))]))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 40, 90, 200]))))
    return texts


@pytest.mark.parametrize(("words", "percent", "seed"), [(4, 85, 1), (2, 60, 3)])
def test_equals_all_pairs(spark, monkeypatch, words, percent, seed):
    monkeypatch.setattr(op, "BLOCK", 8)
    rng = random.Random(seed)
    texts = corpus(rng, 260)
    base = " ".join(rng.choices([f"q{i}" for i in range(900)], k=120)).split()
    for i in range(60):  # a group of near copies
        w = list(base)
        w[i * 2] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n", "one", "One", "one two three", "ONE two three", "É é", "é é", "x" * 40_000, "a " * 20_000] + ["copy of a text that is here often"] * 30
    ids = [i * 7 % 10_007 for i in range(len(texts))]
    ids[5] = ids[6] = None
    ids[9] = ids[10]
    docs = spark.createDataFrame([(k, t, 0, "k") for k, t in zip(ids, texts, strict=True)], "doc_id long, text string, n int, key string").repartition(3)
    got = op.near_duplicates(docs, words, percent).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in got) == brute(ids, texts, words, percent)


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefix_lengths_are_safe():
    for percent in (60, 80, 85, 90):
        limit = op.Threshold(percent)
        for n in range(1, 400):
            for k in range(limit.overlap(n), n + 1):
                least = min(limit.shared(n), limit.shared(k))
                assert limit.prefix(n) - limit.posted(n) + 1 <= least and limit.prefix(k) - limit.posted(k) + 1 <= least


def test_parity_never_refutes_a_linked_pair():
    rng = random.Random(0)
    for _ in range(300):
        a = {rng.getrandbits(60) for _ in range(rng.randrange(1, 900))}
        b = set(list(a)[: rng.randrange(1, len(a) + 1)]) | {rng.getrandbits(60) for _ in range(rng.randrange(0, 90))}
        x, y = (op.parity(op.np.array(sorted(s), op.np.int64))[None] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        assert op.np.bitwise_count(op.folded(x, width) ^ op.folded(y, width)).sum() <= len(a ^ b)


def test_spanning_joins_what_edges_join():
    rng = op.np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 120))))
        label = op.np.arange(n)
        taken = op.spanning(label, label[a], label[b], rng.integers(0, 5, len(a)))
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for k in taken:  # every edge taken joins two components
            assert find(a[k]) != find(b[k])
            parent[find(a[k])] = find(b[k])
        assert all(find(x) == find(y) for x, y in zip(a, b)) and len({*label.tolist()}) == len({find(x) for x in range(n)})


def test_no_step_makes_more_rows_than_postings(spark, monkeypatch):
    """Each step's rows on one group whose members are alike and only partly linked."""
    made = {}

    def counted(name):
        real = getattr(op, name)

        def run(*given):
            out = op.stored(real(*given))
            made[name] = made.get(name, 0) + out.count()
            return out

        monkeypatch.setattr(op, name, run)

    for name in ("likely", "still_open", "certain", "verify"):
        counted(name)
    size, limit = 400, op.Threshold(75)
    rng = random.Random(size)
    base = [f"q{i}" for i in range(60)]
    texts = []
    for i in range(size):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(60)] = f"e{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [((False, r["doc_id"]), r["n_shingles"], r["component_id"]) for r in op.near_duplicates(docs, 5, 75).collect()]
    assert sorted(got) == brute(list(range(size)), texts, 5, 75)
    postings = sum(limit.posted(r[1]) for r in got)
    assert {"likely", "still_open", "certain"} <= set(made) and all(n <= postings for n in made.values()), (made, postings)


def test_sets_that_no_pair_asks_for_are_not_shuffled(spark):
    sets = spark.range(4000).select(F.col("id").alias("key"), F.lit(1).alias("n"))
    keys = spark.createDataFrame([(k,) for k in (0, 7, 7, 1234, 3999)], "key long")
    found = op.asked(sets, keys)
    got = {r["key"] for r in found.collect()}
    assert {0, 7, 1234, 3999} <= got and len(got) < 40 and found.columns == sets.columns
    assert op.asked(sets, keys.where("key < 0")).count() == 0
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_lists_with_the_same_keys_are_carried_once(spark):
    rows = [(t, k, k // 2) for t, keys in enumerate([(1, 2, 9), (9, 2, 1), (1, 2), (2, 3), (2, 3), (5,), (1, 2, 9), (1, 2, 8)]) for k in keys]
    left = spark.createDataFrame(rows, "tok long, key long, c long")
    assert {r["tok"] for r in op.lists_once(left, "key").collect()} == {0, 2, 3, 7}
    assert sorted(map(tuple, op.lists_once(left, "c").collect())) == sorted(r for r in rows if r[0] in (0, 2, 7))


def test_postings_are_shuffled_once_by_token(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(op, "stored", seen)
    texts = ["a b c d e f g", "a b c d e f h", "a b c d e f g", "p q r s t u v", "one", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = op.signatures(docs, 3, 60)
    got = op.postings(signed).collect()
    assert plans[0].count("hashpartitioning(tok") == 1
    keys = {r["doc_id"]: r["key"] for r in signed.collect()}
    assert {r["key"] for r in got} == {keys[0], keys[1]} and keys[0] == keys[2]


def test_lists_that_hold_much_the_same_keys_are_made_one(spark):
    rng = random.Random(3)
    lists = [sorted(rng.sample(range(60), 57)) for _ in range(80)] + [sorted(rng.sample(range(100, 4000), rng.randrange(2, 9))) for _ in range(60)]
    rows = [(t, k, k // 2) for t, keys in enumerate(lists) for k in keys]
    got = {}
    for r in op.lists_merged(spark.createDataFrame(rows, "tok long, key long, c long")).collect():
        assert r["c"] == r["key"] // 2
        got.setdefault(r["tok"], []).append(r["key"])
    assert all(len(keys) == len(set(keys)) for keys in got.values())
    assert all(any(set(keys) <= set(union) for union in got.values()) for keys in lists)
    assert sum(map(len, got.values())) < len(rows) / 4


def test_rows_that_no_key_asks_for_are_spared(spark):
    rows = spark.range(4000).select(F.struct(F.col("id").alias("x"), (F.col("id") * 3).alias("y")).alias("row"), F.lit("t").alias("_slot"), F.lit(1).alias("a`b"))
    keys = rows.where("row.x in (0, 7, 3999)").select("row")
    spared, hit = op.split(rows, "row", keys.unionByName(keys))
    left, taken = [{r["row"]["x"] for r in x.collect()} for x in (spared, hit)]
    assert left | taken == set(range(4000)) and not left & taken and {0, 7, 3999} <= taken and len(taken) < 40
    assert spared.columns == hit.columns == rows.columns and spared.count() + hit.count() == 4000
    assert op.split(rows, "row", keys.limit(0))[0].count() == 4000

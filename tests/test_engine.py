"""The engine on hand-checked inputs, and its queries against DuckDB."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.bits import prefix_length, radius
from kinfold.operators import cover, digests, perceptual, predicates, similarity
from kinfold.params import InvalidSearch, SearchParameters, validate
from kinfold.plans import catalogue, search
from kinfold.sources import files as sources
from kinfold.sources.cache import HashCache, probe

DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    table = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")
    return table.withColumn("size", F.coalesce(F.length("content"), F.lit(0)).cast("long"))


def test_prefix_length(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 10, 11, 100)], "n long").select(prefix_length("n").alias("p")).collect()
    assert [r["p"] for r in got] == [0, 1, 1, 2, 10]


def test_extension_lists(spark):
    rows = frame(spark, [("x/a.JPG", b"1"), ("x/b.png", b"22"), ("x.y/c", b"333")])
    pick = lambda **k: sorted(r["path"] for r in predicates.select_files(rows, SearchParameters(**k)).collect())
    assert pick(included_file_types=["jpg"]) == ["x/a.JPG"]
    assert pick(included_file_types=[".jpg", "PNG"], excluded_file_types=["png"]) == ["x/a.JPG"]
    assert pick(excluded_file_types=["png"]) == ["x.y/c", "x/a.JPG"]
    assert pick(min_size=2, max_size=2) == ["x/b.png"]
    assert [(r["name"], r["type"]) for r in predicates.file_row(rows).collect()] == [("a.JPG", ".JPG"), ("b.png", ".png"), ("c", "")]


def test_exact_groups(spark):
    same = b"a" * 20
    rows = frame(spark, [("a", b"x"), ("b", b"x"), ("c", b"y"), ("d", same), ("e", b"aa" + b"b" * 18), ("f", None), ("g", b"")])
    ok, errors = predicates.split_readable(rows)
    assert errors.count() == 2
    assert digests.shared(digests.partial_digests(ok), "partial").count() == 2
    assert [(r["n"], r["first_path"]) for r in digests.duplicate_groups(ok).collect()] == [(2, "a")]
    more = rows.unionByName(frame(spark, [("h", b"x")]))
    assert [r["n"] for r in digests.duplicate_groups(more.where("size > 0")).collect()] == [3]


def test_difference_hash(spark):
    def bits(px, **k):
        return spark.createDataFrame([(px,)], "p array<int>").select(perceptual.difference_bits("p", **k).alias("b")).first()["b"]

    assert all(bits(list(range(72)))) and not any(bits([7] * 72)) and bits([1] * 71) is None
    crossing = bits(list(range(9)) * 8)
    assert [i for i, b in enumerate(crossing) if not b] == [8, 17, 26, 35, 44, 53, 62]
    assert all(bits(list(range(9)) * 8, textbook=True))


def test_block_mean_and_perceptual_hash():
    flat = perceptual.block_mean_bits(np.full((256, 256), 255, np.uint8))
    assert flat[:900].all() and not flat[900:].any()
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (256, 256)).astype(np.uint8)
    want = [image[y : y + 16, x : x + 16].mean() >= image.mean() for y in range(0, 240, 8) for x in range(0, 240, 8)]
    assert perceptual.block_mean_bits(image)[:900].tolist() == want
    small = rng.integers(0, 256, (32, 32))
    k, i = np.arange(32)[:, None], np.arange(32)[None]
    dct = np.cos((2 * i + 1) * k * np.pi / 64)
    low = (dct @ small @ dct.T)[:8, :8] * np.outer([2**-0.5] + [1] * 7, [2**-0.5] + [1] * 7)
    low[0, 0] = 0
    assert perceptual.perceptual_bits(small).tolist() == (low > low.mean()).ravel().tolist()


@pytest.mark.parametrize("distance", [2, 5, 20])
def test_band_and_block_join_equal_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(2**62), 2**62, 40)
    values = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 8), replace=False)) for b in base for _ in range(4)]
    got = similarity.pairs_within(spark.createDataFrame(list(enumerate(values)), "id long, hash long"), distance).collect()
    want = {(i, j, d) for j in range(len(values)) for i in range(j) if (d := bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1")) <= distance}
    assert {tuple(r) for r in got} == want and radius(4) == radius(5) == 2


def test_star_cover(spark):
    near = {1: [1, 2], 2: [1, 2, 3], 3: [2, 3]}
    assert cover.greedy([1, 2, 3], near, {}) == [(1, 1), (1, 2), (2, 2), (2, 3)]
    # p - u - v in the order p, v, u: the lone v is passed over, and evicted where asked.
    assert cover.greedy([1, 2, 3], {1: [1, 3], 2: [2], 3: [1, 2, 3]}, {}) == [(1, 1), (1, 3), (3, 2), (3, 3)]
    assert cover.greedy([1, 2, 3], {1: [1, 3], 2: [2], 3: [1, 2, 3]}, {}, evict=True) == [(1, 1), (1, 3), (3, 3)]
    path = {1: [1, 2], 3: [2, 3], 2: [1, 2, 3]}
    assert cover.greedy([5], {5: [5]}, {5: 2}) == [(5, 5)] and cover.greedy([5], {5: [5]}, {5: 1}) == []
    edges = spark.createDataFrame([(a, b) for a, n in path.items() for b in n], "src long, dst long")
    got = cover.star_cover(edges, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, copies long")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (1, 2), (2, 2), (2, 3)]


def test_validation():
    assert set(validate(SearchParameters())) == {"folders", "fileSearchType"}
    bad = SearchParameters(folders=["a"], file_search_type="Images", degree_of_similarity=65, perceptual_hash_algorithm="DifferenceHash", min_size=5, max_size=4)
    assert set(validate(bad)) == {"degreeOfSimilarity", "minSize", "maxSize"}
    assert not validate(SearchParameters(folders=["a"], file_search_type="Images", degree_of_similarity=256, perceptual_hash_algorithm="BlockMeanHash"))
    with pytest.raises(InvalidSearch):
        search.find_duplicates(None, bad)


def test_files_and_sniffing(spark, tmp_path):
    for name, content in [("a.txt", b"same"), (".hidden", b"same"), ("empty", b""), ("sub/b.png", b"\x89PNG\r\n\x1a\n" + b"0" * 40), ("sub/c.gif", b"GIF89a" + b"\x21\xf9\x04" * 2 + b"0" * 9)]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    listed, errors = sources.listing(spark, [str(tmp_path), str(tmp_path), str(tmp_path / "none")])
    rows = sources.with_content(listed)
    assert rows.count() == 5 and len(errors) == 1
    kinds = {r["path"].split("/")[-1]: r["k"] for r in rows.where("size > 0").select("path", sources.sniffed().alias("k")).collect()}
    assert kinds == {"a.txt": "CorruptUnknownOrUnsupported", ".hidden": "CorruptUnknownOrUnsupported", "b.png": "Image", "c.gif": "Animation"}
    found = search.find_duplicates(rows, SearchParameters(folders=[str(tmp_path)], file_search_type="All"))
    assert sorted(r["name"] for r in found.collect()) == [".hidden", "a.txt"]
    assert search.to_response(found).count() == 1
    assert sources.scan(spark, [str(tmp_path)]).where("size > 4").count() == 2


def test_cache_makes_the_second_run_equal(spark, tmp_path):
    cache = HashCache(spark, str(tmp_path / "cache"))
    assert not cache.exists()
    rows = frame(spark, [(f"p{i}", bytes([i % 7 * 3, i, i * 5 % 256]) * 30) for i in range(20)])
    rows = rows.withColumn("pixels", perceptual.once(perceptual.byte_image("content", 72)))
    p = SearchParameters(folders=["x"], file_search_type="Images", perceptual_hash_algorithm="DifferenceHash", degree_of_similarity=12)
    plain = sorted(tuple(r) for r in search.find_duplicates(rows, p).collect())
    first = sorted(tuple(r) for r in search.find_duplicates(rows, p, cache).collect())
    second = sorted(tuple(r) for r in search.find_duplicates(rows, p, cache).collect())
    assert plain == first == second and plain and cache.exists()
    assert probe(cache.hashes("DifferenceHash").select("id"), cache.hashes("DifferenceHash")).where("not hit").count() == 0


@pytest.mark.parametrize("algorithm, side, degree", [("PerceptualHash", 32, 20), ("BlockMeanHash", 256, 40), ("BlockMeanHash", 256, 256)])
def test_image_search_uses_the_algorithm_asked(spark, tmp_path, algorithm, side, degree):
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 256, (side, side)) for _ in range(4)]
    images = [np.clip(b + rng.integers(-3, 4, b.shape), 0, 255).astype(np.uint8) for b in base for _ in range(3)]
    make = perceptual.perceptual_bits if algorithm == "PerceptualHash" else perceptual.block_mean_bits
    bits = [make(i) for i in images]
    want = {(a, b, int((bits[a] != bits[b]).sum())) for b in range(12) for a in range(b) if (bits[a] != bits[b]).sum() <= degree // 2}
    px = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(images)] + [(99, bytearray(b"short"))], "id long, pixels binary")
    hashes = perceptual.packed(px, algorithm, "id").where("hash is not null")
    assert {tuple(r) for r in similarity.pairs_within(hashes, degree // 2, perceptual.BITS[algorithm]).collect()} == want and len(want) >= 12
    rows = px.where("id < 99").select(F.col("id").cast("string").alias("path"), "pixels", F.col("pixels").alias("content"), F.length("pixels").cast("long").alias("size"))
    p = SearchParameters(folders=["x"], file_search_type="Images", perceptual_hash_algorithm=algorithm, degree_of_similarity=degree)
    cache = HashCache(spark, str(tmp_path / "cache"))
    plain, first, second = (sorted(tuple(r) for r in search.find_duplicates(rows, p, c).collect()) for c in (None, cache, cache))
    assert plain == first == second and len({r[1] for r in plain}) == 12
    assert cache.hashes(algorithm).count() == 12 and cache.hashes("DifferenceHash").count() == 0


def test_stream_keeps_first_contents(spark, tmp_path):
    from kinfold.streaming.ingest import first_seen

    frame(spark, [("a", b"x"), ("b", b"x"), ("c", b"y")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content binary, size long").parquet(str(tmp_path / "in"))
    query = first_seen(stream).writeStream.format("memory").queryName("first_seen").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("first_seen").count() == 2


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", ["filter_conjunction", "file_dto_projection", "exact_duplicate_groups", "last_in_group_flag", "hamming_pairs", "topk_neighbours", "difference_hash", "perceptual_hash", "star_cover_groups", "search_all"])
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalogue.queries()[name](spark, DATA)
    order = sorted(got.columns)
    want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(names) == order
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, (tuple(r[names.index(c)] for c in order) for r in want)))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.exists(DATA):
        assert entry.entry(spark).count() == 10


def test_duplicate_files_reads_a_tenth_first_and_whole_candidates(spark, tmp_path):
    for name, data in {"a": b"x" * 300_000, "b": b"x" * 300_000, "c": b"x" * 200_000 + b"y" * 100_000, "d": b"z", "e": b"z", "f": b""}.items():
        (tmp_path / name).write_bytes(data)
    files, errors = sources.listing(spark, [str(tmp_path)])
    got = sorted((r["path"][-1], r["size"]) for r in sources.duplicate_files(files).collect())
    assert got == [("a", 300_000), ("b", 300_000), ("d", 1), ("e", 1)] and not errors
    assert sources._digest(str(tmp_path / "c"), 30_000) == sources._digest(str(tmp_path / "a"), 30_000)


def test_moving_images_are_found_in_the_whole_content_and_other_kinds_are_errors(spark):
    frame = b"!\xf9\x04" + b"\0" * 9000
    contents = {"still.gif": b"GIF89a" + frame, "moving.gif": b"GIF89a" + frame + frame, "late.png": b"\x89PNG\r\n\x1a\n" + b"\0" * 9000 + b"acTL", "plain.png": b"\x89PNG\r\n\x1a\n" + b"\0" * 9000, "text.png": b"no image"}
    rows = spark.createDataFrame([(k, bytearray(v), len(v)) for k, v in contents.items()], "path string, content binary, size long").withColumn("kind", sources.sniffed())
    images, _ = predicates.split_images(rows)
    assert sorted(r["path"] for r in images.collect()) == ["plain.png", "still.gif"]
    p = SearchParameters(folders=["*"], file_search_type="Images", perceptual_hash_algorithm="DifferenceHash", degree_of_similarity=2)
    assert [("text.png" in r["result"], r["type"]) for r in search.errors(rows, p).collect()] == [(True, "Exception")]


def test_image_search_moves_hashes_not_pixels_and_finds_pairs_in_hot_bands(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, 3).tolist()) for _ in range(60)] + [b"one %d" % i * 40 for i in range(20)] + [b"copy"] * 3
    bits = {t: perceptual.block_mean_bits(perceptual._stretched(t, 65536).reshape(256, 256)) for t in set(texts)}
    rows = spark.createDataFrame([(f"p{i}", bytearray(t), len(t)) for i, t in enumerate(texts)], "path string, content binary, size long")
    hashes = perceptual.packed(rows.withColumn("id", F.xxhash64("content")), "BlockMeanHash", "id", "content", stretched=True).distinct()
    name = {r["id"]: bytes(r["content"]) for r in rows.select("content", F.xxhash64("content").alias("id")).collect()}
    for distance in (12, 128):
        got = similarity.pairs_within(hashes, distance, 961)
        want = {frozenset((a, b)): int((bits[a] != bits[b]).sum()) for a in bits for b in bits if a < b and (bits[a] != bits[b]).sum() <= distance}
        found = [(frozenset((name[r["src"]], name[r["dst"]])), r["distance"]) for r in got.collect()]
        assert dict(found) == want and len(found) == len(want) > 20
    p = SearchParameters(folders=["x"], file_search_type="Images", perceptual_hash_algorithm="BlockMeanHash", degree_of_similarity=24)
    found = search.find_duplicates(rows, p, stretched=True)
    assert {"p80", "p81", "p82"} <= {r["path"] for r in found.collect()}
    pixels = rows.withColumn("pixels", F.col("content"))
    assert sorted(map(tuple, search.find_duplicates(pixels, p, stretched=True).collect())) == sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("algorithm, degree", [("BlockMeanHash", 24), ("BlockMeanHash", 200), ("PerceptualHash", 6), ("DifferenceHash", 20)])
def test_image_search_takes_all_neighbours_not_the_best_hundred(spark, monkeypatch, tmp_path, algorithm, degree):
    monkeypatch.setattr(similarity, "BLOCK", 30)
    rng = np.random.default_rng(5)
    texts = []
    for n in (160, 12, 12, 12):
        base = rng.integers(0, 256, 1024)
        for k in range(n):
            changed = base.copy()
            changed[rng.integers(0, 1024)] = rng.integers(0, 256)
            texts += [changed.astype(np.uint8).tobytes()] * (1 + k % 5 // 4)
    texts += [rng.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in rng.integers(3, 6, 40)]
    rows = spark.createDataFrame([(f"p{i}", bytearray(t), len(t)) for i, t in enumerate(texts)], "path string, content binary, size long")
    of = {r["path"]: r["id"] for r in rows.select("path", F.xxhash64(F.sha2("content", 256)).alias("id")).collect()}
    stretched = {of[f"p{i}"]: perceptual._stretched(t, perceptual.PIXELS[algorithm]) for i, t in enumerate(texts)}
    make = {"BlockMeanHash": lambda p: perceptual.block_mean_bits(p.reshape(256, 256)), "PerceptualHash": lambda p: perceptual.perceptual_bits(p.reshape(32, 32)), "DifferenceHash": lambda p: p[:64] < p[1:65]}[algorithm]
    ids = sorted(stretched)
    bits = np.array([make(stretched[i]) for i in ids])
    within = (bits[:, None] != bits[None]).sum(2) <= degree // 2
    near = {i: [ids[k] for k in np.flatnonzero(w)] for i, w in zip(ids, within)}
    copies = {i: sum(v == i for v in of.values()) for i in ids}
    assert within.sum(1).max() > 100 and len(np.unique(bits, axis=0)) > 20
    p = SearchParameters(folders=["x"], file_search_type="Images", perceptual_hash_algorithm=algorithm, degree_of_similarity=degree)
    cache = HashCache(spark, str(tmp_path / "cache"))
    for evict, kept in ((False, None), (True, None), (False, cache), (True, cache)):
        groups = {}
        for g, m in cover.greedy(ids, near, copies, evict):
            groups.setdefault(g, []).extend(k for k, v in of.items() if v == m)
        want = sorted((g, path) for g, paths in groups.items() if len(paths) > 1 for path in paths)
        assert sorted(map(tuple, search.similar_images(rows, p, kept, evict, stretched=True).collect())) == want


def test_stars_are_the_groups_of_the_walk(spark):
    rng = np.random.default_rng(6)
    for share in (0.005, 0.02, 0.1):
        n = 150
        edge = np.triu(rng.random((n, n)) < share, 1)
        edge |= edge.T | np.eye(n, dtype=bool)
        near = {i: np.flatnonzero(edge[i]).tolist() for i in range(n)}
        copies = {i: int(c) for i, c in enumerate(rng.integers(1, 8, n) // 7 + 1)}
        nodes = spark.createDataFrame([(i, copies[i], min((k for k in near[i] if k != i), default=None)) for i in range(n)], "id long, copies long, near long")
        got = cover.stars(nodes).collect()
        assert sorted((r["group_id"], r["member"]) for r in got) == cover.greedy(list(range(n)), near, copies)
        assert sorted((r["group_id"], r["member"]) for r in got if not r["passed"]) == cover.greedy(list(range(n)), near, copies, evict=True)

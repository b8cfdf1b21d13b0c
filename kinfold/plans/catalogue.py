"""Named queries over the test tables, and their SQL.

The tables hold no files or images, so others stand in: ``documents`` for files
(path ``source/doc_id.lang``, content the UTF-8 text) and for pixels (the text's
bytes, stretched), the signs of ``embeddings`` for 64-bit hashes, and the times of
``events`` for modification times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.bits import hamming, pack, signs, to_vector
from kinfold.operators import cover, digests, perceptual, predicates, similarity
from kinfold.params import SearchParameters
from kinfold.plans import search
from kinfold.sources.cache import probe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat(F.lit("."), F.col("lang")).alias("ext"), F.octet_length("text").cast("long").alias("size"), content.alias("content"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("date_modified"))
    return files(spark, sf_dir).join(times, "doc_id", "left")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), perceptual.once(pack(signs("embedding"))).alias("hash"))


def texts_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).where("size > 0").select("doc_id", "path", "size", perceptual.once(F.col("content")).alias("content"))
    return rows.select("doc_id", "path", "size", "content", perceptual.once(perceptual.byte_image("content", 72)).alias("pixels"))


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_hashed(spark, sf_dir).select(F.col("doc_id").alias("id"), perceptual.once(pack(perceptual.difference_bits("pixels"))).alias("hash"))


_FILES = """files AS (SELECT doc_id, source || '/' || doc_id::varchar || '.' || lang AS path, '.' || lang AS ext, octet_length(encode(text)) AS size, encode(text) AS content FROM documents)"""
_DIGESTS = _FILES + """, partials AS (SELECT *, sha256(content[1:(size + 9) // 10]) AS partial, sha256(content) AS digest FROM files WHERE size > 0)"""
_HASHES = """bits AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE -1 END) AS v FROM embeddings)"""
_EDGES = _HASHES + """, edges AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v::double[], b.v::double[])::int AS score FROM bits a, bits b WHERE list_dot_product(a.v::double[], b.v::double[]) >= 64 - {degree})"""


@query("WITH " + _FILES + " SELECT doc_id, path FROM files WHERE lower(ltrim(ext, '.')) IN ('en', 'fr')")
def filter_ext_include(spark, sf_dir):
    return predicates.select_files(files(spark, sf_dir), SearchParameters(included_file_types=[".EN", "fr"])).select("doc_id", "path")


@query("WITH " + _FILES + " SELECT doc_id, path FROM files WHERE lower(ltrim(ext, '.')) NOT IN ('de')")
def filter_ext_exclude(spark, sf_dir):
    return predicates.select_files(files(spark, sf_dir), SearchParameters(excluded_file_types=["DE"])).select("doc_id", "path")


@query("WITH " + _FILES + " SELECT doc_id, size FROM files WHERE size BETWEEN 500 AND 5000")
def filter_size_range(spark, sf_dir):
    return predicates.select_files(files(spark, sf_dir), SearchParameters(min_size=500, max_size=5000)).select("doc_id", "size")


@query("WITH " + _FILES + " SELECT doc_id, path, size FROM files WHERE lower(ltrim(ext, '.')) IN ('en', 'es') AND lower(ltrim(ext, '.')) NOT IN ('es') AND size >= 1000")
def filter_conjunction(spark, sf_dir):
    p = SearchParameters(included_file_types=["en", "es"], excluded_file_types=[".es"], min_size=1000)
    return predicates.select_files(files(spark, sf_dir), p).select("doc_id", "path", "size")


@query("WITH " + _FILES + " SELECT regexp_extract(path, '[^/]*$') AS name, ext AS type, path, size FROM files")
def file_dto_projection(spark, sf_dir):
    return predicates.file_row(files(spark, sf_dir))


@query("WITH " + _FILES + " SELECT 'Exception' AS type, 'File ' || path || ' is empty or can''t be read' AS result FROM files WHERE content IS NULL OR size = 0")
def unreadable_files(spark, sf_dir):
    return predicates.split_readable(files(spark, sf_dir))[1]


@query("WITH " + _DIGESTS + " SELECT partial, count(*) AS n FROM partials GROUP BY partial HAVING count(*) > 1")
def partial_digest_groups(spark, sf_dir):
    return digests.shared(digests.partial_digests(files(spark, sf_dir).where("size > 0")), "partial")


@query("WITH " + _DIGESTS + " SELECT doc_id, path FROM partials WHERE partial IN (SELECT partial FROM partials GROUP BY partial HAVING count(*) > 1)")
def candidate_semijoin(spark, sf_dir):
    return digests.candidates(files(spark, sf_dir).where("size > 0")).select("doc_id", "path")


@query("WITH " + _DIGESTS + " SELECT digest, count(*) AS n, min(path) AS first_path, sum(size)::bigint AS bytes FROM partials GROUP BY digest HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return digests.duplicate_groups(files(spark, sf_dir).where("size > 0"))


_NEWEST = (
    "WITH "
    + _DIGESTS
    + """, members AS (SELECT p.digest, p.path, p.size, e.ts AS date_modified, row_number() OVER (PARTITION BY p.digest ORDER BY e.ts DESC NULLS LAST, p.path) AS position
 FROM partials p LEFT JOIN events e ON e.event_id = p.doc_id WHERE p.digest IN (SELECT digest FROM partials GROUP BY digest HAVING count(*) > 1))"""
)


@query(_NEWEST + " SELECT digest, path, size, date_modified, position FROM members")
def duplicates_newest_first(spark, sf_dir):
    return digests.duplicate_members(dated(spark, sf_dir).where("size > 0")).select("digest", "path", "size", "date_modified", "position")


@query(_NEWEST + " SELECT digest, path, position, lead(position) OVER (PARTITION BY digest ORDER BY position) IS NULL AND digest < (SELECT max(digest) FROM members) AS is_last FROM members")
def last_in_group_flag(spark, sf_dir):
    return digests.last_in_group(digests.duplicate_members(dated(spark, sf_dir).where("size > 0"))).select("digest", "path", "position", "is_last")


@query("WITH " + _DIGESTS + " SELECT digest, count(*) AS n_paths, string_agg(path, ';' ORDER BY path) AS paths, min_by(size, path) AS size FROM partials GROUP BY digest")
def distinct_contents(spark, sf_dir):
    rows = files(spark, sf_dir).where("size > 0").withColumn("digest", F.sha2("content", 256))
    found = digests.distinct_files(rows, "digest")
    return found.select("digest", F.size("paths").cast("long").alias("n_paths"), F.array_join("paths", ";").alias("paths"), "size")


@query("WITH " + _FILES + " SELECT path FROM files WHERE path LIKE 'src0/%' UNION SELECT path FROM files WHERE path LIKE 'src1%'")
def union_all_sources(spark, sf_dir):
    rows = files(spark, sf_dir)
    return rows.where(F.col("path").startswith("src0/")).unionByName(rows.where(F.col("path").startswith("src1"))).select("path").distinct()


@query("SELECT vec_id, string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits, sum(CASE WHEN x > 0 THEN 1 ELSE -1 END)::bigint AS total FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id")
def sign_binarize(spark, sf_dir):
    bits = signs("embedding")
    total = F.aggregate(to_vector(bits), F.lit(0).cast("long"), lambda a, x: a + x)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(bits, lambda b: F.when(b, "1").otherwise("0")), "").alias("bits"), total.alias("total"))


@query("WITH " + _EDGES.format(degree=36) + " SELECT src, dst, (64 - score) // 2 AS distance FROM edges WHERE src < dst")
def hamming_pairs(spark, sf_dir):
    return similarity.pairs_within(hashes(spark, sf_dir), 18)


@query("WITH " + _EDGES.format(degree=40) + " SELECT src, dst, score FROM edges")
def similarity_threshold_join(spark, sf_dir):
    return similarity.neighbours(hashes(spark, sf_dir), 40, None)


@query("WITH " + _EDGES.format(degree=44) + " SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM edges) WHERE r <= 3")
def topk_neighbours(spark, sf_dir):
    return similarity.neighbours(hashes(spark, sf_dir), 44, 3)


@query("WITH " + _EDGES.format(degree=40) + ", cached AS (SELECT * FROM edges WHERE score >= 28) SELECT DISTINCT src, dst, score FROM (SELECT * FROM cached UNION ALL SELECT * FROM edges)")
def neighbour_union_distinct(spark, sf_dir):
    edges = similarity.neighbours(hashes(spark, sf_dir), 40, None)
    return similarity.merge_neighbours(edges.where("score >= 28"), edges)  # cached by a search of a lower degree


@query("WITH " + _EDGES.format(degree=40) + " SELECT * FROM edges WHERE score < 28")
def neighbour_anti_join(spark, sf_dir):
    edges = similarity.neighbours(hashes(spark, sf_dir), 40, None)
    return similarity.not_cached(edges, edges.where("score >= 28"))


_RAW = "raw AS MATERIALIZED (SELECT doc_id, n, list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::int) AS b FROM (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0)), "
_PIXELS = "SELECT doc_id, unnest(range({n})) AS i, unnest(list_transform(range({n}), lambda i: b[(i * n) // {n} + 1])) AS p FROM raw"
_DIFFERENCE = _RAW + "px AS (" + _PIXELS.format(n=72) + "), dhash AS (SELECT doc_id, string_agg(CASE WHEN p < q THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM (SELECT doc_id, i, p, lead(p) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM px) WHERE i < 64 GROUP BY doc_id)"


@query("WITH " + _DIFFERENCE + " SELECT doc_id, bits FROM dhash")
def difference_hash(spark, sf_dir):
    bits = perceptual.difference_bits("pixels")
    return texts_hashed(spark, sf_dir).select("doc_id", F.array_join(F.transform(bits, lambda b: F.when(b, "1").otherwise("0")), "").alias("bits"))


@query("WITH " + _DIFFERENCE + " SELECT a.doc_id AS src, b.doc_id AS dst, hamming(a.bits, b.bits) AS distance FROM dhash a JOIN dhash b ON a.doc_id < b.doc_id WHERE hamming(a.bits, b.bits) <= 3")
def difference_hash_near_pairs(spark, sf_dir):
    rows = text_hashes(spark, sf_dir)
    return similarity.pairs_within(rows, 3)


_BASIS = "(cos((2 * {i} + 1) * k * pi() / 64) * CASE WHEN k = 0 THEN 0.125 ELSE sqrt(2.0) / 8 END)"


@query(
    "WITH "
    + _RAW
    + "px AS ("
    + _PIXELS.format(n=1024)
    + "), across AS (SELECT doc_id, i // 32 AS y, k, sum(p * "
    + _BASIS.format(i="(i % 32)")
    + ") AS s FROM px, range(8) t(k) GROUP BY doc_id, y, k), low AS (SELECT doc_id, across.k AS h, v.k AS w, 0 AS z, sum(s * (cos((2 * y + 1) * v.k * pi() / 64) * CASE WHEN v.k = 0 THEN 0.125 ELSE sqrt(2.0) / 8 END)) AS c FROM across, range(8) v(k) GROUP BY doc_id, across.k, v.k), flat AS (SELECT doc_id, w * 8 + h AS place, CASE WHEN w = 0 AND h = 0 THEN 0.0 ELSE c END AS c FROM low) SELECT doc_id, string_agg(CASE WHEN c > m THEN '1' ELSE '0' END, '' ORDER BY place) AS bits FROM (SELECT *, avg(c) OVER (PARTITION BY doc_id) AS m FROM flat) GROUP BY doc_id"
)
def perceptual_hash(spark, sf_dir):
    return perceptual.hashed(files(spark, sf_dir).where("size > 0"), "PerceptualHash", "doc_id")


@query(
    "WITH "
    + _RAW
    + "px AS ("
    + _PIXELS.format(n=65536)
    + """), cells AS (SELECT doc_id, (i // 256) // 8 AS y, (i % 256) // 8 AS x, sum(p) AS s FROM px GROUP BY doc_id, y, x),
 blocks AS (SELECT doc_id, y - dy AS y, x - dx AS x, sum(s) AS s FROM cells, range(2) a(dy), range(2) b(dx) WHERE y - dy BETWEEN 0 AND 29 AND x - dx BETWEEN 0 AND 29 GROUP BY doc_id, y - dy, x - dx),
 total AS (SELECT doc_id, sum(s) AS t FROM cells GROUP BY doc_id)
 SELECT doc_id, string_agg(CASE WHEN s * 256 >= t THEN '1' ELSE '0' END, '' ORDER BY y, x) || repeat('0', 61) AS bits FROM blocks JOIN total USING (doc_id) GROUP BY doc_id"""
)
def block_mean_hash(spark, sf_dir):
    return perceptual.hashed(files(spark, sf_dir).where("size > 0"), "BlockMeanHash", "doc_id")


@query("WITH " + _DIFFERENCE + " SELECT d.doc_id AS id, c.bits IS NOT NULL AS hit, hamming(d.bits, c.bits) AS distance FROM dhash d LEFT JOIN (SELECT dhash.* FROM dhash JOIN documents USING (doc_id) WHERE lang = 'en') c USING (doc_id)")
def cache_probe_left_join(spark, sf_dir):
    rows = text_hashes(spark, sf_dir)
    english = files(spark, sf_dir).where("ext = '.en'").select(F.col("doc_id").alias("id"))
    return probe(rows, rows.join(english, "id", "left_semi")).select("id", "hit", hamming("hash", "cached_hash").alias("distance"))


@query(
    "WITH RECURSIVE "
    + _EDGES.format(degree=40)
    + """, near AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src) AS i, src AS v, list(dst) AS n FROM edges GROUP BY src),
 walk AS (SELECT 0::bigint AS i, []::bigint[] AS found, []::bigint[] AS done, 0::bigint AS v
 UNION ALL SELECT i, CASE WHEN len(l) = 0 OR len(list_distinct(list_append(l, v))) = 1 THEN []::bigint[] ELSE list_distinct(list_append(l, v)) END, CASE WHEN len(l) = 0 OR len(list_distinct(list_append(l, v))) = 1 THEN done ELSE list_distinct(list_concat(done, list_append(l, v))) END, v
 FROM (SELECT near.i, near.v, walk.done, list_filter(near.n, lambda x: NOT list_contains(walk.done, x)) AS l FROM walk JOIN near ON near.i = walk.i + 1))
 SELECT v AS group_id, unnest(found) AS member FROM walk WHERE len(found) > 0"""
)
def star_cover_groups(spark, sf_dir):
    rows = hashes(spark, sf_dir)
    return cover.star_cover(similarity.neighbours(rows, 40, None), rows.select("id", F.lit(1).cast("long").alias("copies")))


@query("WITH " + _DIGESTS + " SELECT digest AS group_id, regexp_extract(path, '[^/]*$') AS name, ext AS type, path, size, row_number() OVER (PARTITION BY digest ORDER BY path) AS position FROM partials WHERE digest IN (SELECT digest FROM partials GROUP BY digest HAVING count(*) > 1)")
def search_all(spark, sf_dir):
    return search.find_duplicates(files(spark, sf_dir), SearchParameters(folders=["*"], file_search_type="All"))


@query(None)
def search_images(spark, sf_dir):
    p = SearchParameters(folders=["*"], file_search_type="Images", perceptual_hash_algorithm="DifferenceHash", degree_of_similarity=6)
    return search.find_duplicates(texts_hashed(spark, sf_dir), p)


def _search_images(spark, sf_dir, algorithm, degree):
    p = SearchParameters(folders=["*"], file_search_type="Images", perceptual_hash_algorithm=algorithm, degree_of_similarity=degree)
    return search.find_duplicates(files(spark, sf_dir).where("size > 0"), p, stretched=True)


@query(None)
def search_images_perceptual(spark, sf_dir):
    return _search_images(spark, sf_dir, "PerceptualHash", 6)


@query(None)
def search_images_block_mean(spark, sf_dir):
    return _search_images(spark, sf_dir, "BlockMeanHash", 24)


@query("SELECT '' AS group_id, '' AS name, '' AS type, '' AS path, 0::bigint AS size WHERE false")
def search_audios(spark, sf_dir):
    return search.find_duplicates(files(spark, sf_dir), SearchParameters(folders=["*"], file_search_type="Audios"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

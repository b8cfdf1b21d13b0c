"""The three searches: exact duplicates, similar images, similar audio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.bits import pack
from kinfold.operators import cover, digests, perceptual, predicates, similarity
from kinfold.params import SearchParameters, checked
from kinfold.sources.cache import HashCache, probe
from kinfold.sources.scratch import stored, temporary

EMPTY = "group_id string, name string, type string, path string, size long"


def exact(files: DataFrame, p: SearchParameters) -> DataFrame:
    """Groups of equal files, newest first inside a group."""
    readable, _ = predicates.split_readable(predicates.select_files(files, p))
    found = digests.duplicate_members(readable)
    return found.select(F.col("digest").alias("group_id"), predicates.base_name("path").alias("name"), predicates.extension("path").alias("type"), "path", "size", "position")


def similar_images(images: DataFrame, p: SearchParameters, cache: HashCache | None = None, evict: bool = False, stretched: bool = False) -> DataFrame:
    """``(group_id, path)`` of similar images: hashed where they are, equal files
    taken once, joined within the degree, and covered by stars in the order of their
    ids. All neighbours count, however many an image has; images with equal hashes have
    the same ones, so they are joined as one class, by its smallest id. Only ids, paths
    and hashes are moved, never pixels (but to leave out what a large cache has).

    ``images`` has ``path``, ``size``, ``content``, and ``pixels`` (grey) as the
    algorithm takes them: nine by eight for the difference hash, 32 by 32 for the
    perceptual hash, 256 by 256 for the block mean hash; and ``kind`` where it was
    sniffed, by which animations and other files are left out (see ``errors``).
    ``stretched`` takes the contents as byte images, without ``pixels``.
    """
    algorithm = p.perceptual_hash_algorithm or "DifferenceHash"
    width = perceptual.BITS[algorithm]
    readable, _ = predicates.split_readable(predicates.select_files(images, p))
    readable, _ = predicates.split_images(readable)
    keyed = readable.withColumn("id", F.xxhash64(F.sha2("content", 256)))
    with temporary() as scratch:
        names = stored(keyed.select("id", "path"))
        fresh = keyed.select("id", F.col("content" if stretched else "pixels").alias("pixels"))
        found = cache.hashes(algorithm) if cache else None
        if cache:
            fresh = fresh.join(found.select("id"), "id", "left_anti")  # what the cache has is not hashed again
        if algorithm == "DifferenceHash":
            if stretched:
                fresh = fresh.select("id", perceptual.once(perceptual.byte_image("pixels", 72)).alias("pixels"))
            hashes = fresh.select("id", perceptual.once(pack(perceptual.difference_bits("pixels"))).alias("hash"))
        else:
            hashes = perceptual.packed(fresh, algorithm, "id", stretched=stretched)
        hashes = stored(hashes.where("hash is not null").groupBy("id").agg(F.first("hash").alias("hash")))
        if cache:
            known = stored(probe(names.select("id").distinct(), found).where("hit").select("id", F.col("cached_hash").alias("hash")))
            cache.add_hashes(algorithm, hashes)
            hashes = known.unionByName(hashes)
        degree = p.degree_of_similarity or 0
        classes = stored(hashes.groupBy("hash").agg(F.min("id").alias("id")))
        if cache:
            edges = similarity.neighbours(classes, degree, width=width)
            old = cache.edges(algorithm, width - degree)
            cache.add_edges(algorithm, similarity.not_cached(edges, old))
            for end in ("src", "dst"):
                old = old.join(classes.select(F.col("id").alias(end)), end, "left_semi")
            first = similarity.merge_neighbours(old, edges).where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near"))
        else:
            first = similarity.first_neighbours(classes, degree, width)
        of = hashes.join(classes.select("hash", F.col("id").alias("class")), "hash").select("id", "class")
        members = stored(names.groupBy("id").agg(F.count("*").alias("copies")).join(of, "id", "left").select("id", F.coalesce("class", "id").alias("class"), "copies"))
        nodes = stored(members.groupBy(F.col("class").alias("id")).agg(F.sum("copies").alias("copies")).join(first, "id", "left"))
        taken = cover.stars(nodes)
        if evict:
            taken = taken.where("not passed")
        found = taken.join(members, F.col("member") == F.col("class")).where(F.col("whole") | (F.col("id") == F.col("member"))).join(names, "id").select("group_id", "path")
        if evict:  # a parent may be left alone
            found = found.join(found.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"), "group_id", "left_semi")
        return scratch.keep(found)


def find_duplicates(files: DataFrame, p: SearchParameters, cache: HashCache | None = None, stretched: bool = False) -> DataFrame:
    """The search that ``p`` asks for; raises ``InvalidSearch`` if it isn't valid."""
    checked(p)
    if p.file_search_type == "All":
        return exact(files, p)
    if p.file_search_type == "Images":
        return similar_images(files, p, cache, stretched=stretched)
    return files.sparkSession.createDataFrame([], EMPTY)  # similar audio finds nothing


def errors(files: DataFrame, p: SearchParameters) -> DataFrame:
    """``(type, result)``: a row for each file that the search can't take."""
    readable, empty = predicates.split_readable(predicates.select_files(files, p))
    return empty.unionByName(predicates.split_images(readable)[1]) if p.file_search_type == "Images" else empty


def to_response(found: DataFrame) -> DataFrame:
    """One JSON array of files per group."""
    row = F.struct(*[F.col(c) for c in found.columns if c != "group_id"])
    return found.groupBy("group_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("files"))

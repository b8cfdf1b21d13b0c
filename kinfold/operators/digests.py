"""Exact duplicates by content digest, in two stages.

The first stage digests the first tenth of each file; only files whose partial
digest is shared are digested whole. Shared partial digests are computed first and
kept. As long as they are few (by their count) they go to the files, so a file is
digested whole only if it can have a copy; beyond that, digests are joined to them
instead, as contents must not be shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.bits import prefix_length
from kinfold.sources.scratch import stored

#: Shared partial digests (64 characters each) that are sent to the files at most.
SENT = 200_000


def partial_digests(files: DataFrame) -> DataFrame:
    """``files`` with ``partial``: SHA-256 of the first tenth of the content."""
    return files.withColumn("partial", F.sha2(F.substring("content", F.lit(1), prefix_length("size")), 256))


def shared(rows: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of the keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def candidates(files: DataFrame) -> DataFrame:
    """Files whose partial digest another file has too."""
    marked = partial_digests(files)
    return marked.join(shared(marked, "partial").select("partial"), "partial", "left_semi")


def digests(files: DataFrame) -> DataFrame:
    """``(digest, path, size[, date_modified])`` of the files that can have a copy."""
    rest = [c for c in ("date_modified",) if c in files.columns]
    marked = partial_digests(files)
    many = stored(shared(marked, "partial").select("partial"))
    if many.count() <= SENT:
        return marked.join(F.broadcast(many), "partial", "left_semi").select(F.sha2("content", 256).alias("digest"), "path", "size", *rest)
    whole = marked.select("partial", "path", "size", *rest, F.sha2("content", 256).alias("digest"))
    return whole.join(many, "partial", "left_semi").select("digest", "path", "size", *rest)


def duplicate_members(files: DataFrame) -> DataFrame:
    """Members of groups of equal files, newest first where times are known."""
    found = digests(files)
    found = found.join(shared(found, "digest").select("digest"), "digest", "left_semi")
    order = [F.desc("date_modified")] if "date_modified" in found.columns else []
    within = Window.partitionBy("digest").orderBy(*order, "path")
    return found.withColumn("position", F.row_number().over(within))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """``(digest, n, first_path, bytes)``, one row per group of equal files."""
    return digests(files).groupBy("digest").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.sum("size").alias("bytes")).where("n > 1")


def last_in_group(members: DataFrame) -> DataFrame:
    """Flags the last row of each group but of the last group, as groups stand one
    after the other in a list ordered by group."""
    rows = Window.partitionBy("digest").orderBy("position")
    ends = members.withColumn("next", F.lead("position").over(rows))
    final = members.agg(F.max("digest").alias("final"))  # one row
    return ends.crossJoin(F.broadcast(final)).withColumn("is_last", F.col("next").isNull() & (F.col("digest") < F.col("final"))).drop("next", "final")


def distinct_files(files: DataFrame, key: str = "id") -> DataFrame:
    """One row per distinct content: all paths, and the first path's metadata."""
    return files.groupBy(key).agg(F.sort_array(F.collect_list("path")).alias("paths"), F.min_by("size", "path").alias("size"))

"""File predicates and the projection of result rows.

Extensions match whatever their case, with or without the dot; a file without
one never matches a list. Both lists and the size range apply together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.params import SearchParameters


def _bare(names: Sequence[str]) -> list[str]:
    return sorted({n.strip().lower().removeprefix(".") for n in names if n.strip(" .")})


def extension(path: str | Column = "path") -> Column:
    """The extension with its dot, empty where there is none."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def base_name(path: str | Column = "path") -> Column:
    return F.substring_index(path, "/", -1)


def included(ext: Column, names: Sequence[str]) -> Column:
    return F.lower(F.ltrim(ext, F.lit("."))).isin(_bare(names)) if _bare(names) else F.lit(True)


def excluded(ext: Column, names: Sequence[str]) -> Column:
    return F.lower(F.ltrim(ext, F.lit("."))).isin(_bare(names)) if _bare(names) else F.lit(False)


def in_range(size: Column, least: int | None, most: int | None) -> Column:
    found = F.lit(True)
    if least is not None:
        found = found & (size >= least)
    if most is not None:
        found = found & (size <= most)
    return found


def select_files(files: DataFrame, p: SearchParameters) -> DataFrame:
    """Files that the search's lists and sizes admit; pushed to the scan."""
    ext = F.col("ext") if "ext" in files.columns else extension("path")
    return files.where(~excluded(ext, p.excluded_file_types) & included(ext, p.included_file_types) & in_range(F.col("size"), p.min_size, p.max_size))


def file_row(files: DataFrame) -> DataFrame:
    """``(name, type, path, size[, date_modified])``."""
    rest = ["date_modified"] if "date_modified" in files.columns else []
    return files.select(base_name("path").alias("name"), extension("path").alias("type"), "path", "size", *rest)


def split_readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with content, and error rows ``(type, result)`` for the others."""
    ok = F.col("content").isNotNull() & (F.col("size") > 0)
    errors = files.where(~F.coalesce(ok, F.lit(False))).select(F.lit("Exception").alias("type"), F.concat(F.lit("File "), F.col("path"), F.lit(" is empty or can't be read")).alias("result"))
    return files.where(ok), errors


def split_images(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images by their ``kind`` (as sniffed), and error rows for files of other kinds;
    animations are left out without one. Without that column all files are images."""
    if "kind" not in files.columns:
        return files, files.where(F.lit(False)).select(F.lit("Exception").alias("type"), F.col("path").alias("result"))
    bad = files.where(~F.coalesce(F.col("kind").isin("Image", "Animation"), F.lit(False)))
    errors = bad.select(F.lit("Exception").alias("type"), F.concat(F.lit("File "), F.col("path"), F.lit(" is no image that can be read: "), F.coalesce("kind", F.lit("unknown"))).alias("result"))
    return files.where(F.col("kind") == "Image"), errors

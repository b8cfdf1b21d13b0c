"""Duplicates among files that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(files: DataFrame) -> DataFrame:
    """Files whose content has not come before: state is one digest per content."""
    return files.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"])


def progress(files: DataFrame, notify: Callable[[str, int], None], kind: str = "HashProgress"):
    """A streaming query that reports after each batch how many files came so far."""
    total = [0]

    def batch(rows: DataFrame, _: int) -> None:
        total[0] += rows.count()
        notify(kind, total[0])

    return files.writeStream.foreachBatch(batch)

"""Files of folders as a DataFrame ``(path, ext, size, date_modified, content)``.

Spark's binary reader leaves out hidden and empty files and lists a path once. The
listing reader below finds every file that the process may read, as a search of
a shared file system needs; it reads contents on the executors.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.predicates import extension
from kinfold.sources.scratch import stored

#: Bytes of one read.
CHUNK = 131_072


def scan(spark: SparkSession, folders: Sequence[str], recursive: bool = True) -> DataFrame:
    """By Spark's binary reader: any file system, size filters pushed to the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load([f if recursive or "*" in f else f"{f.rstrip('/')}/*" for f in folders])
    return found.select("path", extension("path").alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("date_modified"), "content")


def listing(spark: SparkSession, folders: Sequence[str], recursive: bool = True) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``(path, ext, size, date_modified)`` of all files, hidden and empty ones
    too, each path once; and messages for folders that can't be read."""
    rows: dict[str, tuple] = {}
    errors: list[tuple[str, str]] = []
    for folder in folders:
        if not os.path.isdir(folder):
            errors.append(("Exception", f"Folder {folder} doesn't exist or isn't a folder"))
            continue
        for top, inner, names in os.walk(folder, onerror=lambda e: errors.append(("Exception", str(e)))):
            inner[:] = sorted(inner) if recursive else []
            for name in names:
                path = os.path.join(top, name)
                try:
                    found = os.stat(path)
                except OSError as e:
                    errors.append(("Exception", str(e)))
                    continue
                rows[path] = (path, found.st_size, datetime.fromtimestamp(found.st_mtime, timezone.utc).replace(tzinfo=None))
    table = spark.createDataFrame(list(rows.values()), "path string, size long, date_modified timestamp_ntz")
    return table.withColumn("ext", extension("path")), errors


def with_content(files: DataFrame) -> DataFrame:
    """``files`` and their ``content``, read on the executors; null if that fails."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 16):
                part = f.iloc[i : i + 16].copy()
                part["content"] = [_read(p) for p in part["path"]]
                yield part

    return files.mapInPandas(read, ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in files.schema) + ", content binary")


def _read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return b"".join(iter(lambda: f.read(CHUNK), b""))
    except OSError:
        return None


def with_digests(files: DataFrame, column: str, tenth: bool = False) -> DataFrame:
    """``files (path, size, …)`` and the SHA-256 of their contents, or of the first
    tenth alone, of which no more is read then. Files are read on the executors in
    chunks, never held; null if that fails."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{column: [_digest(p, -(-int(n) // 10) if tenth else None) for p, n in zip(f["path"], f["size"], strict=True)]})

    return files.mapInPandas(read, ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in files.schema) + f", {column} string")


def _digest(path: str, most: int | None) -> str | None:
    found, left = hashlib.sha256(), most
    try:
        with open(path, "rb") as f:
            while (left is None or left > 0) and (part := f.read(CHUNK if left is None else min(CHUNK, left))):
                found.update(part)
                left = None if left is None else left - len(part)
    except OSError:
        return None
    return found.hexdigest()


def duplicate_files(files: DataFrame) -> DataFrame:
    """``(digest, path, size)`` of the files of a ``listing`` that have an equal one:
    a tenth of each is read, and the whole of those that share its digest."""
    marked = stored(with_digests(files.where("size > 0").select("path", "size"), "partial", tenth=True).where("partial is not null"))
    many = marked.groupBy("partial").agg(F.count("*").alias("n")).where("n > 1").select("partial")
    whole = stored(with_digests(marked.join(many, "partial", "left_semi").select("path", "size"), "digest").where("digest is not null"))
    return whole.join(whole.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digest", "left_semi").select("digest", "path", "size")


#: First bytes of file kinds.
MAGIC = {
    "jpg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "47494638", "bmp": "424D", "tif": "49492A00", "tiff": "4D4D002A", "mp3": "494433", "flac": "664C6143",
    "ogg": "4F676753", "mkv": "1A45DFA3",
}
IMAGES, AUDIOS = ("jpg", "png", "bmp", "tif", "tiff", "webp", "gif"), ("mp3", "flac", "ogg", "wav")


def sniffed(content: str = "content") -> F.Column:
    """Kind of a content by its first bytes: Image, Animation, Audio, Video, or
    CorruptUnknownOrUnsupported. Marks of moving images are looked for in all of it."""
    head = F.hex(F.substring(content, 1, 16))
    whole = F.decode(content, "ISO-8859-1")  # a character for each byte
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(head.startswith(magic), F.lit(name)).otherwise(kind)
    riff = head.startswith("52494646")
    kind = F.when(riff & (F.substring(head, 17, 8) == "57454250"), F.lit("webp")).when(riff & (F.substring(head, 17, 8) == "57415645"), F.lit("wav")).when(F.substring(head, 9, 8) == "66747970", F.lit("mp4")).otherwise(kind)
    moving = (kind == "gif") & (F.size(F.split(whole, "!\u00f9\u0004")) >= 3) | (kind == "webp") & whole.contains("ANIM") | (kind == "png") & whole.contains("acTL")
    found = F.when(moving, "Animation").when(kind.isin(*IMAGES), "Image").when(kind.isin(*AUDIOS), "Audio").when(kind.isin("mkv", "mp4"), "Video")
    return F.coalesce(found, F.lit("CorruptUnknownOrUnsupported"))

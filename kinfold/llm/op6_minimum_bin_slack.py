"""Best-fit packing by minimum bin slack.

Lengths are whole numbers from 1 to the sequence length, so the packing problem
of any corpus is a histogram of at most ``SEQUENCE`` counts. The plan is made on
that histogram: the longest piece left opens a bin, a bitset subset-sum dynamic
programme over the lengths left finds the fullest feasible combination for it,
and the combination is removed as many times as the counts allow. A plan has
about as many patterns as there are lengths, whatever the corpus' size.

Pieces then find their places: ranks within a length come from counts by
(length, bucket) plus a rank inside the bucket, so a length that a third of all
pieces share is spread over many tasks.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, held, stored, table
from .op7_forced_boundary_bpe import vocabulary

SEQUENCE = 4096
END = 1
#: Entries of the memo of white-space words, per Python worker.
WORDS = 700_000
#: Words of one call of the tokenizers library.
CALL = 4096
#: Characters of the texts that are encoded together, about.
TOGETHER = 1_000_000
#: Pieces of one (length, bucket) group, about.
GROUP = 50_000


_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A full stop or comma that stands in a longer run of signs.
_SIGN_RUN = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")


class WordMemo:
    """Ids of texts whose tokenizer never joins across white space.

    Words between white space are encoded by the tokenizers library, once each
    while the bounded memo holds them; a text's ids are their concatenation.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; words that are new to the memo are encoded together."""
        split = [self._words(t) for t in texts]
        found = [list(map(self.memo.get, words)) for words in split]
        new = list({w for words, ids in zip(split, found, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None})
        made: dict[str, bytes] = {}
        if new:
            made = dict(zip(new, self._many(new), strict=True))
            if len(self.memo) + len(new) > WORDS:
                self.memo.clear()
            self.memo.update((w, ids) for w, ids in made.items() if len(w) <= 64)
        out = []
        for text, words, ids in zip(texts, split, found, strict=True):
            if text and not words and _ODD_SPACE.search(text):
                out.append(self._ids(text))
            elif None in ids:
                out.append(b"".join([made[w] if i is None else i for w, i in zip(words, ids, strict=True)]))
            else:
                out.append(b"".join(ids))
        return out

    def _words(self, text: str | None) -> list[str]:
        """Parts of a text that the tokenizer never joins; none where it has to see the text whole."""
        if not text or _ODD_SPACE.search(text):  # white space to Python alone
            return []
        low = text.lower()  # as the tokenizer does, but it composes before that and never after
        if "<|" not in text and (text.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            text = low  # special strings are case-sensitive
            if not _SIGN_RUN.search(text):  # single signs are words of their own
                text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), CALL):
            some = words[at : at + CALL]
            encoded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4").tobytes()
            ends = [0, *(4 * np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(len(some)), side="right")).tolist()]
            out += [ids[a:b] for a, b in zip(ends, ends[1:])]
        return out


def memo(path: str) -> WordMemo:
    """One memo per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark task
    return held(f"words/{path}", lambda: WordMemo(path))


def _together(frame: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows of a batch in groups of about ``TOGETHER`` characters."""
    held, size = [], 0
    for k, t in zip(frame.column(0), frame.column(1), strict=True):
        held.append((k.as_py(), t.as_py()))
        size += len(held[-1][1] or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: whole documents as token pieces.

    A document is its ids and then ``end``; only one longer than ``sequence`` is
    cut. Null and empty texts are the single id ``end``. ``ids`` is binary,
    little-endian unsigned 32-bit. Rows with equal or null ids stay separate.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = end.to_bytes(4, "little")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = memo(path)
        for frame in frames:
            schema = pa.schema([frame.schema.field(0).with_name("doc_id"), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

            def rows(frame=frame):
                for group in _together(frame):
                    keys, texts = zip(*group, strict=True)
                    for k, ids in zip(keys, words.encode_all(list(texts)), strict=True):
                        ids += tail
                        for p in range(0, len(ids), 4 * sequence):
                            part = ids[p : p + 4 * sequence]
                            yield k, p // (4 * sequence), p // 4, len(part) // 4, part

            yield from batches(rows(), schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def _fullest(counts: np.ndarray, lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best; ``lengths`` descend."""
    goal, reach, steps = 1 << room, 1, []
    mask = (goal << 1) - 1
    for length in lengths:
        left = min(int(counts[length]), room // length)
        size = 1
        while left > 0 and not reach & goal:
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= reach << (length * size) & mask
            left -= size
            size *= 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + size
            total -= length * size
    return used


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: how often in a bin}, number of bins)`` that use up
    the histogram exactly, by minimum bin slack."""
    counts = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    left = [x for x in range(sequence, 0, -1) if counts[x]]
    while left:
        first = left[0]
        counts[first] -= 1
        used = _fullest(counts, [x for x in left if x <= sequence - first and counts[x]], sequence - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(int(counts[x]) // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
        out.append((used, times))
        left = [x for x in left if counts[x]]
    return out


def pack(cut_pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table that has ``length``.

    The table is stored once, so ranks are the same in every later run of a
    task. All rows are placed; an empty table gives an empty table.
    """
    kept = stored(cut_pieces.withColumn("_row", F.monotonically_increasing_id()))
    histogram = {int(r["length"]): int(r["n"]) for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `sequence` rows
    total = sum(histogram.values())
    buckets = max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // GROUP + 1)
    rows, base = [], 0
    taken: dict[int, int] = {}
    for used, times in plan(histogram, sequence):
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken.get(length, 0), n, base, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += length * n
        base += times
    rows.sort()
    book = np.array(rows, np.int64).reshape(-1, 5)
    keys = (book[:, 0] << 40) + book[:, 1]

    ranked = kept.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sizes = ranked.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("length", "_bucket").orderBy("_row")
    ranked = ranked.withColumn("_rank", F.row_number().over(inner) - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_bucket", "_before", "_row")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(np.int64), f["_rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            _, start, n, first, offset = book[at].T
            f["sequence_id"] = first + (rank - start) // n
            f["offset"] = offset + (rank - start) % n * length
            yield f

    order = [*cut_pieces.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in ranked.schema) + ", sequence_id long, offset long"
    if not total:
        return kept.drop("_row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    return ranked.mapInPandas(place, schema).select(*order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_pieces = pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    small = cut_pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(small).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

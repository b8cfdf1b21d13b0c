"""Hamming joins of packed hashes: 64 bits as a BIGINT, more as an array of them.

Two hashes within distance r agree in at least one of r + 1 bands, so an
equi-join on bands, verified, is exact. Where bands would be so narrow that they
select nothing, rows meet in pairs of blocks instead: as many comparisons as all
pairs, but spread evenly, without a broadcast or a cross join.

Wide hashes are fetched for bands only that several rows share, and compared in
Arrow batches; a band that very many rows share is dealt out in pairs of blocks.
Where only the first neighbour of each hash is asked for, no pairs leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from kinfold.functions.bits import hamming, radius, score
from kinfold.functions.groups import runs

WIDTH = 64
#: Bits that can differ, of the widths that have fewer than that.
VARYING = {961: 900}
#: Bands narrower than this select too little.
LEAST_BAND = 10
#: Rows of a block, about.
BLOCK = 2000
#: Words that are compared at a time.
PORTION = 1 << 20


def _banded(hashes: DataFrame, bands: int) -> DataFrame:
    edges = [WIDTH * i // bands for i in range(bands + 1)]
    parts = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("hash", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return hashes.select("id", "hash", F.explode(F.array(*parts)).alias("p")).select("id", "hash", "p.band", "p.bits")


def _band_keys(hashes: DataFrame, bands: int, width: int) -> DataFrame:
    """``(tok, id)``: a key of each band of hashes packed as arrays, from the words
    it touches, masked."""
    edges = [width * i // bands for i in range(bands + 1)]

    def masked(word: int, a: int, b: int):
        bits = sum(1 << i for i in range(max(a - 64 * word, 0), min(b - 64 * word, 64)))
        return F.get("hash", F.lit(word)).bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long"))

    parts = [F.xxhash64(F.lit(i), *[masked(w, a, b) for w in range(a // 64, (b - 1) // 64 + 1)]) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return hashes.select(F.explode(F.array(*parts)).alias("tok"), "id")


def _keys(hashes: DataFrame, distance: int, width: int) -> DataFrame:
    """``(tok, id)`` of hashes packed as arrays; one key where bands would not select."""
    varying = VARYING.get(width, width)
    selective = varying // (distance + 1) >= LEAST_BAND
    return _band_keys(hashes, distance + 1 if selective else 1, varying if selective else 0)


def _met(keys: DataFrame, hashes: DataFrame, distance: int, first: bool = False) -> DataFrame:
    """``(src, dst, distance)`` of the rows that share a key in ``keys (tok, id)`` and
    whose hashes are within the distance; or where ``first``, ``(id, near)``: the
    smallest other id of these. A task holds two blocks of a key's rows."""

    def far(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, PORTION // max(1, len(y) * words.shape[1]))
        for start in range(0, len(x), step):
            rows = x[start : start + step]
            yield rows, np.bitwise_count(words[rows][:, None] ^ words[y][None]).sum(2, dtype=np.int32)

    def pairs(ids: np.ndarray, words: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        for rows, d in far(words, x, y):
            r, c = np.nonzero(d <= distance)
            a, b, d = ids[rows[r]], ids[y[c]], d[r, c]
            keep = a < b if same else a != b  # a pair of one block is seen both ways
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(d[keep])], names=["src", "dst", "distance"])

    def firsts(ids: np.ndarray, words: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        x, y = (v[np.argsort(ids[v])] for v in (x, y))
        found, best = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
        for rows, d in far(words, x, y):
            near = (d <= distance) & (ids[rows][:, None] != ids[y][None])
            own = near.any(1)
            best[rows[own]], found[rows[own]] = ids[y[near[own].argmax(1)]], True
            if not same:  # the other block's rows see this block's smallest ids first
                new = near.any(0) & ~found[y]
                best[y[new]], found[y[new]] = ids[rows[near[:, new].argmax(0)]], True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(best[found])], names=["id", "near"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(frames, 3):
            ids, block = g["id"].to_numpy(), g["block"].to_numpy()
            words = g["hash"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            x, y = (np.flatnonzero(block == g[c][0].as_py()) for c in ("i", "j"))
            if len(x) and len(y):
                yield from (firsts if first else pairs)(ids, words, x, y, g["i"][0] == g["j"][0])

    sizes = keys.groupBy("tok").agg(F.count("*").alias("n")).where("n > 1").select("tok", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    rows = keys.join(sizes, "tok").join(hashes, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("tok", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "hash")
    return rows.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j").mapInArrow(run, "id long, near long" if first else "src long, dst long, distance int")


def _blocked(hashes: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    own = hashes.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = own.withColumn("c", every).where("b <= c")
    right = own.withColumn("c", every).where("c <= b").select(F.col("c").alias("b"), F.col("b").alias("c"), "id", "hash")
    return left, right


def pairs_within(hashes: DataFrame, distance: int, width: int = WIDTH) -> DataFrame:
    """``(src, dst, distance)`` with src < dst, for ``hashes (id, hash)``."""
    bands = distance + 1
    if isinstance(hashes.schema["hash"].dataType, ArrayType):
        return _met(_keys(hashes, distance, width), hashes.select("id", "hash"), distance).distinct()
    if VARYING.get(width, width) // bands >= LEAST_BAND:
        a, b = (_banded(hashes, bands) for _ in range(2))
        met = a.alias("a").join(b.alias("b"), ["band", "bits"]).where("a.id < b.id")
    else:
        blocks = max(1, -(-hashes.count() // BLOCK))
        a, b = _blocked(hashes, blocks)
        met = a.alias("a").join(b.alias("b"), ["b", "c"]).where(F.col("a.id") != F.col("b.id"))
    far = hamming("a.hash", "b.hash")
    found = met.where(far <= distance).select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"), far.alias("distance"))
    return found.distinct()


def first_neighbours(hashes: DataFrame, degree: int, width: int = WIDTH) -> DataFrame:
    """``(id, near)``: the smallest of all other ids within the degree, for each hash
    that has one. Tasks hand on a row per hash and pair of blocks, however many are near."""
    rows = hashes.select("id", "hash" if isinstance(hashes.schema["hash"].dataType, ArrayType) else F.array("hash").alias("hash"))
    return _met(_keys(rows, radius(degree), width), rows, radius(degree), first=True).groupBy("id").agg(F.min("near").alias("near"))


def neighbours(hashes: DataFrame, degree: int, limit: int | None = None, width: int = WIDTH) -> DataFrame:
    """``(src, dst, score)`` in both directions and with each hash itself: those
    within the degree, of each source all, or the best ``limit`` where one is given."""
    half = pairs_within(hashes, radius(degree), width)
    own = hashes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("distance"))
    both = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).unionByName(own)
    both = both.select("src", "dst", score(width, F.col("distance")).alias("score"))
    if limit is None:
        return both
    best = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).drop("r")


def merge_neighbours(cached: DataFrame, new: DataFrame) -> DataFrame:
    """Cached and new edges, each once."""
    return cached.unionByName(new).dropDuplicates(["src", "dst"])


def not_cached(new: DataFrame, cached: DataFrame) -> DataFrame:
    return new.join(cached.select("src", "dst"), ["src", "dst"], "left_anti")

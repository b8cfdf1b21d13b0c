"""Near duplicates of embeddings by cross-polytope hashing.

Equal vectors of one label are one class. Each class is turned by pseudo-random
rotations (sign flips and fast Hadamard transforms, three times), and its bucket
in a table is the pair of nearest signed axes of two rotations. A class stands in
its own bucket and, as a probe, in the buckets that are next nearest. A bucket's row
is a class id and a sketch, the signs of the rotated vector: within a bucket, probes
and residents are compared with residents by their sketches, and those that may
reach the threshold are candidates.

Candidates are given back as a spanning forest per block, never as pairs, and
joined into groups. Vectors are shuffled for classes of a group alone, once for each
pair of blocks of it: there all pairs are verified, and a pair is linked if its
cosine in double precision reaches the threshold. So hashing decides which vectors
meet, never what is right. Tasks take pairs of blocks of buckets and of groups; each
gives back one count per vector and a spanning forest.

Defined cases: a null label, or a vector that is null, empty, zero or holds a null
or non-finite component, links with nothing; vectors of different lengths are
never compared; rows with equal ids stay separate rows; null ids name no component
unless they stand alone; an empty table gives no rows; other columns are not looked
at. Classes are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, runs, stored, table, temporary, usable

THRESHOLD = 0.93
#: Hash tables, and probes of each beside the own bucket.
TABLES, PROBES = 6, 3
#: Rotations whose signs make up a sketch, and how many standard deviations of the
#: bits in which vectors at the threshold differ a candidate may have more.
SKETCH, MARGIN = 4, 6.0
#: Rows of a block, about; a task holds two. Cells that are compared at a time.
BLOCK, PORTION = 2048, 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """The rows under one pseudo-random rotation, padded to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, number, d]).choice([-1.0, 1.0], (3, d))
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return y


def hashes(x: np.ndarray, seed: int = 9, tables: int = TABLES, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of unit rows, (rows, tables, 1 + probes), the own bucket first, and
    their sketches, (rows, words of 64 signs).

    A bucket joins the nearest axes of two rotations. Probes move one of them, or
    both, to the second nearest axis, in the order of what that costs.
    """
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    signs = []
    each = np.arange(len(x))
    for t in range(tables):
        sides = []
        for k in range(2):
            y = rotations(x, 2 * t + k, seed)
            if 2 * t + k < SKETCH:
                signs.append(y > 0)
            a = np.abs(y)
            best = a.argmax(1)
            top = a[each, best].copy()
            a[each, best] = -1
            next_ = a.argmax(1)
            d = y.shape[1]
            sides.append((best + d * (y[each, best] < 0), next_ + d * (y[each, next_] < 0), top - a[each, next_], 2 * d))
        (a0, a1, ca, n), (b0, b1, cb, _) = sides
        out[:, t, 0] = a0 * n + b0
        moves = np.stack([a1 * n + b0, a0 * n + b1, a1 * n + b1], 1)
        order = np.argsort(np.stack([ca, cb, ca + cb], 1), 1, kind="stable")
        out[:, t, 1:] = np.take_along_axis(moves, order, 1)[:, :probes]
    bits = np.packbits(np.concatenate(signs, 1), axis=1, bitorder="little")
    pad = -bits.shape[1] % 8
    return out, np.pad(bits, ((0, 0), (0, pad))).view("<u8")


def most_bits(threshold: float, bits: int) -> int:
    """In how many of ``bits`` signs two candidates may differ."""
    p = float(np.arccos(min(1.0, max(-1.0, threshold))) / np.pi)
    return int(np.ceil(bits * p + MARGIN * np.sqrt(bits * p * (1 - p))))


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a block's links."""
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(root) if i != r]


def _meeting(group: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Edges that span the candidates of one pair of blocks of a bucket.

    Columns: bucket, i, j, cid, probe, block, sketch, bits.
    """
    cid, probe, block = group["cid"].to_numpy(), group["probe"].to_numpy(), group["block"].to_numpy()
    i, j = int(group["i"][0].as_py()), int(group["j"][0].as_py())
    home = np.flatnonzero(probe == 0)
    if not len(home):
        return []
    words = np.frombuffer(b"".join(group["sketch"].to_pylist()), "<u8").reshape(len(cid), -1)
    most = most_bits(threshold, int(group["bits"][0].as_py()))
    ids, place = np.unique(cid, return_inverse=True)
    edges = []
    step = max(1, PORTION // (len(home) * words.shape[1]))
    for start in range(0, len(cid), step):
        x = slice(start, start + step)
        differ = np.bitwise_count(words[x][:, None] ^ words[home][None]).sum(2, dtype=np.int64)
        near = (differ <= most) & (cid[x][:, None] != cid[home][None])
        near &= (block[x] == i)[:, None] & (block[home] == j)[None] | (block[x] == j)[:, None] & (block[home] == i)[None]
        a, b = np.nonzero(near)
        if len(a):
            edges.append(_roots(len(ids), place[start + a], place[home[b]]))
    if not edges:
        return []
    a, b = np.concatenate(edges, 1)
    return _forest(ids, a, b)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (2, at most n) that join what ``a - b`` join."""
    found = _forest(np.arange(n), a, b)
    return np.array(found, np.int64).reshape(-1, 2).T


def _compare(group: pa.Table, threshold: float, code: str) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Links of one pair of blocks of a group: ids, their counts, and spanning edges.

    Columns: g, i, j, cid, block, n, vector.
    """
    ids, n, block = group["cid"].to_numpy(), group["n"].to_numpy(), group["block"].to_numpy()
    i, j = int(group["i"][0].as_py()), int(group["j"][0].as_py())
    counts = np.zeros(len(ids), np.int64)
    edges = [np.zeros((2, 0), np.int64)]
    raw = group["vector"].to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(raw[k] for k in at), code).reshape(len(at), -1).astype(float)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        one, two = np.flatnonzero(block[at] == i), np.flatnonzero(block[at] == j)
        step = max(1, PORTION // max(1, len(two)))
        for start in range(0, len(one), step):
            part = one[start : start + step]
            a, b = np.nonzero(x[part] @ x[two].T >= threshold - 1e-9)
            a, b = part[a], two[b]
            keep = ids[at[a]] < ids[at[b]] if i == j else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            keep = np.einsum("rd,rd->r", x[a], x[b]) >= threshold
            a, b = at[a[keep]], at[b[keep]]
            np.add.at(counts, a, n[b])
            np.add.at(counts, b, n[a])
            edges.append(_roots(len(ids), a, b))
    some = np.flatnonzero(counts)
    a, b = np.concatenate(edges, 1)
    return ids[some].tolist(), counts[some].tolist(), _forest(ids, a, b)


def _blocked(rows: DataFrame, sizes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` dealt to pairs of blocks ``(key, i, j)`` by ``sizes (key, blocks)``."""
    placed = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("blocks")))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select(key, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", *columns)
    return placed.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    with temporary() as scratch:
        return _near_duplicates(vectors, threshold, key, vector, label, scratch)


def _near_duplicates(vectors: DataFrame, threshold: float, key: str, vector: str, label: str, scratch) -> DataFrame:
    kind, code = ("array<float>", "<f4") if vectors.schema[vector].dataType.simpleString() == "array<float>" else ("array<double>", "<f8")
    each = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast(kind).alias("v"), F.col(label).alias("label"))
    good = usable("v") & F.col("label").isNotNull()
    each = each.withColumn("cid", F.when(good, F.xxhash64("label", "v")))
    rows = each.where("cid is not null")
    classes = scratch.keep(rows.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").cast("string").alias("label")))

    def spread(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            sizes = np.array([len(v) for v in f.column(1)])
            for d in np.unique(sizes):
                part = f.filter(pa.array(sizes == d))
                x = np.array(part.column(1).flatten(), float).reshape(part.num_rows, d)
                found, sketch = hashes(x / np.sqrt((x * x).sum(1))[:, None])
                sketch = pa.array([r.tobytes() for r in sketch], pa.binary())
                bits = SKETCH << max(1, int(d - 1).bit_length())
                for t in range(found.shape[1]):
                    for p in range(found.shape[2]):
                        whole = [pa.array(np.full(part.num_rows, v, np.int64)) for v in (t, p, d, bits)]
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *whole, pa.array(found[:, t, p]), sketch], names=["cid", "label", "table", "probe", "d", "bits", "code", "sketch"])

    hashed = classes.select("cid", "v", "label").mapInArrow(spread, "cid long, label string, table long, probe long, d long, bits long, code long, sketch binary")
    hashed = hashed.select(F.xxhash64("label", "table", "code", "d").alias("bucket"), "cid", "probe", "bits", "sketch")
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("probe").alias("first")).where("size > 1 and first = 0").select("bucket", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))

    def meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(frames, 3):
            if edges := _meeting(group, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    met = components(stored(_blocked(hashed, sizes, "bucket", ["cid", "probe", "sketch", "bits"]).mapInArrow(meet, "a long, b long").distinct()))
    sizes = met.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).select(F.col("component").alias("g"), "blocks")
    grouped = classes.select("cid", "n", "v").join(met.select(F.col("node").alias("cid"), F.col("component").alias("g")), "cid")

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), f.column(2), pa.array([np.array(v, code).tobytes() for v in f.column(3).to_pylist()], pa.binary())], names=["cid", "g", "n", "vector"])

    grouped = grouped.select("cid", "g", "n", "v").mapInArrow(packed, "cid long, g long, n long, vector binary")

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(frames, 3):
            ids, counts, edges = _compare(group, threshold, code)
            if ids:
                a, b = [*ids, *(e[0] for e in edges)], [*([None] * len(ids)), *(e[1] for e in edges)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*counts, *([0] * len(edges))], pa.int64())], names=["a", "b", "links"])

    found = stored(_blocked(grouped, sizes, "g", ["cid", "n", "vector"]).mapInArrow(compare, "a long, b long, links long"))
    links = scratch.keep(found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")))
    joined = scratch.keep(components(found.where("b is not null").select("a", "b")))
    named = classes.select("cid", "rep", "n").join(joined, F.col("cid") == F.col("node"), "left").select("cid", "rep", "n", F.coalesce("component", "cid").alias("g"))
    least = named.groupBy("g").agg(F.min("rep").alias("least"))
    named = named.join(least, "g").join(links, F.col("cid") == F.col("a"), "left").select("cid", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = each.select("vec_id", "cid").join(named, "cid", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


#: All pairs of one label, and what can be reached from each vector.
ORACLE_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::double[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS s, b.vec_id AS d FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.d, r.root FROM r JOIN l ON l.s = r.node),
 c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node)
 SELECT vec_id, (SELECT count(*) FROM l WHERE l.s = c.vec_id)::bigint AS n_links, component_id, vec_id = component_id AS kept FROM c"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

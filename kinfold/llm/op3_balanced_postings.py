"""Approximate nearest neighbours over balanced posting lists.

Fitting: a bounded sample is split in two again and again, at the median along
the line between two centres, so lists come out balanced; the parts' means are
the centroids. Centroids are linked to their nearest ones in a graph that is held
in memory and searched best-first; their number grows with the table up to a fixed
bound, so the graph that goes to the executors is at most a few MB. Beyond that
bound lists grow with the table, in blocks over as many tasks.

Indexing: every vector finds its nearest centroids by the graph. It goes to the
list of the nearest one and, as a boundary vector, to the lists of ``COPIES`` others
that are almost as near.

Searching: a query takes the lists whose centroid is at most ``1 + prune`` times
as far as its nearest one; the graph is walked from near to far and left where
centroids are farther than that. The ratio is set on the sample: the least one by
which ``RECALL`` of the sample's own nearest neighbours would be met. Data with
clusters need few lists, uniform data in many dimensions a third and more. Lists
are cut into blocks, so no task holds a whole hot list; each task gives its nearest
few per query. Distances are computed in double precision on the original vectors.

Equal vectors are one class with its smallest ids (as many as can be asked for),
so copies are neither lost nor multiplied. Defined cases: vectors that are null,
empty, zero or hold a null or non-finite component take no part, nor do vectors
of another length than most, for which no distance is defined; with fewer than
``k`` other vectors all are returned; ties go to the smaller id; an empty table
gives no rows; repeated rows and ids count each; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import matrix, runs, stored, table, usable

K = 10
#: Bound of the sample that the centroids are fitted on.
SAMPLE = 20_000
#: Bounds of the number of centroids; between them, one for so many rows.
LEAST_LISTS, MOST_LISTS, LIST = 4, 4096, 192
#: Neighbours of a centroid in the graph, and width of the search for it.
DEGREE, BEAM = 16, 24
#: A boundary vector's other lists: at most so many, at most so much farther.
COPIES, BOUNDARY = 1, 0.01
#: The share of the sample's neighbours that the ratio must meet, and how many of
#: its rows ask for them.
RECALL, TUNERS = 0.94, 400
#: How much farther than the ratio the graph is walked, for centroids behind others.
SLACK = 0.05
#: Rows of answers that a task holds before it hands them on.
HELD = 100_000
#: Rows of a posting block, and queries that meet it at a time.
BLOCK, QUERIES = 2048, 512


def balanced(x: np.ndarray, leaf: int, seed: int = 3) -> np.ndarray:
    """Centroids of a balanced binary split with at most ``leaf`` rows a part."""
    order, out, todo = np.random.default_rng(seed), [], [x]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part.mean(0))
            continue
        a, b = part[order.choice(len(part), 2, replace=False)]
        for _ in range(4):
            side = part @ (b - a) > (b @ b - a @ a) / 2
            if side.all() or not side.any():
                break
            a, b = part[~side].mean(0), part[side].mean(0)
        rank = np.argsort(part @ (b - a), kind="stable")
        half = len(part) // 2
        todo += [part[rank[:half]], part[rank[half:]]]
    return np.array(out)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` and ``b``, good enough for choosing lists."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


class Graph:
    """Centroids, each linked to its nearest ones, searched best-first."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.x = centroids
        self.square = (centroids * centroids).sum(1)
        n = len(centroids)
        near = np.concatenate([np.argsort(distances(centroids[i : i + 256], centroids), 1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 256)]) if n > 1 else np.zeros((1, 1), np.int64)
        # Long links keep the graph in one piece.
        far = np.random.default_rng(n).integers(0, n, (n, 4))
        self.links = np.concatenate([near, far], 1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 24)).astype(int))
        self.prune = 0.0

    def _far(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.square[at] - 2 * np.einsum("rd,rkd->rk", q, self.x[at]), 0))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found for each row of ``q``: numbers
        and distances, nearest first; -1 and inf where fewer were met. Rows hold
        ``width`` centroids each, whatever their number."""
        ids = np.full((len(q), width), -1)
        far = np.full((len(q), width), np.inf)
        done = np.ones((len(q), width), bool)
        live, new = np.arange(len(q)), np.broadcast_to(self.entries, (len(q), len(self.entries)))
        while len(live):
            every = np.concatenate([ids[live], new], 1)
            d = np.concatenate([far[live], self._far(q[live], new)], 1)
            read = np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
            order = np.argsort(every, 1, kind="stable")  # of equal ones, that of the pool comes first
            named = np.take_along_axis(every, order, 1)
            again = np.zeros(named.shape, bool)
            again[:, 1:] = named[:, 1:] == named[:, :-1]
            rows = np.arange(len(live))[:, None]
            d[rows, np.where(again, order, order[:, :1])] = np.where(again, np.inf, d[rows, order[:, :1]])
            best = np.argsort(d, 1, kind="stable")[:, :width]
            ids[live], far[live], done[live] = (np.take_along_axis(c, best, 1) for c in (every, d, read))
            done[live] |= ~np.isfinite(far[live])
            open_ = ~done[live]
            some = open_.any(1)
            live, open_ = live[some], open_[some]
            if len(live):
                at = np.argsort(~open_, 1, kind="stable")[:, :4]  # the nearest unread; where fewer are left, nearest read ones again
                done[live[:, None], at] = True
                new = self.links[np.maximum(ids[live[:, None], at], 0)].reshape(len(live), -1)
        return np.where(np.isfinite(far), ids, -1), far

    def within(self, q: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[int]:
        """Lists of one query, nearest first: those at most ``1 + ratio`` times as far
        as the nearest, and as many as hold ``least`` vectors. The graph is walked
        from near to far; what lies beyond is not read."""
        seen = np.zeros(len(self.x), bool)
        seen[self.entries] = True
        heap = list(zip(self._far(q[None], self.entries[None])[0].tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(heap)
        read: list[tuple[float, int]] = []
        nearest, held = np.inf, 0
        while heap:
            d, at = heapq.heappop(heap)
            if d > (1 + ratio) * (1 + SLACK) * nearest and len(read) >= BEAM and held >= least:
                break
            nearest, held = min(nearest, d), held + int(sizes[at])
            read.append((d, at))
            new = self.links[at]
            new = np.unique(new[~seen[new]])
            if len(new):
                seen[new] = True
                for x in zip(self._far(q[None], new[None])[0].tolist(), new.tolist(), strict=True):
                    heapq.heappush(heap, x)
        out, held = [], 0
        for d, at in sorted(read):
            if d > (1 + ratio) * nearest and held >= least:
                break
            out.append(at)
            held += int(sizes[at])
        return out


def tuned(graph: Graph, x: np.ndarray, k: int, recall: float = RECALL) -> float:
    """The least ratio at which ``recall`` of the ``k`` nearest rows of ``x`` of
    ``TUNERS`` of its rows stand in a list that is searched. Of a sample, ``k`` is as
    much smaller as it has fewer rows than the table."""
    ask = np.random.default_rng(6).permutation(len(x))[:TUNERS]
    needed = []
    for i in range(0, len(ask), 50):
        part = ask[i : i + 50]
        d = distances(x[part], x)
        d[np.arange(len(part)), part] = np.inf
        near = np.argsort(d, 1)[:, : min(k, len(x) - 1)]
        to = distances(x[part], graph.x)
        for r in range(len(part)):
            lists: dict[int, list[int]] = {}
            for row, at in _lists(graph, x[near[r]]):
                lists.setdefault(row, []).append(at)
            needed += [to[r, at].min() / max(to[r].min(), 1e-12) - 1 for at in lists.values()]
    return float(np.quantile(needed, recall)) + 1e-9 if needed else 0.0


def fit(classes: DataFrame, rows: int, dims: int, sample: int = SAMPLE, lists: int | None = None, k: int = K) -> Graph:
    """The graph of centroids for ``rows`` vectors of ``dims`` components, with the
    ratio to search it by."""
    lists = lists or int(min(MOST_LISTS, max(LEAST_LISTS, rows // LIST)))
    spread = F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1_000_000))
    chosen = classes.where(spread < int(min(1.0, sample / max(1, rows)) * 1_000_000) + 1).select("v")
    x = np.array([r["v"] for r in itertools.islice(chosen.toLocalIterator(), 2 * sample)], float).reshape(-1, dims)
    x = x[np.lexsort(x.T)] if len(x) else np.zeros((1, dims))
    x = x if len(x) <= sample else x[np.random.default_rng(1).permutation(len(x))[:sample]]
    graph = Graph(balanced(x, max(1, len(x) // lists)))
    graph.prune = tuned(graph, x, max(1, -(-k * len(x) // max(rows, 1))))
    return graph


def _lists(graph: Graph, x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, list) of the lists that each row of ``x`` is posted to."""
    for i in range(0, len(x), 512):
        at, d = graph.search(x[i : i + 512], BEAM)
        near = (at >= 0) & (d <= (1 + BOUNDARY) * d[:, :1])
        near[:, 0], near[:, COPIES + 1 :] = True, False
        r, c = np.nonzero(near)
        yield from zip((i + r).tolist(), at[r, c].tolist(), strict=True)


def _probes(graph: Graph, x: np.ndarray, prune: float, sizes: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(row, list) of the lists that each row of ``x`` searches."""
    for r in range(len(x)):
        for at in graph.within(x[r], prune, sizes, least):
            yield r, at


def _best(parts: list[tuple], most: int) -> tuple:
    """The ``most`` nearest rows of each query out of parts ``(q, cid, first, score)``."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, cid, first, score = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((cid, first, score, q))
    q = q[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = order[rank < most]
    return q[rank < most], cid[keep], first[keep], score[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, prune: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of ``vectors``
    that were found for each row of ``queries``, its own row left out. ``prune``:
    the ratio to search by, else that set on the sample."""
    narrow = all(df.schema[vector].dataType.simpleString() == "array<float>" for df in (vectors, queries))
    kind, code = ("array<float>", "<f4") if narrow else ("array<double>", "<f8")  # as wide as the input

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(usable("v") & F.col("id").isNotNull())
        return rows.withColumn("cid", F.xxhash64("v"))

    every, asked = clean(vectors), clean(queries)
    # The few smallest ids of each class; a rank filter, so tasks drop the others before the shuffle.
    least = every.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = stored(least.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    dims = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    size, rows = dims[0]["d"], dims[0]["n"]
    classes = classes.where(F.size("v") == size)
    asked = asked.where(F.size("v") == size)
    graph = fit(classes, rows, size, k=k)
    prune = graph.prune if prune is None else prune

    def assign(pick, probe: int):
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in frames:
                for start in range(0, f.num_rows, 1024):
                    part = f.slice(start, 1024)
                    own = np.array(part.column(1).flatten(), code).reshape(part.num_rows, -1)
                    found = list(pick(own.astype(float)))
                    if found:
                        at, lists = (np.array(c) for c in zip(*found, strict=True))
                        raw = [r.tobytes() for r in own]
                        for i in range(0, len(at), 4096):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(lists[i : i + 4096], pa.int64()), pa.array(np.full(len(at[i : i + 4096]), probe), pa.int64()), part.column(0).take(pa.array(at[i : i + 4096])), part.column(2).take(pa.array(at[i : i + 4096])), pa.array([raw[j] for j in at[i : i + 4096]], pa.binary())],
                                names=["list", "probe", "cid", "first", "vector"],
                            )

        return run

    schema = "list long, probe long, cid long, first long, vector binary"
    posted = stored(classes.select("cid", "v", F.element_at("ids", 1).alias("first")).mapInArrow(assign(lambda x: _lists(graph, x), 1), schema))
    wanted = asked.groupBy("cid").agg(F.first("v").alias("v")).select("cid", "v", F.lit(0).cast("long").alias("first"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"))
    held = np.zeros(len(graph.x), np.int64)
    for r in sizes.collect():  # at most MOST_LISTS rows
        held[r["list"]] = r["n"]
    probed = stored(wanted.mapInArrow(assign(lambda x: _probes(graph, x, prune, held, (COPIES + 1) * (k + 1)), 0), schema))
    sizes = sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    q_sizes = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("turns"))
    both = sizes.join(q_sizes, "list")
    block, turn = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")), F.pmod(F.xxhash64("cid", F.lit(2)), F.col("turns"))
    counted = F.sequence(F.lit(0).cast("long"), F.col("turns") - 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = posted.join(both, "list").select("list", block.alias("block"), F.explode(counted[0]).alias("turn"), "probe", "cid", "first", "vector")
    right = probed.join(both, "list").select("list", F.explode(counted[1]).alias("block"), turn.alias("turn"), "probe", "cid", "first", "vector")
    tasks = left.unionByName(right).repartition("list", "block", "turn").sortWithinPartitions("list", "block", "turn")

    most = (COPIES + 1) * (k + 1)

    def nearest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _best([], most)
        for group in runs(frames, 3):
            probe = group["probe"].to_numpy()
            cid, first, x = group["cid"].to_numpy(), group["first"].to_numpy(), matrix(group["vector"], code)
            rows_, ask = np.flatnonzero(probe == 1), np.flatnonzero(probe == 0)
            if not len(rows_) or not len(ask):
                continue
            out_q, out_c, out_f, out_d = [], [], [], []
            y, names, low = x[rows_], cid[rows_], first[rows_]
            for q in ask:
                d = np.sqrt(((y - x[q]) ** 2).sum(1))
                at = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                at = at[np.lexsort((low[at], d[at]))][: k + 1]
                out_q.append(np.full(len(at), cid[q]))
                out_c.append(names[at])
                out_f.append(low[at])
                out_d.append(d[at])
            held = _best([held, *zip(out_q, out_c, out_f, out_d)], most)
            if len(held[0]) > HELD:  # many queries: what there is goes on as it is
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["q", "cid", "first", "score"])
                held = _best([], most)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["q", "cid", "first", "score"])

    # A class stands in COPIES + 1 lists at most, so tasks can drop all but the nearest few
    # of a query before the shuffle; ids of classes are fetched for what is left.
    near = Window.partitionBy("q").orderBy("score", "first", "cid")
    found = tasks.mapInArrow(nearest, "q long, cid long, first long, score double")
    found = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= most)
    found = found.groupBy("q", "cid").agg(F.min("score").alias("score"), F.min("first").alias("first"))
    found = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    found = found.join(classes.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    found = stored(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1))
    mine = asked.select(F.col("id").alias("query_id"), F.col("cid").alias("q")).join(found.drop("r"), "q").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))

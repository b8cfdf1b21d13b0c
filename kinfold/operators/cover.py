"""Greedy star cover of a neighbour table.

Vertices are taken in ascending order. A vertex's neighbours that no group has
yet form its group, together with itself even if it is in one already; a lone
vertex forms a group only if it has several paths. Groups are no partition: a
member of one group can be the parent of another.

What one vertex does only depends on its connected component, so components are
worked on side by side. Where the table has every edge from both sides, no walk is
needed: the smallest neighbour of each vertex says which group takes it (``stars``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.graph import components
from kinfold.sources.scratch import stored


def greedy(ids: list[int], near: dict[int, list[int]], copies: dict[int, int], evict: bool = False) -> list[tuple[int, int]]:
    """``(group, member)`` of one component."""
    done: set[int] = set()
    gone: set[int] = set()
    out = []
    for v in sorted(ids):
        left = {u for u in near.get(v, ()) if u not in done}
        if not left:
            continue
        left.add(v)
        if len(left) == 1 and copies.get(v, 1) < 2:
            if evict:
                gone.add(v)
            continue
        out += [(v, u) for u in sorted(left) if u not in gone]
        done |= left
    return out


def star_cover(edges: DataFrame, nodes: DataFrame, evict: bool = False) -> DataFrame:
    """``(group_id, member)`` for ``edges (src, dst)`` and ``nodes (id, copies)``.

    ``evict`` leaves out the paths of lone vertices that were passed over before
    a later parent listed them. Groups with one path in all are dropped.
    """
    label = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    # A vertex without neighbours needs no walk: its group is itself, if it has copies.
    alone = nodes.join(label, F.col("id") == F.col("node"), "left_anti").where("copies > 1").select(F.col("id").alias("group_id"), F.col("id").alias("member"))
    named = nodes.join(label, F.col("id") == F.col("node")).select("id", "copies", "component")
    lists = edges.groupBy("src").agg(F.collect_list("dst").alias("near"))
    rows = named.join(lists, F.col("id") == F.col("src"), "left").select("component", "id", "copies", "near")

    def cover(f: pd.DataFrame) -> pd.DataFrame:
        ids = f["id"].tolist()
        near = {k: list(v) if v is not None else [k] for k, v in zip(ids, f["near"], strict=True)}
        copies = dict(zip(ids, f["copies"].tolist(), strict=True))
        found = greedy(ids, near, copies, evict)
        return pd.DataFrame(found, columns=["group_id", "member"]).astype("int64")

    found = rows.groupBy("component").applyInPandas(cover, "group_id long, member long").unionByName(alone)
    sizes = found.join(nodes, F.col("member") == F.col("id")).groupBy("group_id").agg(F.sum("copies").alias("paths")).where("paths > 1").select("group_id")
    return found.join(sizes, "group_id", "left_semi")


def stars(nodes: DataFrame) -> DataFrame:
    """``(group_id, member, whole, passed)``: the groups of ``greedy`` over a table with
    all edges in both directions, for ``nodes (id, copies, near)`` with the smallest other
    neighbour, if any.

    A vertex is taken by its first neighbour if that comes before it: nobody else has
    seen it by then. One that comes before all its neighbours takes itself if it has
    copies or is the first neighbour of another; else it is passed over, and taken by
    its first neighbour later (``passed``). A parent that another group has taken
    stands in its own group too, but not ``whole``: of a class of vertices with the same
    neighbours, each other's among them, all but the smallest were taken with it.
    """
    heads = nodes.where("near < id").select(F.col("near").alias("id")).distinct().withColumn("leads", F.lit(True))
    leads = F.col("leads").isNotNull() | (F.col("copies") > 1)
    before = F.coalesce(F.col("near") < F.col("id"), F.lit(False))
    group = F.when(~before & leads, F.col("id")).otherwise(F.col("near"))
    taken = stored(nodes.join(heads, "id", "left").select(group.alias("group_id"), F.col("id").alias("member"), F.lit(True).alias("whole"), (~before & ~leads).alias("passed")).where("group_id is not null"))
    parents = taken.select(F.col("group_id").alias("member")).distinct()
    again = taken.where("group_id <> member").join(parents, "member", "left_semi")
    return taken.unionByName(again.select(F.col("member").alias("group_id"), "member", F.lit(False).alias("whole"), F.lit(False).alias("passed")))

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.sources.scratch import stored, temporary


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges ``(a long, b long)``.

    Alternating large-star and small-star steps: every step is a grouped minimum
    and a join, so a vertex with very many edges is pre-aggregated and its join
    partition can be split; nothing is gathered per component. Returns
    ``(node, component)`` for the nodes that have edges; the component is its
    smallest node. No edges give no rows.
    """
    with temporary() as outer:
        now, mark = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
        while True:
            both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
            seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if (seen["n"], seen["h"]) == mark:
                break
            mark = (seen["n"], seen["h"])
        stars = now.groupBy("a").agg(F.min("b").alias("c"))
        return outer.keep(stars.select(F.col("a").alias("node"), F.col("c").alias("component")).unionByName(stars.select(F.col("c").alias("node"), F.col("c").alias("component")).distinct()))

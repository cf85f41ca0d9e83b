"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a minimum per node (combined map-side, so a hub costs one row per task) and a join of the links with
those minima, which adaptive execution splits where a hub is hot. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.filter("v > u").join(_minima(both), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long, not null). Returns (node, root): root is the smallest node of node's component.

    Only nodes with a link to another node are listed. No links give no rows; repeated and self links are harmless.
    """
    now = common.written(links.select("u", "v").filter("u <> v").distinct(), "links")
    state = _state(now)
    while state[0]:
        before, now = now, common.written(_small(_large(now)), "links")
        was, state = state, _state(now)
        common.drop(before)
        if was == state:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())

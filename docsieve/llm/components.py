"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a group-by and a join on the node, so no component ever meets in one task. A hot node's rows are combined
before the shuffle of the group-by, and its join needs no shuffle: nodes with more than a hundred-thousandth of all links
(at least 64) are at most 100,000, and their smallest neighbours go to every task. Steps are written to the shared
folder, older ones deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined, stored


def _with_least(links: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Links u, v with m, the smallest v of u; and the table of it, to be deleted when the step is written."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many")), "least", most=total)
    return joined(links, least, "u", "many", total), least


def _large_star(e: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows, least = _with_least(both, 2 * total)
    return rows.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), least


def _small_star(e: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    rows, least = _with_least(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total)
    moved = rows.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v"), least


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)``, any direction, loops and repeats allowed, to ``node, root``: each linked node with the
    smallest node reachable. A node without a link to another has no row; no edges give no rows."""
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _signature(now)
    while before[0]:
        large, one = _large_star(now, before[0])
        large = stored(large.distinct(), "links", most=before[0])
        small, two = _small_star(large, before[0])
        after = stored(small.distinct(), "links", most=2 * before[0])
        for old in (now, large, one, two):
            dropped(old)
        now, signature = after, _signature(after)
        if signature == before:
            break
        before = signature
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

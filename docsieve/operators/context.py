"""Context windows: runs of consecutive chunks whose weighted mean relevance is high.

Frames are read from windows over each document's chunks, so a document is the unit of work and nothing is iterated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(scores: Column) -> Column:
    """Mean with weights growing evenly from 0.8 to 1.0 by position; of one score, the score."""
    n = F.size(scores)
    weights = F.transform(scores, lambda _, i: F.when(n > 1, 0.8 + 0.2 * i / (n - 1)).otherwise(0.8))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return total(F.zip_with(scores, weights, lambda a, b: a * b)) / total(weights)


def minimal_windows(chunks: DataFrame, size: int = 2, threshold: float = 0.6, by: str = "document_id") -> DataFrame:
    """``by, start_idx, end_idx, relevance`` of windows of ``size`` chunks (chunk_index from 0, score) at the threshold."""
    w = Window.partitionBy(by).orderBy("chunk_index").rowsBetween(0, size - 1)
    rows = chunks.select(by, F.col("chunk_index").alias("start_idx"), F.collect_list("score").over(w).alias("s")).filter(F.size("s") == size)
    rows = rows.select(by, "start_idx", (F.col("start_idx") + size - 1).alias("end_idx"), weighted_mean(F.col("s")).alias("relevance"))
    return rows.filter(F.col("relevance") >= threshold)


def expanded_windows(chunks: DataFrame, size: int = 2, threshold: float = 0.6, overlap: int = 1, most: int = 8, by: str = "document_id") -> DataFrame:
    """Minimal windows, each widened by ``overlap`` to the left or right if that raises its relevance; left is tried
    first and the right must beat what the left gave."""
    part = Window.partitionBy(by).orderBy("chunk_index")
    frame = lambda a, b: F.collect_list("score").over(part.rowsBetween(a, b))
    rows = chunks.select(
        by, F.col("chunk_index").alias("i"), frame(0, size - 1).alias("own"), frame(-overlap, size - 1).alias("left"), frame(0, size - 1 + overlap).alias("right")
    ).filter(F.size("own") == size)
    rows = rows.withColumn("s0", weighted_mean(F.col("own"))).filter(F.col("s0") >= threshold)
    grown = lambda c: (F.size(c) > size) & (F.size(c) <= most)
    rows = rows.withColumn("s1", F.when(grown("left"), weighted_mean(F.col("left")))).withColumn("s2", F.when(grown("right"), weighted_mean(F.col("right"))))
    use_left = F.coalesce(F.col("s1") > F.col("s0"), F.lit(False))
    best = F.when(use_left, F.col("s1")).otherwise(F.col("s0"))
    use_right = F.coalesce(F.col("s2") > best, F.lit(False))
    start = F.when(use_left & ~use_right, F.col("i") - (F.size("left") - size)).otherwise(F.col("i"))
    end = F.when(use_right, F.col("i") + F.size("right") - 1).otherwise(F.col("i") + size - 1)
    return rows.select(by, start.alias("start_idx"), end.alias("end_idx"), F.when(use_right, F.col("s2")).otherwise(best).alias("relevance"))


def merged_windows(windows: DataFrame, chunks: DataFrame, overlap: int = 1, by: str = "document_id") -> DataFrame:
    """Windows that touch within ``overlap`` as one, scored anew from its chunks; adds chunk count and mean length.

    Islands: a window starts one if it begins behind the largest end before it plus the overlap.
    """
    order = Window.partitionBy(by).orderBy("start_idx", "end_idx")
    before = F.max("end_idx").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.withColumn("new", (before.isNull() | (F.col("start_idx") > before + overlap)).cast("int"))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    bounds = marked.withColumn("w", island).groupBy(by, "w").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"))
    inside = bounds.join(chunks.select(by, "chunk_index", "score", "length"), by).filter(F.col("chunk_index").between(F.col("start_idx"), F.col("end_idx")))
    scored = inside.groupBy(by, "start_idx", "end_idx").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "score"))).alias("s"), F.count("*").alias("chunk_count"), F.avg("length").alias("avg_length")
    )
    return scored.select(by, "start_idx", "end_idx", "chunk_count", "avg_length", weighted_mean(F.col("s.score")).alias("relevance"))

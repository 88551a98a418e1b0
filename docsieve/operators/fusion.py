"""Fusion and reordering of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import numbered


def fusion_weights(types: dict[str, float] | None = None, bm25: float = 0.3, vector: float = 0.7) -> tuple[float, float]:
    """Weights moved by a query's class probabilities: factual favours BM25, conceptual the vectors; they sum to 1."""
    types = types or {"general": 1.0}
    shift = 0.1 * (types.get("factual", 0.0) - types.get("conceptual", 0.0))
    b, v = bm25 + shift, vector - shift
    return b / (b + v), v / (b + v)


def hybrid_fusion(vector: DataFrame, bm25: DataFrame, weights: tuple[float, float], min_score: float = 0.0, limit: int | None = None, normalise: bool = False) -> DataFrame:
    """``id, vector_score, bm25_score, score`` of lists (id, score); a missing side counts 0. Scores are raw, or with
    ``normalise`` divided by their list's largest."""
    if normalise:
        vector, bm25 = (x.crossJoin(F.broadcast(x.agg(F.max("score").alias("_top")))).select("id", F.try_divide("score", "_top").alias("score")) for x in (vector, bm25))
    v, b = vector.select("id", F.col("score").alias("vector_score")), bm25.select("id", F.col("score").alias("bm25_score"))
    j = v.join(b, "id", "full_outer").fillna(0.0, ["vector_score", "bm25_score"])
    j = j.withColumn("score", weights[0] * F.col("bm25_score") + weights[1] * F.col("vector_score")).filter(F.col("score") >= min_score)
    return j if limit is None else j.orderBy(F.desc("score"), "id").limit(limit)


def summed(*lists: tuple[DataFrame, float]) -> DataFrame:
    """The same fusion as a sum over the union of weighted lists."""
    rows = None
    for df, w in lists:
        part = df.select("id", (F.col("score") * w).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.sum("score").alias("score"))


def blended(new: Column, old: Column) -> Column:
    """A cross-encoder's score with the score before."""
    return 0.7 * new + 0.3 * old


def reranked(rows: DataFrame) -> DataFrame:
    """Adds ``final_score`` = 0.4 semantic + 0.3 keyword + 0.2 entity + 0.1 original, the original divided by the list's
    largest if that is above 0."""
    top = rows.agg(F.max("original").alias("_top"))  # a one-row join instead of a window over everything
    j = rows.crossJoin(F.broadcast(top))
    original = F.when(F.col("_top") > 0, F.col("original") / F.col("_top")).otherwise(F.col("original"))
    return j.withColumn("final_score", 0.4 * F.col("semantic") + 0.3 * F.col("keyword") + 0.2 * F.col("entity") + 0.1 * original).drop("_top")


def entity_overlap(query: Column, chunk: Column) -> Column:
    """Share of the query's distinct entities that the chunk holds."""
    q, c = F.array_distinct(query), F.array_distinct(chunk)
    return F.when((F.size(q) == 0) | (F.size(c) == 0), 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def continuity_boosted(rows: DataFrame, factor: float = 1.1, gap: int = 1000) -> DataFrame:
    """score * factor where the document's previous row (by start) ends at most ``gap`` before this one starts."""
    before = F.lag("end_idx").over(Window.partitionBy("document_id").orderBy("start_idx", "id"))
    d = F.col("start_idx") - before
    return rows.withColumn("score", F.when(d.between(0, gap), F.col("score") * factor).otherwise(F.col("score")))


def with_neighbours(seeds: DataFrame, chunks: DataFrame, most: int = 2, gap: int = 1000, decay: float = 0.9) -> DataFrame:
    """Seeds (id, document_id, start_idx, pos, score) and up to ``most`` chunks near each, with decayed scores; a chunk
    stands once, as its first appearance."""
    s = seeds.select(F.col("document_id"), F.col("id").alias("seed"), F.col("start_idx").alias("at"), "pos", "score")
    near = chunks.select("id", "document_id", "start_idx").join(s, "document_id").filter((F.col("id") != F.col("seed")) & (F.abs(F.col("start_idx") - F.col("at")) <= gap))
    w = Window.partitionBy("seed").orderBy("start_idx", "id")
    near = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    rows = seeds.select("id", "document_id", "pos", F.lit(0).alias("n"), "score").unionByName(near.select("id", "document_id", "pos", "n", (F.col("score") * decay).alias("score")))
    first = Window.partitionBy("id").orderBy("pos", "n")
    return rows.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` from 1 in an order, by ranges: no task holds all rows."""
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = rows.select("*", *order)
    return numbered(keyed, keys, 1, "rank").withColumn("rank", F.col("rank").cast("int")).drop(*keys)


def round_robin(rows: DataFrame, section: str = "section", score: str = "score") -> DataFrame:
    """Adds ``rank``: the best of every section in order of the sections' first rows, then the second best, and so on."""
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(section).orderBy(F.desc(score), "pos")))
    first = rows.groupBy(section).agg(F.min("pos").alias("_f"))
    return ranked(rows.join(first, section), F.col("_r").alias("_k0"), F.col("_f").alias("_k1")).drop("_r", "_f")


def first_per_section(rows: DataFrame, section: str = "section", score: str = "score") -> DataFrame:
    """Adds ``rank``: each section's first row in order, then the rest by score."""
    first = rows.groupBy(section).agg(F.min("pos").alias("_f"))
    rows = rows.join(first, section).withColumn("_l", F.col("pos") == F.col("_f"))
    lead = F.when(F.col("_l"), F.col("pos"))
    return ranked(rows, (~F.col("_l")).alias("_k0"), lead.alias("_k1"), (-F.col(score)).alias("_k2"), F.col("pos").alias("_k3")).drop("_l", "_f")

"""Vector search over chunk tables.

A query vector is a literal in the plan, so a search is one scan with a pushed-down filter and a top-k cut before the
shuffle (TakeOrderedAndProject). Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V


@dataclass(frozen=True)
class Filters:
    """Restrictions of a search; None means no restriction."""

    document_ids: Sequence[int] | None = None
    content_types: Sequence[str] | None = None
    created: tuple[str, str] | None = None  # inclusive
    metadata: dict[str, str] | None = None  # keys of the JSON column ``metadata``, compared as text


def validated(dimension: int, k: int, threshold: float, expected: int | None = None) -> None:
    if expected is not None and dimension != expected:
        raise ValueError(f"the query has {dimension} dimensions, not {expected}")
    if k <= 0:
        raise ValueError("k must be positive")
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be from 0 to 1")


def restricted(df: DataFrame, f: Filters) -> DataFrame:
    """Applied to chunks joined with their documents; Catalyst pushes each part to its scan."""
    if f.document_ids is not None:
        df = df.filter(F.col("document_id").isin(list(f.document_ids)))
    if f.content_types is not None:
        df = df.filter(F.col("content_type").isin(list(f.content_types)))
    if f.created is not None:
        df = df.filter(F.col("created_at").between(*(F.lit(x).cast("timestamp") for x in f.created)))
    for key, value in (f.metadata or {}).items():
        df = df.filter(F.get_json_object("metadata", f"$.{key}") == str(value))
    return df


def similarity_search(
    chunks: DataFrame,
    documents: DataFrame,
    query: Sequence[float],
    k: int = 5,
    threshold: float | None = None,
    filters: Filters = Filters(),
    as_of: str | None = None,
    rerank: bool = False,
) -> DataFrame:
    """Chunks (id, document_id, embedding, token_count) with ``similarity > threshold`` (default 0.5), best k.

    With ``as_of`` there is a ``combined_score`` of similarity, recency and token density; ``rerank`` fetches 2k by
    similarity and cuts to k by that score.
    """
    threshold = 0.5 if threshold is None else threshold
    validated(len(query), k, threshold)
    joined = restricted(chunks.join(documents, "document_id"), filters)
    found = joined.withColumn("similarity", V.cosine(V.doubles(F.col("embedding")), V.literal(query)))
    found = found.filter(F.col("similarity") > threshold)
    if as_of is not None:
        at = F.lit(as_of).cast("timestamp")
        parts = V.recency(F.col("created_at"), at), V.token_density(F.col("token_count"))
        found = found.withColumn("combined_score", V.combined_score(F.col("similarity"), *parts))
    found = found.drop("embedding").orderBy(F.desc("similarity"), "id").limit(2 * k if rerank else k)
    return found.orderBy(F.desc("combined_score"), "id").limit(k) if rerank else found


def distance_search(chunks: DataFrame, query: Sequence[float], query_type: str = "factual", k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Chunks with cosine distance *below* the threshold; the query type changes k and the threshold.

    Smaller thresholds are stricter here, though the factors 0.8 and 0.9 were meant to be lenient: kept as it is.
    """
    factor, times = {"factual": (1.0, 1), "analytical": (0.8, 2), "summary": (0.9, 1.5)}[query_type]
    distance = 1 - V.cosine(V.doubles(F.col("embedding")), V.literal(query))
    found = chunks.withColumn("distance", distance).filter(F.col("distance") < threshold * factor)
    return found.drop("embedding").orderBy("distance", "id").limit(int(k * times))


def batch_search(chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.5, block: int = 4096) -> DataFrame:
    """``qid, id, similarity``: the best k of each of many queries (qid, v) in one pass over the chunks (id, embedding).

    Queries are read in blocks of about ``block`` and sent to every task, so what is sent has a bound; a task scores a batch
    of chunks against the block as one product and keeps k a query."""
    n = queries.count()
    parts, found = max(1, -(-n // block)), None
    for part in range(parts):
        mine = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).select("qid", V.doubles(F.col("v")).alias("v")).toPandas()
        if not len(mine):
            continue
        q = np.stack(mine["v"].to_numpy())
        qids, q = mine["qid"].to_numpy(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def score(batches, qids=qids, q=q):  # noqa: ANN001, ANN202
            for pdf in batches:
                pdf = pdf.sort_values("id")
                m = np.stack(pdf["v"].to_numpy())
                sim, ids = q @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T, pdf["id"].to_numpy()
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(sim, best, 1)
                keep = value > threshold
                yield pd.DataFrame({"qid": np.repeat(qids, keep.sum(1)), "id": ids[best[keep]], "similarity": value[keep]})

        rows = chunks.filter(F.col("embedding").isNotNull()).select("id", V.doubles(F.col("embedding")).alias("v")).mapInPandas(score, "qid long, id long, similarity double")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return queries.sparkSession.createDataFrame([], "qid long, id long, similarity double")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def mean_vectors(df: DataFrame, key: str, vector: str, weight: Column | None = None, normalise: bool = False) -> DataFrame:
    """Element-wise (weighted) mean of each key, combined before the shuffle; a zero mean is not normalised."""
    w = F.lit(1.0) if weight is None else weight
    each = df.select(key, w.alias("w"), F.posexplode(V.doubles(F.col(vector))).alias("pos", "x"))
    sums = each.groupBy(key, "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    whole = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    whole = whole.select(key, F.col("v.x").alias("mean"))
    if normalise:
        n = V.norm(F.col("mean"))
        whole = whole.withColumn("mean", F.when(n > 0, F.transform("mean", lambda x: x / n)).otherwise(F.col("mean")))
    return whole


def adjacent_similarity(chunks: DataFrame) -> DataFrame:
    """Similarity of each chunk with the next of its document: one window instead of a self join."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    nxt = chunks.select(
        "document_id", "chunk_index", "embedding", F.lead("chunk_index").over(w).alias("next_index"), F.lead("embedding").over(w).alias("next")
    ).filter(F.col("next_index") == F.col("chunk_index") + 1)
    sim = V.cosine(V.doubles(F.col("embedding")), V.doubles(F.col("next")))
    return nxt.select("document_id", "chunk_index", sim.alias("similarity"))


def similar_pairs(df: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding", rows_a_block: int = 4096) -> DataFrame:
    """``a, b, similarity`` of all pairs a < b above the threshold, exactly.

    Rows are dealt to blocks by hash; each pair of blocks is one task of a matrix product. No side is broadcast, a task
    holds two blocks, and a row is sent once for each block.
    """
    rows = df.select(F.col(id_col).alias("id"), V.doubles(F.col(vector_col)).alias("v")).filter("v is not null and id is not null")
    n = rows.count()
    blocks = max(1, -(-n // rows_a_block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "v", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        def side(k: int) -> tuple[np.ndarray, np.ndarray]:
            part = pdf[pdf["own"] == k]
            m = np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, 1))
            return part["id"].to_numpy(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        (ids, m), (others, o) = side(key[0]), side(key[1])
        if not len(ids) or not len(others):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        sim = m @ o.T
        i, j = np.nonzero(sim > threshold)
        a, b = ids[i], others[j]
        keep = a < b if key[0] == key[1] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": sim[i, j][keep]})

    return dealt.groupBy("p", "q").applyInPandas(product, "a long, b long, similarity double")

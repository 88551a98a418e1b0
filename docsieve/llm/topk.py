"""Exact top-k inner products by MaxScore over dense integer vectors.

A query's terms are the dimensions. In a shard (a batch of candidates held by dimension) a term's contribution lies
between two bounds, from the least and largest value of that dimension there. Shifted by the lower bounds all
contributions are positive, and terms whose upper bounds together stay below the query's threshold, its k-th best score
so far, are non-essential: no candidate gets in by them alone. A shard's candidates stand in blocks of alike vectors with
bounds of their own, so postings of the essential terms are traversed, strongest term first, only in blocks whose bounds
reach the threshold, and only while a candidate's bound still does; then the others are probed for what is left. Each task
keeps its k best a query; the shards' lists are merged by a ranking that is cut before and after its shuffle.

Queries are sent out in blocks of at most about ``block`` vectors. A block's result is written before the next block is
read, and what was broadcast for it is taken back: neither the driver nor the plan grows with the number of queries.

Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part. Shorter vectors
count as padded with zeros. A query never meets rows of its own id; equal rows of a query are asked once. Ties go to the
smaller id. Of repeated candidate rows each takes its own rank. An empty table gives no rows; only the two columns named
and those of the query condition are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stored

#: Terms traversed or probed between two looks at the bounds, and candidates in a block of a shard.
PROBE, BLOCK = 8, 64


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component as a double; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale).cast("double")))


class Shard:
    """A batch of candidates by dimension with each dimension's bounds, in all and in blocks of alike vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        plain = vectors.astype(float)
        above = plain > np.median(plain, axis=0)  # vectors on one side in the dimensions that vary most stand together
        strong = np.argsort(-np.var(plain, axis=0), kind="stable")[:12]
        order = np.lexsort((ids, *above[:, strong[::-1]].T))
        self.ids, rows = ids[order], vectors[order]
        self.columns = np.ascontiguousarray(rows.T)
        starts = np.arange(0, len(ids), BLOCK)
        self.block_low, self.block_high = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
        self.low, self.high = self.block_low.min(0), self.block_high.max(0)

    def search(self, q: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of at most k best with a score of ``least`` or more."""
        a, b = q * self.low, q * self.high
        lower, upper = np.minimum(a, b), np.maximum(a, b)
        spread_ = upper - lower
        order = np.argsort(-spread_, kind="stable")
        tail = np.append(np.cumsum(upper[order][::-1])[::-1], 0)  # the most that the terms from here on can give
        if least == -np.inf:
            alive, score = np.arange(len(self.ids)), q @ self.columns
        else:
            gain = np.append(np.cumsum(spread_[order][::-1])[::-1], 0)
            essential = int(np.searchsorted(-gain, -(least - lower.sum()), side="left"))  # the others can't lift a candidate to it
            if not essential:
                essential = len(order) if gain[0] + lower.sum() >= least else 0
                if not essential:
                    return self.ids[:0], np.zeros(0)
            reach = np.maximum(q * self.block_low, q * self.block_high).sum(1)
            blocks = np.nonzero(reach >= least)[0]
            alive = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            alive = alive[alive < len(self.ids)]
            score = np.zeros(len(alive), self.columns.dtype)
            at = 0
            while at < len(order) and len(alive):
                end = min(at + PROBE, essential if at < essential else len(order))
                terms = order[at:end]
                score = score + q[terms] @ self.columns[np.ix_(terms, alive)]
                fit = score + tail[end] >= least
                alive, score, at = alive[fit], score[fit], end
        other = self.ids[alive] != own
        ids, score = self.ids[alive][other], score[other]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


RESULT = "query_id long, rank int, vec_id long, score long"


def _search_block(candidates: DataFrame, sent, k: int) -> DataFrame:  # noqa: ANN001
    """Each task's k best of every query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, keys, queries = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in keys]
        for b in batches:
            if not b.num_rows:
                continue
            width = max(queries.shape[1], int(b.column(1).value_lengths().to_numpy().max()))
            asked = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
            vectors = _matrix(b.column(1), width)
            if np.abs(asked).max(initial=0) * np.abs(vectors).max(initial=0) * width >= 2**53:
                asked, vectors = asked.astype("int64").astype(object), vectors.astype("int64").astype(object)
            shard = Shard(b.column(0).to_numpy(), vectors)
            for i, own in enumerate(keys):
                ids, scores = best[i]
                more = shard.search(asked[i], own, k, scores[-1] if len(ids) == k else -np.inf)
                if len(more[0]):
                    ids, scores = np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]])
                    keep = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[keep], scores[keep]
        for i, (ids, scores) in enumerate(best):
            if len(ids):
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, numbers[i])), pa.array(np.full(n, keys[i])), pa.array(ids), pa.array([int(s) for s in scores], pa.int64())],
                    ["q", "query_id", "vec_id", "score"],
                )

    return candidates.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest inner products of each query row against all rows."""
    rows = df.select(F.col(id_col).alias("id"), quantised(F.col(vector_col)).alias("v"), is_query.alias("asks"))
    rows = rows.filter("id is not null and v is not null")
    asked = rows.filter("asks").select("id", "v").distinct()
    n = asked.count()
    blocks = max(1, -(-n // block))
    candidates, number, path = spread(rows.select("id", "v")), 0, None
    for part in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).orderBy("id").toArrow() if n else None
        if mine is None or not mine.num_rows:
            continue
        column = mine.column("v").combine_chunks()
        queries = _matrix(column, int(column.value_lengths().to_numpy().max()))
        keys = mine.column("id").to_numpy()
        sent = df.sparkSession.sparkContext.broadcast((np.arange(number, number + len(keys)), keys, queries))
        number += len(keys)
        path = stored(_merged(_search_block(candidates, sent, k), k), "best", path).stored_path
        sent.destroy()
    if path is None:
        return df.sparkSession.createDataFrame([], RESULT)
    return df.sparkSession.read.schema(RESULT).parquet(path)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The shards' lists to one a query."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

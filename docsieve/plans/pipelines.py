"""Whole flows: ingest of documents into tables, and answering a question from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import context, fusion, lexical, search, store
from ..operators.providers import Providers


@dataclass
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    rejected: DataFrame


def ingest(docs: DataFrame, providers: Providers = Providers(), first_id: int = 0) -> Ingested:
    """docs(filename, content, file_size) validated, split, counted and embedded; rejected rows keep their reason.

    Only numbering the documents shuffles; chunking and embedding stay in the scan's tasks.
    """
    checked = store.upload_checked(docs)
    rejected = checked.filter(F.col("reject_reason").isNotNull())
    p = T.chunk_params(F.col("content_type"), F.col("file_size"))
    pieces = T.chunk_sentences(F.col("content"), p["size"], p["overlap"])
    accepted, chunks = store.stored_documents(checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"), pieces, first_id)
    chunks = chunks.withColumn("embedding", providers.embed(F.col("content"))).withColumn("token_count", providers.count_tokens(F.col("content")))
    return Ingested(accepted, chunks, rejected)


def retrieve(chunks: DataFrame, question: str, query_vector: list[float], providers: Providers = Providers(), limit: int = 5, min_score: float = 0.0, rerank: bool = True) -> DataFrame:
    """Hybrid search at document grain: best chunk similarity and BM25 of the joined text, fused, cut, re-encoded."""
    similarity = V.cosine(V.doubles(F.col("embedding")), V.literal(query_vector))
    vector = chunks.groupBy(F.col("document_id").alias("id")).agg(F.max(similarity).alias("score")).orderBy(F.desc("score"), "id").limit(2 * limit)
    texts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), " ").alias("text"))
    asked = chunks.sparkSession.range(1).select(F.lit(0).alias("qid"), F.lit(question).alias("q"))
    words = lexical.Bm25(texts).search(asked, 2 * limit).select("id", "score")
    found = fusion.hybrid_fusion(vector, words, fusion.fusion_weights(providers.classify(question)), min_score, 2 * limit)
    if rerank:
        new = providers.cross_encode(F.lit(question), F.col("text"))
        found = found.join(texts, "id").withColumn("score", fusion.blended(new, F.col("score"))).drop("text")
    return found.orderBy(F.desc("score"), "id").limit(limit)


def context_windows(chunks: DataFrame, query_vector: list[float], threshold: float = 0.6) -> DataFrame:
    """Merged windows of the chunks' similarities, best first."""
    similarity = V.cosine(V.doubles(F.col("embedding")), V.literal(query_vector))
    rows = chunks.select("document_id", "chunk_index", similarity.alias("score"), F.length("content").alias("length"))
    return context.merged_windows(context.expanded_windows(rows, threshold=threshold), rows).orderBy(F.desc("relevance"), "document_id", "start_idx")


def answer(chunks: DataFrame, documents: DataFrame, question: str, query_vector: list[float], providers: Providers = Providers(), k: int = 5, threshold: float | None = None) -> DataFrame:
    """One row: question, context of the k best chunks as numbered blocks, prompt kind and the provider's answer."""
    found = search.similarity_search(chunks, documents, query_vector, k, threshold).limit(k)
    blocks = found.select(F.struct((-F.col("similarity")).alias("r"), "id", "content", "similarity").alias("x"))
    ordered = blocks.agg(F.array_sort(F.collect_list("x")).alias("x"))
    none = F.lit(None).cast("string")
    text = F.array_join(F.transform("x", lambda c, i: T.context_block(i + 1, none, none, c["content"], c["similarity"])), "\n")
    out = ordered.select(F.lit(question).alias("question"), text.alias("context"), T.prompt_kind(F.lit(question)).alias("prompt"))
    return out.withColumn("answer", T.format_answer(providers.answer(F.col("question"), F.col("context"))))

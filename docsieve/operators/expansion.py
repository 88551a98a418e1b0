"""Query expansion: synonyms from a table, semantic terms by embedding similarity, and their union with the query.

Queries are rows (qid, q, terms array); all steps are joins on qid or term and a cut at the best few before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .lexical import STOP_WORDS

#: Terms of the domain, candidates for queries that come without context.
DOMAIN_TERMS = (
    "algorithm", "database", "interface", "protocol", "framework", "architecture", "implementation", "configuration", "deployment",
    "optimization", "scalability", "performance", "security", "strategy", "analysis", "requirement", "specification", "solution",
    "integration", "workflow", "process", "management", "resource", "document", "content", "format", "structure", "metadata",
    "reference", "section", "chapter", "paragraph", "annotation",
)


def synonyms(queries: DataFrame, known: DataFrame, most: int = 5, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``qid, term, synonyms``: of each query's terms the first ``most`` other words that ``known(term, synonyms array)`` has
    for it, in lower case and without stop words; terms without any have no row."""
    terms = queries.select("qid", F.explode("terms").alias("term"))
    found = terms.join(known.select(F.lower("term").alias("term"), "synonyms"), "term")
    words = F.array_distinct(F.transform("synonyms", F.lower))
    kept = F.slice(F.filter(words, lambda w: (w != F.col("term")) & ~w.isin(*stop_words)), 1, most)
    return found.select("qid", "term", kept.alias("synonyms")).filter(F.size("synonyms") > 0)


def candidates(queries: DataFrame, context: DataFrame, terms_of: Callable[[Column], Column], domain: Sequence[str] = DOMAIN_TERMS) -> DataFrame:
    """``qid, term``: the distinct terms of the query's context rows (qid, content), or the domain's terms for a query
    without context, less the query's own terms."""
    seen = context.select("qid", F.explode(terms_of(F.col("content"))).alias("term")).distinct()
    seen = seen.join(queries.select("qid"), "qid", "left_semi")
    bare = queries.join(context.select("qid").distinct(), "qid", "left_anti")
    given = bare.select("qid", F.explode(F.array(*map(F.lit, domain))).alias("term"))
    return seen.unionByName(given).join(queries.select("qid", F.explode("terms").alias("term")), ["qid", "term"], "left_anti")


def semantic_terms(queries: DataFrame, of: DataFrame, embed: Callable[[Column], Column], least: float = 0.7, most: int = 5) -> DataFrame:
    """``qid, term, similarity, rank``: of the candidates ``of(qid, term)`` those with a cosine similarity of at least
    ``least`` to the query, the best ``most``, ties by term. A term is embedded once, however many queries it is for."""
    vectors = of.select("term").distinct().withColumn("v", embed(F.col("term")))
    j = of.join(vectors, "term").join(queries.select("qid", embed(F.col("q")).alias("qv")), "qid")
    j = j.select("qid", "term", V.cosine(V.doubles(F.col("v")), V.doubles(F.col("qv"))).alias("similarity")).filter(F.col("similarity") >= least)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 9)), "term")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def expanded(queries: DataFrame, syn: DataFrame, sem: DataFrame) -> DataFrame:
    """``qid, expanded, synonym_count, semantic_term_count``: the query, then synonyms by term, then semantic terms by rank,
    each once."""
    s = syn.groupBy("qid").agg(F.flatten(F.array_sort(F.collect_list(F.struct("term", "synonyms")))["synonyms"]).alias("s"))
    t = sem.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias("t"))
    none = F.array().cast("array<string>")
    j = queries.join(s, "qid", "left").join(t, "qid", "left").withColumns({"s": F.coalesce("s", none), "t": F.coalesce("t", none)})
    words = F.array_distinct(F.concat(F.array("q"), "s", "t"))
    return j.select("qid", F.array_join(words, " ").alias("expanded"), F.size("s").alias("synonym_count"), F.size("t").alias("semantic_term_count"))

"""Lexical ranking: BM25, TF-IDF cosine, cover density.

Corpus statistics are one aggregation of (document, term) counts. Per-query work filters to the query's terms before any
join, so the posting rows of a search are those of its terms alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.storage import stored

#: The query expander's stop words.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by", "from", "up", "about", "into", "over", "after")


def tokens(text: Column) -> Column:
    """White-space tokens, case-sensitive."""
    return F.filter(F.split(T.normalised(text), " "), lambda w: w != "")


class Bm25:
    """Okapi BM25 over ``docs(id, text)`` with the public defaults; negative IDFs become epsilon times the mean IDF.

    The index is two stored tables, made in one pass over the texts and read by every search: postings (term, id, tf, dl)
    and the vocabulary with document frequencies, IDFs and the corpus figures.
    """

    def __init__(self, docs: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25):
        self.k1, self.b = k1, b
        words = docs.select("id", tokens(F.col("text")).alias("w"))
        corpus = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
        # counted inside a document's row: a word costs a posting a document, not a shuffled row an occurrence
        each = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
        self.postings = stored(each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
        df = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        raw = df.crossJoin(F.broadcast(corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        raw = stored(raw, "frequencies")
        floor = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
        self.vocabulary = raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("term", "df", "avgdl", floor.alias("idf"))

    def idf(self) -> DataFrame:
        """``term, df, idf`` of the whole vocabulary."""
        return self.vocabulary.select("term", "df", "idf")

    def search(self, queries: DataFrame, k: int | None = 5) -> DataFrame:
        """``qid, id, score`` above 0 for ``queries(qid, q)``, best k of each; a repeated query term counts repeatedly."""
        asked = queries.select("qid", F.explode(tokens(F.col("q"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
        weighed = asked.join(self.vocabulary, "term")
        part = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl")))
        found = self.postings.join(weighed, "term").groupBy("qid", "id").agg(F.sum(F.col("times") * F.col("idf") * part).alias("score")).filter("score > 0")
        return found if k is None else best(found, k)


def best(scored: DataFrame, k: int, by: str = "qid", id_col: str = "id") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), id_col)
    return scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def ngrams(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased words of two or more letters or digits without stop words, and their pairs."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))
    last = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, 1, last(w)), F.slice(w, 2, last(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return T.bound(words, lambda w: F.concat(w, pairs(w)))


class TfIdf:
    """Smoothed TF-IDF of ``docs(id, text)``: stored counts (id, t, tf), frequencies (t, df) and squared norms (id, sq)."""

    def __init__(self, docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS):
        self.stop_words = stop_words
        self.n = docs.agg((F.count("*") + 1).alias("n"))
        # dealt by document before the n-grams are made: texts are shuffled, not n-grams, and counting needs no exchange
        each = docs.select("id", "text").repartition("id").select("id", F.explode(ngrams(F.col("text"), stop_words)).alias("t"))
        self.tf = stored(each.groupBy("id", "t").agg(F.count("*").alias("tf")), "counts")
        self.df = stored(self.tf.groupBy("t").agg(F.count("*").alias("df")).crossJoin(F.broadcast(self.n)), "frequencies")
        w = F.col("tf") * self.idf(0)
        self.norm = stored(self.tf.join(self.df, "t").groupBy("id").agg(F.sum(w * w).alias("sq")), "norms")

    @staticmethod
    def idf(extra: int) -> Column:
        return F.log((1 + F.col("n")) / (1 + F.col("df") + extra)) + 1

    def cosine(self, queries: DataFrame) -> DataFrame:
        """``qid, id, score``: cosine of TF-IDF vectors, above 0. Each query's statistics count the query itself as one more
        document: idf = ln((1 + n) / (1 + df)) + 1 with n = documents + 1. Only the queries' terms are read of the counts."""
        asked = queries.select("qid", F.explode(ngrams(F.col("q"), self.stop_words)).alias("t")).groupBy("qid", "t").agg(F.count("*").alias("qtf"))
        q = asked.join(self.df.select("t", "df"), "t", "left").crossJoin(F.broadcast(self.n)).withColumn("df", F.coalesce("df", F.lit(0)))
        q = q.select("qid", "t", "qtf", self.idf(1).alias("i"), self.idf(0).alias("i0"))
        qnorm = q.groupBy("qid").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("i"), 2))).alias("qn"))
        # what the query's terms add to the dot product, and what they change in a document's norm
        hit = self.tf.join(q, "t").groupBy("qid", "id").agg(
            F.sum(F.col("tf") * F.col("i") * F.col("qtf") * F.col("i")).alias("dot"),
            F.sum(F.pow(F.col("tf") * F.col("i"), 2) - F.pow(F.col("tf") * F.col("i0"), 2)).alias("more"),
        )
        j = hit.join(self.norm, "id").join(qnorm, "qid")
        return j.select("qid", "id", (F.col("dot") / F.sqrt(F.col("sq") + F.col("more")) / F.col("qn")).alias("score"))


def tfidf_cosine(docs: DataFrame, queries: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    return TfIdf(docs, stop_words).cosine(queries)


def cover_density(text: Column, query_terms: Sequence[str], weight: float = 0.1) -> Column:
    """Cover-density rank: each shortest stretch that holds all query terms adds weight / (1 + words between them).

    Words are lower-cased and not stemmed (there is no stemmer in Spark); 0 if a term is missing.
    """
    wanted = sorted({t.lower() for t in query_terms})

    @F.pandas_udf("double")
    def rank(texts):  # noqa: ANN001, ANN202
        import re

        def one(t: str | None) -> float:
            at = [(i, w) for i, w in enumerate(re.findall(r"\w+", (t or "").lower())) if w in wanted]
            last: dict[str, int] = {}
            total, begun = 0.0, -1
            for i, w in at:
                last[w] = i
                if len(last) == len(wanted):
                    start = min(last.values())
                    if start > begun:  # no shorter cover starts here
                        begun = start
                        total += weight / (1 + max(0, (i - start) - (len(wanted) - 1)))
            return total

        return texts.map(one).astype(float)

    return rank(text) if wanted else F.lit(0.0)

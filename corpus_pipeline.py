"""A training corpus from ``documents``: language identification, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but the last return the columns of
``docs``. ``run`` writes every stage as Parquet in the shared folder and reads it again as the next one's docs. Each begins
by releasing what its predecessor has left in the executors' heaps and shuffle files.

Odd cases, in every stage: an empty table gives an empty one; other columns may have any name and are carried along;
texts of any length are read whole; a row with a null id is a document like any other, but takes nothing from others in
the substring stage and loses nothing there. Null and empty texts go in the first stage. Rows that repeat are one
document from the second stage on. Ties (equal similarity, equal length) change no text, only which sequence it is in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import jaccard, language, packing, secrets, simhash, substrings
from docsieve.llm.common import released, stored, table

#: SQL can't express the classifier, the hashes and the tokeniser; tests hold the stages to brute-force versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; a missing ``lang`` is filled in. With no labelled rows to learn
    from, only documents without a letter go."""
    released(spark)
    model = language.train(docs, ~language.held_out())
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = docs.select(F.struct("*").alias("row"), language.predicted(docs, model).alias("of")).filter("of.lang_pred <> 'und'")
    lang = F.coalesce("row.lang", "of.lang_pred").alias("lang")
    return found.select(*(lang if c == "lang" else F.col(f"row.{c}") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles of 0.8 or more) stays, the
    one with the smallest id."""
    released(spark)
    return simhash.first_of_each(docs, jaccard.near_copies(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that stand in an earlier document go; a document that loses all its words goes too. A
    text that loses nothing stays as it is."""
    released(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substrings.substring_dedup(docs, carry=others, keep_layout=True)
    cut = cut.filter("n_removed = 0 or n_removed < n_words")
    of = {"doc_id": F.col("id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*((of[c] if c in of else F.col(f"carried.{c}")).alias(c) for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    released(spark)
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens."""
    released(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    limits = packing.TOKENS, packing.DOCUMENTS, packing.ATTENTION
    return packing.pack_documents(docs, path, public_tokenizers.PATTERN, 2, *limits).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}

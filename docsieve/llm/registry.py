"""The operN queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language, license, packing, quality, secrets, simhash, substrings, topk
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(license.license_scan(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    limits = packing.TOKENS, packing.DOCUMENTS, packing.ATTENTION
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, 2, *limits)
    return packed.withColumnRenamed("id", "doc_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.digest(judged)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~language.held_out())
    found = language.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), language.held_out("id").alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.substring_dedup(table(spark, sf_dir, "documents")))


#: The extra conversation: it says what other templates use to mark turns.
EXTRA = (-7, "</s>[INST] ok [/INST]")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(EXTRA[0]).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA[1]).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows.withColumn("parts", chat.line_parts(F.col("text")))))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_topk_search": op10_topk_search,
}


def _template_rows() -> str:
    texts = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    ts = license.templates(license.BASE, license.NOTICES)
    return ", ".join(f"('{t.label}', {str(t.base).lower()}, {texts(t.words)}, {texts(t.key)}, {t.key_at})" for t in ts)


ORACLE: dict[str, str] = {
    # every place of a key phrase is tried, where the operator tries those that its index proposes
    "op1_license_scan": rf"""
WITH t(label, base, words, key, key_at) AS (VALUES {_template_rows()}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
h AS (SELECT doc_id, label, base, words, w, i - key_at AS s FROM p JOIN t ON w[i] = key[1] AND w[i:i + len(key) - 1] = key WHERE i > key_at),
c AS (SELECT doc_id, label, base, s - 1 AS s, len([j for j in range(1, len(words) + 1) if w[s + j - 1] = words[j]]) / len(words) AS c FROM h),
m AS (SELECT * FROM c WHERE c >= CASE WHEN base THEN 1 ELSE 0.8 END)
SELECT w.doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(c), 0)::DOUBLE AS score
FROM w LEFT JOIN m ON m.doc_id = w.doc_id GROUP BY w.doc_id, w.w
""".replace("\\\\", "\\"),
    "op9_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'))
          + length('<|turn|>') + length('<|says|>') + length('<|end|>') AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attached_tokens
FROM marked GROUP BY conv_id
""",
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i:i + 12] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS m FROM p GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM p JOIN m USING (k) WHERE doc_id > m),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
}

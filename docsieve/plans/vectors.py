"""Vector queries. Embeddings stand for chunks: id = vec_id, document_id = label, chunk_index by vec_id in the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import dedup, search
from .storage import table

AS_OF = "2024-03-01 00:00:00"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("long").alias("document_id"),
        (F.row_number().over(w) - 1).alias("chunk_index"),
        "embedding",
        (F.col("vec_id") % 700).alias("token_count"),
        F.concat(F.lit('{"kind":"k'), F.col("vec_id") % 3, F.lit('"}')).alias("metadata"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("content_type"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id as int))").alias("created_at"),
    )


def vector_of(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    """One row: the query's vector."""
    r = table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in r[0]]


CHUNKS = """chunks AS (SELECT vec_id AS id, label::BIGINT AS document_id, embedding::DOUBLE[] AS e, vec_id % 700 AS token_count,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_index, 'k' || (vec_id % 3) AS kind FROM embeddings),
docs AS (SELECT doc_id AS document_id, source AS content_type, TIMESTAMP '2024-01-01 00:00:00' + to_days(doc_id::INTEGER) AS created_at FROM documents),
q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 1),
scored AS (SELECT c.id, c.document_id, c.kind, d.content_type, d.created_at, list_cosine_similarity(c.e, qe) AS s,
  0.7 * list_cosine_similarity(c.e, qe) + 0.2 / (1 + floor(date_diff('second', d.created_at, TIMESTAMP '2024-03-01 00:00:00') / 86400.0))
  + 0.1 * least(1.0, c.token_count / 500.0) AS cs FROM chunks c JOIN docs d USING (document_id), q)"""


def vs_topk(spark: SparkSession, d: str) -> DataFrame:
    found = search.similarity_search(chunks(spark, d), documents(spark, d), vector_of(spark, d, 1), k=10, threshold=0.1, as_of=AS_OF)
    return found.select("id", "document_id", F.round("similarity", 6).alias("similarity"), F.round("combined_score", 6).alias("combined_score"))


def vs_filtered(spark: SparkSession, d: str) -> DataFrame:
    f = search.Filters(range(1, 9), [f"src{i}" for i in range(15)], ("2024-01-02", "2024-01-09"), {"kind": "k1"})
    found = search.similarity_search(chunks(spark, d), documents(spark, d), vector_of(spark, d, 1), k=20, threshold=0.0, filters=f)
    return found.select("id", "document_id", "content_type", F.round("similarity", 6).alias("similarity"))


def vs_rerank(spark: SparkSession, d: str) -> DataFrame:
    found = search.similarity_search(chunks(spark, d), documents(spark, d), vector_of(spark, d, 1), k=5, threshold=0.0, as_of=AS_OF, rerank=True)
    return found.select("id", F.round("similarity", 6).alias("similarity"), F.round("combined_score", 6).alias("combined_score"))


def vs_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a query, in one pass."""
    e = table(spark, d, "embeddings")
    found = search.batch_search(e.select(F.col("vec_id").alias("id"), "embedding"), e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), 3, 0.2)
    return found.withColumn("similarity", F.round("similarity", 6))


def vs_distance(spark: SparkSession, d: str) -> DataFrame:
    found = search.distance_search(chunks(spark, d), vector_of(spark, d, 1), "summary", k=5, threshold=0.99)
    return found.select("id", "document_id", F.round("distance", 6).alias("distance"))


def vs_null_audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))
    return e.groupBy("label").agg(
        F.count("*").alias("total"), F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("missing")
    )


def vs_self_distance(spark: SparkSession, d: str) -> DataFrame:
    e = V.doubles(F.col("embedding"))
    rows = table(spark, d, "embeddings").filter(F.col("embedding").isNotNull()).orderBy("vec_id").limit(5)
    return rows.select("vec_id", F.size("embedding").alias("dims"), F.round(F.abs(1 - V.cosine(e, e)), 6).alias("self_distance"))


def vs_adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return search.adjacent_similarity(chunks(spark, d)).withColumn("similarity", F.round("similarity", 6))


def vs_udf_sql(spark: SparkSession, d: str) -> DataFrame:
    """The cosine_similarity SQL function inside spark.sql."""
    spark.sql(V.COSINE_SQL)
    table(spark, d, "embeddings").createOrReplaceTempView("docsieve_embeddings")
    return spark.sql(
        """SELECT a.vec_id, round(cosine_similarity(cast(a.embedding AS ARRAY<DOUBLE>), cast(b.embedding AS ARRAY<DOUBLE>)), 6) AS similarity
        FROM docsieve_embeddings a JOIN docsieve_embeddings b ON b.vec_id = a.vec_id + 1"""
    )


def _flat(df: DataFrame) -> DataFrame:
    return df.select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def emb_mean(spark: SparkSession, d: str) -> DataFrame:
    return _flat(search.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"))


def emb_weighted_norm(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _flat(search.mean_vectors(e, "label", "embedding", (F.col("vec_id") % 5 + 1).cast("double"), normalise=True))


def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return search.similar_pairs(table(spark, d, "embeddings"), 0.3, "vec_id")


def dedup_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("similarity", F.round("similarity", 6))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"))


def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    return dedup.greedy_kept(_ranked(spark, d), _pairs(spark, d)).filter("kept").select("id")


def merge_similar(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("vec_id").alias("pos"),
        F.concat(F.lit("c"), "vec_id").alias("content"),
        ((F.col("vec_id") * 37 % 101) / 100.0).alias("score"),
        F.concat(F.lit("m"), "label").alias("metadata"),
    )
    return dedup.merged(rows, dedup.leader_clusters(_ranked(spark, d), _pairs(spark, d)))


_NEAR = """p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3)"""
_GREEDY = f"""{_NEAR},
o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS pos, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS before
  FROM embeddings LEFT JOIN p ON p.b = vec_id GROUP BY vec_id),
g AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS kept
  UNION ALL SELECT o.pos, CASE WHEN list_has_any(o.before, g.kept) THEN g.kept ELSE list_append(g.kept, o.id) END FROM g JOIN o ON o.pos = g.pos + 1)"""

QUERIES = {f.__name__: f for f in (vs_topk, vs_filtered, vs_rerank, vs_batch, vs_distance, vs_null_audit, vs_self_distance, vs_adjacent_pairs, vs_udf_sql, emb_mean, emb_weighted_norm, dedup_exact, dedup_near_pairs, dedup_greedy, merge_similar)}
ORACLE = {
    "vs_topk": f"WITH {CHUNKS} SELECT id, document_id, round(s, 6) AS similarity, round(cs, 6) AS combined_score FROM scored WHERE s > 0.1 ORDER BY s DESC, id LIMIT 10",
    "vs_filtered": f"""WITH {CHUNKS} SELECT id, document_id, content_type, round(s, 6) AS similarity FROM scored WHERE s > 0 AND document_id BETWEEN 1 AND 8
AND content_type IN ({', '.join(f"'src{i}'" for i in range(15))}) AND created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09' AND kind = 'k1' ORDER BY s DESC, id LIMIT 20""",
    "vs_rerank": f"""WITH {CHUNKS}, f AS (SELECT * FROM scored WHERE s > 0 ORDER BY s DESC, id LIMIT 10)
SELECT id, round(s, 6) AS similarity, round(cs, 6) AS combined_score FROM f ORDER BY cs DESC, id LIMIT 5""",
    "vs_batch": """WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c)
SELECT qid, id, round(s, 6) AS similarity FROM s WHERE s > 0.2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) <= 3""",
    "vs_distance": f"WITH {CHUNKS} SELECT id, document_id, round(1 - list_cosine_similarity(e, qe), 6) AS distance FROM chunks, q WHERE 1 - list_cosine_similarity(e, qe) < 0.99 * 0.9 ORDER BY 1 - list_cosine_similarity(e, qe), id LIMIT 7",
    "vs_null_audit": "SELECT label, count(*) AS total, count(*) FILTER (vec_id % 7 <> 0) AS embedded, count(*) FILTER (vec_id % 7 = 0) AS missing FROM embeddings GROUP BY label",
    "vs_self_distance": "SELECT vec_id, len(embedding)::INTEGER AS dims, round(abs(1 - list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS self_distance FROM embeddings ORDER BY vec_id LIMIT 5",
    "vs_adjacent_pairs": f"WITH {CHUNKS} SELECT a.document_id, a.chunk_index, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND a.chunk_index = b.chunk_index - 1",
    "vs_udf_sql": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "emb_mean": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos::INTEGER AS pos, round(avg(x), 6) AS x FROM x GROUP BY label, pos",
    "emb_weighted_norm": """WITH x AS (SELECT label, vec_id % 5 + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, sum(x * w) / sum(w) AS x FROM x GROUP BY label, pos)
SELECT label, pos::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
    "dedup_exact": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "dedup_near_pairs": f"WITH {_NEAR} SELECT a, b, round(s, 6) AS similarity FROM p",
    "dedup_greedy": f"WITH RECURSIVE {_GREEDY} SELECT unnest(kept) AS id FROM g WHERE pos = (SELECT max(pos) FROM o)",
    "merge_similar": f"""WITH RECURSIVE {_GREEDY}, k AS (SELECT unnest(kept) AS id FROM g WHERE pos = (SELECT max(pos) FROM o)),
c AS (SELECT o.id, CASE WHEN o.id IN (SELECT id FROM k) THEN o.id ELSE (SELECT min(u) FROM (SELECT unnest(o.before) AS u) WHERE u IN (SELECT id FROM k)) END AS leader FROM o)
SELECT leader AS id, string_agg('c' || c.id, chr(10) ORDER BY c.id) AS content, max((c.id * 37 % 101) / 100.0)::DOUBLE AS score,
  arg_min('m' || label, c.id) AS metadata FROM c JOIN embeddings ON vec_id = c.id GROUP BY leader""",
}

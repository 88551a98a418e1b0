"""Lexical, fusion, context and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import context, fusion, graph, lexical, search
from .storage import spread, stored, table
from .vectors import CHUNKS, chunks, vector_of


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.Bm25(_docs(spark, d)).search(_queries(spark, d), 5).withColumn("score", F.round("score", 6))


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.Bm25(_docs(spark, d)).idf().withColumn("idf", F.round("idf", 6))


def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    scored = lexical.tfidf_cosine(_docs(spark, d), _queries(spark, d))
    return lexical.best(scored, 3).withColumn("score", F.round("score", 6))


def cover_density(spark: SparkSession, d: str) -> DataFrame:
    rank = lexical.cover_density(F.col("text"), ("the", "and", "of"))
    return _docs(spark, d).select("id", F.round(rank, 6).alias("rank")).filter("rank > 0")


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").filter("item_id = 1").select(F.lit(1).alias("qid"), F.lit("the and of to in").alias("q"))
    words = lexical.Bm25(_docs(spark, d)).search(q, 20).select("id", "score")
    near = V.cosine(V.doubles(F.col("embedding")), V.literal(vector_of(spark, d, 1)))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), near.alias("score")).orderBy(F.desc("score"), "id").limit(20)
    found = fusion.hybrid_fusion(vec, words, fusion.fusion_weights({"factual": 0.6, "conceptual": 0.2}), 0.05, 10)
    return found.select("id", *(F.round(c, 6).alias(c) for c in ("vector_score", "bm25_score", "score")))


def rank_sum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 13 / 13.0).alias("score"))
    b = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7 / 7.0).alias("score"))
    return fusion.summed((a, 0.7), (b, 0.3)).withColumn("score", F.round("score", 9))


def rerank_weighted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = V.cosine(V.doubles(F.col("embedding")), V.literal(vector_of(spark, d, 1)))
    mine = F.array(F.concat(F.lit("e"), F.col("vec_id") % 3), F.concat(F.lit("e"), F.col("vec_id") % 5))
    rows = e.select(
        F.col("vec_id").alias("id"),
        near.alias("semantic"),
        (F.col("vec_id") % 11 / 11.0).alias("keyword"),
        fusion.entity_overlap(F.array(F.lit("e1"), F.lit("e2")), mine).alias("entity"),
        (F.col("vec_id") % 17 * 3.0).alias("original"),
    )
    return fusion.reranked(rows).select("id", F.round("entity", 6).alias("entity"), F.round("final_score", 6).alias("final_score"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.concat(F.lit("s"), F.col("label") % 4).alias("section"), (F.col("vec_id") * 37 % 101 / 101.0).alias("score")
    )


def section_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return fusion.round_robin(_sections(spark, d)).select("id", "section", "rank")


def first_per_section(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_per_section(_sections(spark, d)).select("id", "section", "rank")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("chunk_index") * 450 + F.col("id") % 7 * 90
    return chunks(spark, d).select("id", "document_id", start.cast("long").alias("start_idx"), (start + 400).cast("long").alias("end_idx"), (F.col("id") * 37 % 101 / 101.0).alias("score"), F.col("id").alias("pos"))


def continuity_boost(spark: SparkSession, d: str) -> DataFrame:
    return fusion.continuity_boosted(_spans(spark, d), gap=200).select("id", F.round("score", 9).alias("score"))


def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _spans(spark, d)
    found = fusion.with_neighbours(rows.filter("id % 10 = 3"), rows)
    return found.select("id", "document_id", "pos", "n", F.round("score", 9).alias("score"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    near = V.cosine(V.doubles(F.col("embedding")), V.literal(vector_of(spark, d, 1)))
    return chunks(spark, d).select("document_id", "chunk_index", near.alias("score"), (F.col("id") % 50 + 10).alias("length"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("relevance", F.round("relevance", 6))


def ctx_windows_min(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(context.minimal_windows(_scored(spark, d), threshold=0.05))


def ctx_windows_expanded(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(context.expanded_windows(_scored(spark, d), threshold=0.05))


def ctx_windows_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    merged = context.merged_windows(context.expanded_windows(rows, threshold=0.05), rows)
    return _rounded(merged).withColumn("avg_length", F.round("avg_length", 6))


def _ref_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose texts also refer to others."""
    i, n = F.col("doc_id"), F.col("n")
    said = F.concat(
        F.coalesce("text", F.lit("")), F.lit(" See 'DOC_"), i * 7 % n, F.lit(".txt' and check \"doc_"), i * 3 % n, F.lit('.pdf"; as shown in Section '), i % 9, F.lit("."), i % 4,
        F.lit(" ["), i % 30, F.lit(", 2] (Smith et al., 2023) https://site.example/p"), i * 11 % n, F.lit(" www.other.example/x"),
    )
    ext = F.when(i % 2 == 0, ".txt").otherwise(".pdf")
    docs = table(spark, d, "documents")
    return docs.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select(
        i.alias("id"), F.concat(F.lit("Doc_"), i, ext).alias("filename"), F.lit("text/plain").alias("content_type"), said.alias("content"),
        F.create_map(F.lit("url"), F.concat(F.lit("https://site.example/p"), i), F.lit("citation"), F.concat(i, F.lit(", 2")), F.lit("section"), F.concat(F.lit("x"), i)).alias("metadata"),
    )


def ref_extract(spark: SparkSession, d: str) -> DataFrame:
    return graph.extracted(_ref_docs(spark, d))


def ref_extract_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.explode(graph.references(F.col("html"), "url")).alias("ref"))
    return p.groupBy("page_id", "ref").agg(F.count("*").alias("times"))


def graph_build(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_graph(_ref_docs(spark, d))[1]


def graph_common_refs(spark: SparkSession, d: str) -> DataFrame:
    """What two documents both refer to; asked with a third that there isn't, nothing."""
    e = _sim_edges(spark, d, 0.15)
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    found = [graph.common_references(e, nodes, ids).withColumn("asked", F.lit(len(ids))) for ids in (COMMON, (*COMMON, -5))]
    return found[0].unionByName(found[1]).select("asked", "dst", "reference_count", F.array_join("types", ",").alias("types"))


def graph_path_edges(spark: SparkSession, d: str) -> DataFrame:
    """The nodes within two steps of the roots, each with an edge toward its root."""
    e = _sim_edges(spark, d)
    return graph.path_edges(e, graph.levels(e, _roots(spark, d), 2))


def graph_json(spark: SparkSession, d: str) -> DataFrame:
    """The reference graph written as lines of JSON and read back."""
    nodes, edges = graph.build_graph(_ref_docs(spark, d))
    nodes, edges = graph.deserialised(graph.serialised(nodes, edges))
    return nodes.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("long").alias("dst"), F.col("title").alias("what")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), "dst", F.col("type").alias("what")))


def graph_bfs2_typed(spark: SparkSession, d: str) -> DataFrame:
    """The same over edges of one type alone."""
    return graph.related(_sim_edges(spark, d), _roots(spark, d), 2, ["url"])


#: Two vectors with similar ones in common.
COMMON = (1, 4)


def _sim_edges(spark: SparkSession, d: str, least: float = 0.3) -> DataFrame:
    p = stored(search.similar_pairs(table(spark, d, "embeddings"), least, "vec_id"), "pairs")
    return p.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("a") % 2 == 0, "url").otherwise("file").alias("type"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id in (1, 50, 100)").select(F.col("vec_id").alias("root"))


def graph_bfs2(spark: SparkSession, d: str) -> DataFrame:
    return graph.related(_sim_edges(spark, d), _roots(spark, d), 2)


def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    found, inside = graph.citation_graph(_sim_edges(spark, d), _roots(spark, d), 1)
    nodes = found.groupBy("root").agg(F.count("*").alias("nodes"), F.max("level").alias("depth"))
    return nodes.join(inside.groupBy("root").agg(F.count("*").alias("edges")), "root", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def graph_in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_sim_edges(spark, d)).select("id", "reference_count", F.array_join("reference_types", ",").alias("reference_types"))


_TOK = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_BM = rf"""t AS MATERIALIZED (SELECT doc_id AS id, {_TOK} AS w FROM documents), p AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM t),
n AS MATERIALIZED (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t), tf AS MATERIALIZED (SELECT term, id, dl, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, n), mean AS MATERIALIZED (SELECT avg(r) AS mean FROM raw),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw, mean)"""
_SCORE = "sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))"
_STOPS = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)
_NG = r"""(SELECT list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM (SELECT list_filter(regexp_extract_all(lower({x}), '[\pL\pN\pM_][\pL\pN\pM_]+'), lambda v: v NOT IN (""" + _STOPS + r""")) AS w))"""
_SEC = "s AS (SELECT vec_id AS id, vec_id AS pos, 's' || (label % 4) AS section, vec_id * 37 % 101 / 101.0 AS score FROM embeddings)"
_SPAN = f"{CHUNKS}, sp AS (SELECT id, document_id, chunk_index * 450 + id % 7 * 90 AS st, chunk_index * 450 + id % 7 * 90 + 400 AS en, id * 37 % 101 / 101.0 AS score FROM chunks)"
_CTX = f"""{CHUNKS}, x AS (SELECT document_id, chunk_index AS i, list_cosine_similarity(e, qe) AS s, id % 50 + 10 AS l FROM chunks, q),
f AS (SELECT document_id, i, s, lead(s) OVER w AS s2, lead(s, 2) OVER w AS s3, lag(s) OVER w AS s0 FROM x WINDOW w AS (PARTITION BY document_id ORDER BY i)),
m AS (SELECT document_id, i, (0.8 * s + s2) / 1.8 AS r, (0.8 * s0 + 0.9 * s + s2) / 2.7 AS rl, (0.8 * s + 0.9 * s2 + s3) / 2.7 AS rr FROM f WHERE s2 IS NOT NULL AND (0.8 * s + s2) / 1.8 >= 0.05),
ex AS (SELECT document_id, CASE WHEN rr > greatest(r, coalesce(rl, r)) THEN i WHEN rl > r THEN i - 1 ELSE i END AS start_idx,
  CASE WHEN rr > greatest(r, coalesce(rl, r)) THEN i + 2 ELSE i + 1 END AS end_idx, greatest(r, coalesce(rl, r), coalesce(rr, r)) AS relevance FROM m)"""
_REFS = """r AS (SELECT doc_id AS id, coalesce(text, '') || ' See ''DOC_' || (doc_id * 7 % n) || '.txt'' and check "doc_' || (doc_id * 3 % n) || '.pdf"; as shown in Section ' || (doc_id % 9) || '.' || (doc_id % 4)
 || ' [' || (doc_id % 30) || ', 2] (Smith et al., 2023) https://site.example/p' || (doc_id * 11 % n) || ' www.other.example/x' AS c FROM documents, (SELECT count(*) AS n FROM documents)),
x AS (SELECT DISTINCT id, kind, ref FROM (
  SELECT id, 'url' AS kind, unnest(regexp_extract_all(c, 'https?://[^\\s<>"]+|www\\.[^\\s<>"]+')) AS ref FROM r
  UNION ALL SELECT id, 'file', unnest(regexp_extract_all(c, '(?i)(?:see|refer to|check)\\s+(?:''([^'']*?\\.(?:txt|pdf|doc|docx))'')', 1)) FROM r
  UNION ALL SELECT id, 'file', unnest(regexp_extract_all(c, '(?i)(?:see|refer to|check)\\s+(?:"([^"]*?\\.(?:txt|pdf|doc|docx))")', 1)) FROM r
  UNION ALL SELECT id, 'section', unnest(regexp_extract_all(c, '(?i)(?:see|as shown in|described in)\\s+(?:section|chapter)\\s+[\\d\\.]+')) FROM r
  UNION ALL SELECT id, 'citation', unnest(regexp_extract_all(c, '\\[([\\d,\\s]+)\\]', 1)) FROM r
  UNION ALL SELECT id, 'citation', '' FROM r WHERE regexp_matches(c, '\\(\\w+\\s*(?:et al\\.?)?,\\s*\\d{4}\\)')))""".replace("\\\\", "\\")
_SIM = "e AS (SELECT a.vec_id AS src, b.vec_id AS dst, CASE WHEN a.vec_id % 2 = 0 THEN 'url' ELSE 'file' END AS type FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3)"
_LEV = _SIM + """, u AS (SELECT src AS a, dst AS b FROM e{only} UNION SELECT dst, src FROM e{only}),
l AS (SELECT vec_id AS root, vec_id AS id, 0 AS level FROM embeddings WHERE vec_id IN (1, 50, 100) UNION SELECT root, b, level + 1 FROM l JOIN u ON u.a = l.id WHERE level < {depth}),
lv AS (SELECT root, id, min(level) AS level FROM l GROUP BY root, id)"""
_URL = " WHERE type = 'url'"
_GRAPH = f"""{_REFS}, t AS (SELECT 'file' AS kind, lower('Doc_' || id || CASE WHEN id % 2 = 0 THEN '.txt' ELSE '.pdf' END) AS key, id AS dst FROM r UNION ALL SELECT 'url', 'https://site.example/p' || id, id FROM r
UNION ALL SELECT 'citation', id || ', 2', id FROM r), h AS (SELECT x.id AS src, t.dst, x.kind FROM x JOIN t ON x.kind = t.kind AND t.key = CASE WHEN x.kind = 'file' THEN lower(x.ref) ELSE x.ref END),
g AS (SELECT src, dst, arg_max(kind, list_position(['url','file','section','citation'], kind)) AS type FROM h GROUP BY src, dst)"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_stats, tfidf_cosine, cover_density, hybrid_fusion, rank_sum, rerank_weighted, section_round_robin, first_per_section, continuity_boost, neighbour_context, ctx_windows_min, ctx_windows_expanded, ctx_windows_merged, ref_extract, ref_extract_pages, graph_build, graph_common_refs, graph_bfs2, graph_bfs2_typed, graph_levels, graph_in_degree, graph_path_edges, graph_json)}
ORACLE = {
    "bm25_topk": f"""WITH {_BM}, a AS (SELECT item_id AS qid, unnest({_TOK}) AS term FROM benchmark), aa AS (SELECT qid, term, count(*) AS times FROM a WHERE term <> '' GROUP BY ALL)
SELECT qid, id, round({_SCORE}, 6) AS score FROM aa JOIN tf USING (term) JOIN idf USING (term), n GROUP BY qid, id HAVING {_SCORE} > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({_SCORE}, 9) DESC, id) <= 5""",
    "bm25_stats": f"WITH {_BM} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_cosine": f"""WITH g AS (SELECT doc_id AS id, unnest({_NG.format(x='text')}) AS t FROM documents), tf AS (SELECT id, t, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), n AS (SELECT count(*) + 1 AS n FROM documents),
qq AS (SELECT item_id AS qid, text AS q FROM benchmark), qg AS (SELECT qid, unnest({_NG.format(x='q')}) AS t FROM qq), qt AS (SELECT qid, t, count(*) AS qtf FROM qg GROUP BY ALL),
qi AS (SELECT qid, t, qtf, ln((1 + n) / (1 + coalesce(df, 0) + 1)) + 1 AS i FROM qt LEFT JOIN df USING (t), n),
w AS (SELECT id, t, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (t), n), nm AS (SELECT id, sum(w * w) AS sq FROM w GROUP BY id), qn AS (SELECT qid, sqrt(sum(power(qtf * i, 2))) AS qn FROM qi GROUP BY qid),
h AS (SELECT qid, id, sum(tf * i * qtf * i) AS dot, sum(power(tf * i, 2) - w * w) AS more FROM w JOIN qi USING (t) GROUP BY qid, id), sc AS (SELECT qid, id, dot / sqrt(sq + more) / qn AS score FROM h JOIN nm USING (id) JOIN qn USING (qid))
SELECT qid, id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 3""",
    "hybrid_fusion": f"""WITH {_BM}, aa AS (SELECT unnest(['the','and','of','to','in']) AS term, 1 AS times), b AS (SELECT id, {_SCORE} AS s FROM aa JOIN tf USING (term) JOIN idf USING (term), n GROUP BY id HAVING s > 0 ORDER BY round(s, 9) DESC, id LIMIT 20),
v AS (SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY s DESC, id LIMIT 20),
f AS (SELECT coalesce(v.id, b.id) AS id, coalesce(v.s, 0) AS vs, coalesce(b.s, 0) AS bs, 0.34 * coalesce(b.s, 0) + 0.66 * coalesce(v.s, 0) AS s FROM v FULL JOIN b ON v.id = b.id)
SELECT id, round(vs, 6) AS vector_score, round(bs, 6) AS bm25_score, round(s, 6) AS score FROM f WHERE s >= 0.05 ORDER BY s DESC, id LIMIT 10""",
    "rank_sum": "SELECT vec_id AS id, round(0.7 * (vec_id % 13 / 13.0) + CASE WHEN vec_id % 2 = 0 THEN 0.3 * (vec_id % 7 / 7.0) ELSE 0 END, 9)::DOUBLE AS score FROM embeddings",
    "rerank_weighted": """WITH x AS (SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, e.vec_id % 11 / 11.0 AS k,
len(list_intersect(['e1', 'e2'], ['e' || (e.vec_id % 3), 'e' || (e.vec_id % 5)])) / 2.0 AS n, e.vec_id % 17 * 3.0 AS o FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q)
SELECT id, round(n, 6)::DOUBLE AS entity, round(0.4 * s + 0.3 * k + 0.2 * n + 0.1 * o / max(o) OVER (), 6)::DOUBLE AS final_score FROM x""",
    "section_round_robin": f"WITH {_SEC}, r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, pos) AS r, min(pos) OVER (PARTITION BY section) AS f FROM s) SELECT id, section, row_number() OVER (ORDER BY r, f)::INTEGER AS rank FROM r",
    "first_per_section": f"WITH {_SEC}, r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY pos) = 1 AS l FROM s) SELECT id, section, row_number() OVER (ORDER BY l DESC, CASE WHEN l THEN pos END, score DESC, pos)::INTEGER AS rank FROM r",
    "continuity_boost": f"WITH {_SPAN}, b AS (SELECT *, st - lag(en) OVER (PARTITION BY document_id ORDER BY st, id) AS g FROM sp) SELECT id, round(CASE WHEN g BETWEEN 0 AND 200 THEN score * 1.1 ELSE score END, 9)::DOUBLE AS score FROM b",
    "neighbour_context": f"""WITH {_SPAN}, z AS (SELECT * FROM sp WHERE id % 10 = 3),
nb AS (SELECT s.id, s.document_id, z.id AS pos, row_number() OVER (PARTITION BY z.id ORDER BY s.st, s.id) AS n, z.score * 0.9 AS score FROM z JOIN sp s ON s.document_id = z.document_id AND s.id <> z.id AND abs(s.st - z.st) <= 1000),
u AS (SELECT id, document_id, id AS pos, 0 AS n, score FROM z UNION ALL SELECT id, document_id, pos, n, score FROM nb WHERE n <= 2)
SELECT id, document_id, pos, n::INTEGER AS n, round(score, 9)::DOUBLE AS score FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, n) = 1""",
    "ctx_windows_min": f"WITH {_CTX} SELECT document_id, i::INTEGER AS start_idx, (i + 1)::INTEGER AS end_idx, round(r, 6) AS relevance FROM m",
    "ctx_windows_expanded": f"WITH {_CTX} SELECT document_id, start_idx::INTEGER AS start_idx, end_idx::INTEGER AS end_idx, round(relevance, 6) AS relevance FROM ex",
    "ctx_windows_merged": f"""WITH {_CTX}, k AS (SELECT *, coalesce(start_idx > max(end_idx) OVER (PARTITION BY document_id ORDER BY start_idx, end_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS nw FROM ex),
g AS (SELECT *, sum(nw::INT) OVER (PARTITION BY document_id ORDER BY start_idx, end_idx ROWS UNBOUNDED PRECEDING) AS g FROM k), b AS (SELECT document_id, min(start_idx) AS a, max(end_idx) AS z FROM g GROUP BY document_id, g),
j AS (SELECT b.document_id, a, z, x.l, x.s, 0.8 + 0.2 * (x.i - a) / (z - a) AS w FROM b JOIN x ON x.document_id = b.document_id AND x.i BETWEEN a AND z)
SELECT document_id, a::INTEGER AS start_idx, z::INTEGER AS end_idx, count(*) AS chunk_count, round(avg(l), 6) AS avg_length, round(sum(s * w) / sum(w), 6) AS relevance FROM j GROUP BY document_id, a, z""",
    "ref_extract": f"WITH {_REFS} SELECT id, kind, ref FROM x",
    "ref_extract_pages": r"""WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, 'https?://[^\s<>"]+|www\.[^\s<>"]+')) AS ref FROM pages) SELECT page_id, ref, count(*) AS times FROM x GROUP BY ALL""",
    "graph_build": f"WITH {_GRAPH} SELECT src, dst, type FROM g",
    "graph_json": f"WITH {_GRAPH} SELECT 'node' AS kind, id, NULL::BIGINT AS dst, 'Doc_' || id || CASE WHEN id % 2 = 0 THEN '.txt' ELSE '.pdf' END AS what FROM r UNION ALL SELECT 'edge', src, dst, type FROM g",
    "graph_common_refs": f"WITH {_SIM.replace('> 0.3', '> 0.15')} SELECT 2 AS asked, dst, count(DISTINCT src) AS reference_count, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM e WHERE src IN {COMMON} GROUP BY dst HAVING count(DISTINCT src) = 2",
    "graph_path_edges": f"""WITH RECURSIVE {_LEV.format(depth=2, only='')}, h AS (SELECT a.root, a.id, e.src, e.dst, e.type, b.id AS near FROM lv a JOIN e ON e.src = a.id JOIN lv b ON b.root = a.root AND b.id = e.dst AND b.level = a.level - 1
UNION ALL SELECT a.root, a.id, e.src, e.dst, e.type, b.id FROM lv a JOIN e ON e.dst = a.id JOIN lv b ON b.root = a.root AND b.id = e.src AND b.level = a.level - 1)
SELECT root, id, src, dst, type FROM h QUALIFY row_number() OVER (PARTITION BY root, id ORDER BY near, src, dst, type) = 1""",
    "graph_bfs2_typed": f"WITH RECURSIVE {_LEV.format(depth=2, only=_URL)} SELECT root, id, level::INTEGER AS distance FROM lv WHERE level > 0",
    "graph_bfs2": f"WITH RECURSIVE {_LEV.format(depth=2, only='')} SELECT root, id, level::INTEGER AS distance FROM lv WHERE level > 0",
    "graph_levels": f"""WITH RECURSIVE {_LEV.format(depth=1, only='')}, n AS (SELECT root, count(*) AS nodes, max(level)::INTEGER AS depth FROM lv GROUP BY root)
SELECT root, nodes, depth, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM lv WHERE lv.root = n.root) AND dst IN (SELECT id FROM lv WHERE lv.root = n.root)) AS edges FROM n""",
    "graph_in_degree": f"WITH {_SIM} SELECT dst AS id, count(*) AS reference_count, string_agg(type, ',' ORDER BY type) AS reference_types FROM e GROUP BY dst",
}

"""Store, chat, cache, metric, streaming and ingest queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import expansion, lexical, metrics, providers, store
from ..sources import ingest
from ..streaming import rates
from .storage import shared_dir, spread, table
from .vectors import chunks


def _documents(spark: SparkSession, d: str) -> DataFrame:
    created = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id as int))")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("filename"), F.col("source").alias("content_type"), F.col("n_chars").alias("file_size"), created.alias("created_at"))


def doc_list_page(spark: SparkSession, d: str) -> DataFrame:
    return store.listed(_documents(spark, d), 10, 20, ["src0", "src1"], ("2024-01-05", "2024-06-30")).select("id", "filename", "content_type", "file_size")


def doc_detail(spark: SparkSession, d: str) -> DataFrame:
    return store.with_chunk_count(_documents(spark, d), chunks(spark, d)).select("id", "filename", "chunk_count")


def doc_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.range(20).filter("id % 3 = 0")
    docs, kept = store.cascade_delete(_documents(spark, d), chunks(spark, d), gone, "document_id")
    return docs.select(F.lit("document").alias("kind"), "id").unionByName(kept.select(F.lit("chunk").alias("kind"), "id"))


def add_chunks_index(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "benchmark").select((F.col("item_id") % 15).alias("document_id"), F.col("item_id").alias("ord"), F.concat(F.lit("n"), "item_id").alias("content"))
    return store.appended_chunks(chunks(spark, d), new, _documents(spark, d))


def store_document(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select(F.format_string("f%08d", "doc_id").alias("filename"), "text"))
    _, rows = store.stored_documents(docs, T.chunk_fixed(F.col("text")), 5)
    return rows.select("document_id", "chunk_index", F.length("content").alias("chars"))


def update_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("vec_id") % 50).alias("content"), F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("embedding"))
    cached = table(spark, d, "embeddings").filter("vec_id < 30").select(F.sha2(F.concat(F.lit("c"), "vec_id"), 256).alias("key"), "embedding")
    done = store.refilled_embeddings(rows, cached, lambda c: F.array(F.length(c).cast("float")))
    return done.select("id", F.size("embedding").alias("dims"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def chat_history_last5(spark: SparkSession, d: str) -> DataFrame:
    return store.last_messages(_messages(spark, d))


def chat_context(spark: SparkSession, d: str) -> DataFrame:
    return store.history_text(_messages(spark, d))


def chat_sources(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    asked = m.filter("turn = 0").select("session_id", F.col("content").alias("query"), F.lit("ok").alias("response"))
    src = m.filter("turn > 0").select("session_id", F.concat(F.lit("s"), "turn").alias("content"), (F.col("turn") / 8.0).alias("score"), F.col("turn").alias("document_id"), F.lit(0).alias("chunk_index"))
    return store.answer_rows(asked, src).select("session_id", "role", "content", F.get_json_object("message_metadata", "$.sources[0].content").alias("best"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("event_type") == k)
    g = _events(spark, d).groupBy("user_id").agg(n("view").alias("hits"), n("click").alias("misses"))
    return g.withColumn("hit_rate", F.round(metrics.hit_rate(F.col("hits"), F.col("misses")), 9))


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.concat(F.lit("doc:"), F.col("user_id") % 500).alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("inserted_at"), (F.lit(3600) * (F.col("event_id") % 48 + 1)).alias("ttl"))


def cache_ttl_live(spark: SparkSession, d: str) -> DataFrame:
    return store.cache_live(_cache(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp")).select("key", "value")


def cache_invalidate(spark: SparkSession, d: str) -> DataFrame:
    left = store.cache_invalidated(_cache(spark, d), spark.range(100))
    return left.groupBy("key").agg(F.count("*").alias("entries"))


def rate_5m(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rates(_events(spark, d), ["event_type"]).withColumn("rate", F.round("rate", 9))


def rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rates(_events(spark, d), ["event_type"], "5 minutes", "1 minute").select("window_start", "event_type", "count")


def p95_latency(spark: SparkSession, d: str) -> DataFrame:
    day = _events(spark, d).withColumn("day", F.to_date("ts"))
    return metrics.latency_percentiles(day, ["day", "event_type"], exact=True).withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    bounds = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0)
    h = metrics.histogram(_events(spark, d), ["event_type"], bounds=bounds)
    return h.select("event_type", *[f"le_{i}" for i in range(6)], "count", F.round("sum", 4).alias("sum"), F.round(metrics.bucket_quantile(h, 0.5, bounds), 6).alias("p50"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    w = metrics.windowed(_events(spark, d), "1 hour").groupBy("window_start").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("n"))
    return w.withColumn("ratio", metrics.ratio(F.col("e"), F.col("n")))


def error_ratio_alert(spark: SparkSession, d: str) -> DataFrame:
    return metrics.breaches(_errors(spark, d), "ratio", "HighErrorRate").withColumn("ratio", F.round("ratio", 9))


def alert_for_islands(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.breaches(_errors(spark, d), "ratio", "HighErrorRate")
    return metrics.lasting(found, ["alertname"], 3600, 3)


def alert_inhibit(spark: SparkSession, d: str) -> DataFrame:
    a = _events(spark, d).select(
        F.col("event_type").alias("alertname"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("cluster"), F.concat(F.lit("s"), F.col("event_id") % 7).alias("service"), F.when(F.col("value") > 50, "critical").otherwise("warning").alias("severity"), "event_id"
    )
    return metrics.inhibited(a).groupBy("alertname", "severity").agg(F.count("*").alias("n"))


def session_activity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sessions(_events(spark, d), "user_id", "6 hours")


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return metrics.over_limit(_events(spark, d), "event_type", 4, 3600).select("event_id", "in_window")


def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_events(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_latency", "hit_rate")})


def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.timed(_events(spark, d), "event_type", "value").withColumns({c: F.round(c, 6) for c in ("mean", "max", "min")})


def stream_rate_5m(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows of a stream over the events file."""
    import uuid

    at = f"{shared_dir(spark)}/docsieve/stream-{uuid.uuid4().hex}"
    stream = rates.event_stream(spark, f"{d}/events.parquet")
    rates.to_table(rates.windowed_counts(stream), at + "/out", at + "/checkpoint").awaitTermination()
    return spark.read.schema("window_start timestamp, event_type string, count long").parquet(at + "/out")


def _words(spark: SparkSession, d: str) -> DataFrame:
    """OCR words laid out from documents: five words a line, some of them far apart."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(T.normalised(F.col("text")), " ")).alias("i", "text"))
    n = F.col("i")
    return w.select(
        F.col("doc_id").alias("page"), F.floor(n / 15).alias("block"), F.floor(n / 5).alias("line"), (n % 5).alias("word"), "text", ((n * 13 + F.col("doc_id")) % 101 - 1).alias("conf"),
        ((n % 5) * 100 + F.when(n % 4 == 0, 40).otherwise(0)).alias("left"), (F.floor(n / 5) * 20).alias("top"), (F.lit(60) + (n % 3) * 15).alias("width"), F.lit(18).alias("height"),
    )


def ocr_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = ingest.ocr_blocks(_words(spark, d))
    return b.select("page", F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), F.col("width").cast("long").alias("width"), "text", F.round("confidence", 6).alias("confidence"))


def ocr_summary(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ocr_summary(_words(spark, d)).withColumn("confidence", F.round("confidence", 6))


def ocr_tables(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ocr_tables(_words(spark, d)).select("page", F.col("block").cast("long").alias("block"), F.col("top").cast("long").alias("top"), F.array_join("cells", "|").alias("cells"))


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.when(i % 4 != 0, i).alias("a"), F.when(i % 4 != 0, F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("b"), F.lit(None).cast("string").alias("c"), F.when(i % 4 == 1, F.col("value")).alias("v")
    )


def table_clean(spark: SparkSession, d: str) -> DataFrame:
    return ingest.table_lines(ingest.table_cleaned(_sheet(spark, d).select("a", "b", "c"))).groupBy("line").agg(F.count("*").alias("n"))


def table_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.table_stats(_sheet(spark, d))


def _code(spark: SparkSession, d: str) -> DataFrame:
    js = F.concat(F.lit("import 'lib"), "doc_id", F.lit("';\nclass C"), "doc_id", F.lit(" extends B {\n}\nconst f"), "doc_id", F.lit(" = (a) => a;\nif (x&&y || z) { for (;;) {} }\nlet v"), "doc_id", F.lit(" = 1;\n"))
    py = F.concat(F.lit("import os\nfrom a import b\nclass C"), "doc_id", F.lit(":\n    def m(self):\n        if 1 and 2:\n            pass\n\ndef f"), "doc_id", F.lit("():\n    while 0:\n        pass\n\nx = 1\n"))
    is_js = F.col("doc_id") % 2 == 0
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id", F.when(is_js, ".js").otherwise(".py")).alias("filename"), F.when(is_js, js).otherwise(py).alias("content"))


def code_complexity(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    lines = F.size(F.split(F.regexp_replace(c, "\n$", ""), "\n"))
    return _code(spark, d).select("doc_id", ingest.code_language(F.col("filename")).alias("language"), F.length(c).alias("characters"), lines.alias("lines"), T.cyclomatic(c).alias("cyclomatic"))


def code_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in the code and in the document's text behind it, by the patterns of its language."""
    c = _code(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    c = c.withColumn("content", F.concat("content", F.lit("\n# "), F.coalesce("text", F.lit(""))))
    names = lambda k: F.when(F.col("filename").endswith(".js"), ingest.code_names(F.col("content"), k, ingest.JS)).otherwise(ingest.code_names(F.col("content"), k, ingest.GENERIC))
    return c.select("doc_id", *(F.array_join(names(k), ",").alias(k) for k in ingest.JS))


def code_structure(spark: SparkSession, d: str) -> DataFrame:
    s = _code(spark, d).select("doc_id", ingest.code_structure(F.col("content"), ingest.code_language(F.col("filename"))).alias("s"))
    names = lambda k: F.array_join(F.transform(f"s.{k}", lambda x: F.concat_ws(":", x["name"], x["lineno"])), ",").alias(k)
    return s.select("doc_id", names("classes"), names("functions"), F.array_join("s.imports", ",").alias("imports"), names("variables"))


def email_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Subject: Note "), "conv_id", F.lit("\nFrom: a@x.example\nTo: b@x.example\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.regexp_replace("text", r"\s+", " "))
    rows = table(spark, d, "conversations").select("conv_id", "turn", ingest.email_fields(F.encode(raw, "utf-8")).alias("m"))
    return rows.select("conv_id", "turn", "m.subject", "m.sender", "m.recipients", F.trim("m.body").alias("body"))


def mime_route(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 6
    heads = F.when(i == 0, F.unhex(F.lit("255044462D312E34"))).when(i == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(i == 2, F.unhex(F.lit("FFD8FFE000104A46"))).when(i == 3, F.unhex(F.lit("00FF00FF"))).otherwise(F.encode(F.lit("plain"), "utf-8"))
    rows = table(spark, d, "documents").select("doc_id", F.when(i == 5, "x.py").otherwise("x.txt").alias("filename"), heads.alias("content"))
    typed = rows.select("doc_id", "filename", T.mime_type(F.col("content"), F.col("filename")).alias("content_type"))
    return ingest.routed(typed).select("doc_id", "content_type", "branch", "error")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as queries with their terms."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("The Database document "), "text").alias("q"))
    return q.withColumn("terms", providers.query_terms(F.col("q")))


def _context(spark: SparkSession, d: str, queries: DataFrame) -> DataFrame:
    """All conversation texts, dealt to three queries in four; the others have none."""
    lead = F.col("conv_id") % 40
    return table(spark, d, "conversations").filter("text is not null").select(F.when(lead % 4 == 3, lead - 1).otherwise(lead).alias("qid"), F.col("text").alias("content"))


def _letters(text: Column) -> Column:
    """A stand-in embedding that SQL can tell as well: how often each letter stands in a text."""
    low = F.lower(text)
    return F.transform(F.array(*(F.lit(chr(97 + k)) for k in range(26))), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"))


_KNOWN = (("database", ["store", "DB", "the", "database"]), ("document", ["file", "record", "text"]), ("unused", ["x"]))


def query_synonyms(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame(_KNOWN, "term string, synonyms array<string>")
    return expansion.synonyms(_asked(spark, d), known, 2).select("qid", "term", F.array_join("synonyms", ",").alias("synonyms"))


def semantic_terms(spark: SparkSession, d: str) -> DataFrame:
    q = _asked(spark, d)
    of = expansion.candidates(q, _context(spark, d, q), providers.query_terms)
    return expansion.semantic_terms(q, of, _letters).select("qid", "term", F.round("similarity", 6).alias("similarity"), "rank")


def query_expand(spark: SparkSession, d: str) -> DataFrame:
    q = _asked(spark, d)
    of = expansion.candidates(q, _context(spark, d, q), providers.query_terms)
    known = spark.createDataFrame(_KNOWN, "term string, synonyms array<string>")
    return expansion.expanded(q, expansion.synonyms(q, known, 2), expansion.semantic_terms(q, of, _letters))


def session_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of all conversations, some asked for again and some new; then the first ten are deleted."""
    m = _messages(spark, d)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    old = m.select(F.col("session_id").alias("id")).distinct().select("id", at.alias("created_at"), at.alias("updated_at"))
    wanted = old.select((F.col("id") + 5).alias("id"))
    made = store.created_sessions(old, wanted, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    left, said = store.deleted_sessions(made, m, spark.range(10))
    n = said.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"))
    return left.join(n, "id", "left").select("id", "created_at", F.coalesce("messages", F.lit(0)).alias("messages"))


def cache_set(spark: SparkSession, d: str) -> DataFrame:
    """New embedding and query entries written behind the events' cache: only keys without a live value take them."""
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    new = table(spark, d, "events").select(F.concat(F.lit("doc:"), F.col("user_id") % 700).alias("key"), (F.col("event_id") + 1000000).alias("value"), F.lit(60).alias("ttl"))
    done = store.cache_written(_cache(spark, d), new, now)
    return store.cache_live(done, now).select("key", "value")


def request_durations(spark: SparkSession, d: str) -> DataFrame:
    """Start and end records of one trace joined to a duration; a trace without an end has none."""
    e = _events(spark, d).select(F.concat(F.lit("t"), F.floor(F.col("event_id") / 2)).alias("trace_id"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("phase"), "ts")
    return metrics.durations(e).withColumn("seconds", F.round("seconds", 3))


def all_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Every rule over the events' hours, each with its own measure and the time that a breach must last."""
    w = metrics.windowed(_events(spark, d), "5 minutes").groupBy("window_start").agg(F.count("*").alias("n"), *(F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "view", "click")), F.max("value").alias("top"), F.avg("value").alias("mean"))
    half = lambda c: metrics.ratio(F.col(c), F.col("n"))
    measures = {
        "HighErrorRate": half("error"), "HighResponseLatency": F.col("mean") / 20, "DatabasePoolSaturation": F.least(F.col("top") / 100, F.lit(1.0)), "HighMemoryUsage": half("view") * 2, "HighCpuUsage": half("click") * 2,
        "LowDiskSpace": F.col("mean") / 100, "HighCacheMissRate": metrics.ratio(F.col("click"), F.col("click") + F.col("view")), "SlowVectorSearch": F.col("mean") / 60, "DocumentProcessingFailures": half("error") / 2,
    }
    return metrics.firing(w, measures).groupBy("alertname", "severity").agg(F.count("*").alias("alerts"), F.sum("windows").alias("windows"))


def image_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of an image: its table rows as lines first, then its text blocks, numbered through."""
    w = _words(spark, d)
    return ingest.image_chunks(ingest.ocr_blocks(w), ingest.ocr_tables(w)).select("page", "chunk_index", "kind", F.length("content").alias("chars"))


_EV = "e AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value FROM events)"
_CA = "c AS (SELECT 'doc:' || (user_id % 500) AS key, event_id AS value, ts AS t, 3600 * (event_id % 48 + 1) AS ttl FROM e)"
_ER = "w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) FILTER (event_type = 'error') / count(*) AS ratio FROM e GROUP BY 1)"
_CH = "ch AS (SELECT vec_id AS id, label::BIGINT AS document_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_index FROM embeddings)"
_DO = "do_ AS (SELECT doc_id AS id, 'doc' || doc_id || '.txt' AS filename, source AS content_type, n_chars AS file_size, TIMESTAMP '2024-01-01' + to_days(doc_id::INTEGER) AS created_at FROM documents)"
_WO = r"""w0 AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS text, generate_subscripts(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1) - 1 AS i FROM documents),
w AS (SELECT doc_id AS page, i // 15 AS block, i // 5 AS line, i % 5 AS word, text, (i * 13 + doc_id) % 101 - 1 AS conf, (i % 5) * 100 + CASE WHEN i % 4 = 0 THEN 40 ELSE 0 END AS "left", (i // 5) * 20 AS top, 60 + (i % 3) * 15 AS width, 18 AS height FROM w0)"""

_OT = """kt AS (SELECT * FROM w WHERE conf > 30), st AS (SELECT page, block FROM kt GROUP BY ALL HAVING count(DISTINCT "left") > 1 AND count(DISTINCT top) > 1),
ot AS (SELECT page, block, top, string_agg(text, '|' ORDER BY "left", text) AS cells FROM kt JOIN st USING (page, block) GROUP BY page, block, top)"""
_OB = """k AS (SELECT * FROM w WHERE conf > 0 AND trim(text) <> ''),
r AS (SELECT *, max("left" + width) OVER (PARTITION BY page, line ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM k),
g AS (SELECT *, sum(CASE WHEN edge IS NOT NULL AND "left" - edge < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY page, line ORDER BY word ROWS UNBOUNDED PRECEDING) AS g FROM r),
ob AS (SELECT page, line, g, min(top) AS top, min("left") AS "left", max("left" + width) - min("left") AS width, string_agg(text, ' ' ORDER BY word) AS text,
round(list_reduce(list(conf::DOUBLE ORDER BY word), lambda a, x: (a + x) / 2), 6) AS confidence FROM g GROUP BY page, line, g)"""
_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), '[^0-9A-Za-z_]+'), lambda v: v <> '' AND v NOT IN (" + ", ".join(f"'{w}'" for w in lexical.STOP_WORDS) + ")))"
_LETTERS = "[(length({x}) - length(replace(lower({x}), chr((97 + k)::INTEGER), '')))::DOUBLE for k in range(26)]"
_QX = f"""q AS MATERIALIZED (SELECT item_id AS qid, 'The Database document ' || text AS q FROM benchmark), qt AS MATERIALIZED (SELECT qid, q, {_TERMS.format(x='q')} AS terms FROM q),
kn AS (SELECT unnest([{{'term': 'database', 's': ['store', 'db', 'the', 'database']}}, {{'term': 'document', 's': ['file', 'record', 'text']}}], recursive := true)),
sy AS (SELECT qid, term, list_filter(s, lambda x: x <> term AND x <> 'the')[1:2] AS s FROM (SELECT qid, unnest(terms) AS term FROM qt) JOIN kn USING (term)),
cx AS MATERIALIZED (SELECT CASE WHEN conv_id % 40 % 4 = 3 THEN conv_id % 40 - 1 ELSE conv_id % 40 END AS qid, text FROM conversations WHERE text IS NOT NULL),
ca AS (SELECT DISTINCT qid, unnest({_TERMS.format(x='text')}) AS term FROM cx WHERE qid IN (SELECT qid FROM q)
  UNION ALL SELECT qid, unnest({list(expansion.DOMAIN_TERMS)}) FROM q WHERE qid NOT IN (SELECT qid FROM cx)),
sc AS (SELECT qid, term, list_cosine_similarity({_LETTERS.format(x='q')}, {_LETTERS.format(x='term')}) AS sim FROM ca JOIN qt USING (qid) WHERE NOT list_contains(terms, term)),
sem AS (SELECT qid, term, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, term)::INTEGER AS rank FROM sc WHERE sim >= 0.7 QUALIFY rank <= 5)"""
_CODE = r"""c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'import ''lib' || doc_id || E''';\nclass C' || doc_id || E' extends B {\n}\nconst f' || doc_id || E' = (a) => a;\nif (x&&y || z) { for (;;) {} }\nlet v' || doc_id || E' = 1;\n'
ELSE E'import os\nfrom a import b\nclass C' || doc_id || E':\n    def m(self):\n        if 1 and 2:\n            pass\n\ndef f' || doc_id || E'():\n    while 0:\n        pass\n\nx = 1\n' END AS c FROM documents)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


QUERIES = {
    f.__name__: f
    for f in (
        doc_list_page, doc_detail, doc_delete_cascade, add_chunks_index, store_document, update_embeddings, chat_history_last5, chat_context, chat_sources, cache_hit_rate, cache_ttl_live, cache_invalidate, rate_5m, rate_sliding, p95_latency,
        latency_histogram, error_ratio_alert, alert_for_islands, alert_inhibit, session_activity, rate_limit, metrics_summary, benchmark_summary, stream_rate_5m, ocr_blocks, ocr_summary, ocr_tables, table_clean, table_stats, code_complexity, code_names,
        code_structure, email_parse, mime_route, query_expand, query_synonyms, semantic_terms, session_lifecycle, cache_set, request_durations, all_alerts, image_chunks,
    )
}
ORACLE = {
    "doc_list_page": f"WITH {_DO} SELECT id, filename, content_type, file_size FROM do_ WHERE content_type IN ('src0', 'src1') AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-06-30' ORDER BY id LIMIT 20 OFFSET 10",
    "doc_detail": f"WITH {_DO}, {_CH} SELECT do_.id, filename, count(ch.id) AS chunk_count FROM do_ LEFT JOIN ch ON ch.document_id = do_.id GROUP BY ALL",
    "doc_delete_cascade": f"WITH {_CH} SELECT 'document' AS kind, doc_id AS id FROM documents WHERE NOT (doc_id < 20 AND doc_id % 3 = 0) UNION ALL SELECT 'chunk', id FROM ch WHERE NOT (document_id < 20 AND document_id % 3 = 0)",
    "add_chunks_index": f"""WITH {_CH}, l AS (SELECT document_id, max(chunk_index) AS m FROM ch GROUP BY 1), n AS (SELECT item_id % 15 AS document_id, item_id AS ord, 'n' || item_id AS content FROM benchmark)
SELECT n.document_id, content, (coalesce(m, -1) + row_number() OVER (PARTITION BY n.document_id ORDER BY ord))::INTEGER AS chunk_index FROM n LEFT JOIN l USING (document_id) WHERE n.document_id IN (SELECT doc_id FROM documents)""",
    "store_document": "WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) + 4 AS id, text FROM documents), i AS (SELECT id, text, unnest(range(0, length(text), 800)) AS i FROM n) SELECT id AS document_id, (i // 800)::INTEGER AS chunk_index, length(substring(text, i + 1, 1000))::INTEGER AS chars FROM i",
    "update_embeddings": """SELECT e.vec_id AS id, coalesce(len(CASE WHEN e.vec_id % 2 = 0 THEN e.embedding END), len(c.embedding), 1)::INTEGER AS dims,
round(coalesce((CASE WHEN e.vec_id % 2 = 0 THEN e.embedding END)[1], c.embedding[1], length('c' || (e.vec_id % 50)))::DOUBLE, 6) AS first FROM embeddings e LEFT JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 30) c ON c.vec_id = e.vec_id % 50""",
    "chat_history_last5": "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5",
    "chat_context": "WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) SELECT conv_id AS session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM l GROUP BY conv_id",
    "chat_sources": """WITH s AS (SELECT conv_id, 's' || max(turn) AS best FROM conversations WHERE turn > 0 GROUP BY conv_id), q AS (SELECT conv_id, text FROM conversations WHERE turn = 0)
SELECT conv_id AS session_id, 'user' AS role, text AS content, NULL::VARCHAR AS best FROM q UNION ALL SELECT q.conv_id, 'assistant', 'ok', best FROM q LEFT JOIN s USING (conv_id)""",
    "cache_hit_rate": f"WITH {_EV}, g AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM e GROUP BY 1) SELECT *, round(CASE WHEN hits + misses = 0 THEN 0 ELSE hits / (hits + misses) END, 9) AS hit_rate FROM g",
    "cache_ttl_live": f"WITH {_EV}, {_CA} SELECT key, arg_min(value, t) AS value FROM c WHERE t <= TIMESTAMP '2024-01-15 12:00:00' AND floor(epoch(t)) + ttl > epoch(TIMESTAMP '2024-01-15 12:00:00') GROUP BY key",
    "cache_invalidate": f"WITH {_EV}, {_CA} SELECT key, count(*) AS entries FROM c WHERE substring(key, 5)::INT >= 100 GROUP BY key",
    "rate_5m": f"WITH {_EV} SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS count, round(count(*) / 300.0, 9)::DOUBLE AS rate FROM e GROUP BY 1, 2",
    "rate_sliding": f"""WITH {_EV}, x AS (SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS window_start, event_type FROM e, (SELECT unnest([0, 1, 2, 3, 4]) AS k))
SELECT window_start, event_type, count(*) AS count FROM x GROUP BY 1, 2""",
    "p95_latency": f"WITH {_EV} SELECT ts::DATE AS day, event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY 1, 2",
    "latency_histogram": f"""WITH {_EV}, h AS (SELECT event_type, {', '.join(f'count(*) FILTER (value <= {b}) AS le_{i}' for i, b in enumerate((1, 5, 10, 50, 100, 500)))}, count(*) AS count, round(sum(value), 4) AS sum FROM e GROUP BY 1)
SELECT *, round(CASE WHEN le_0 >= count * 0.5 THEN 1.0 * count * 0.5 / le_0 {' '.join(f'WHEN le_{i} >= count * 0.5 THEN {lo} + {hi - lo}.0 * (count * 0.5 - le_{i - 1}) / (le_{i} - le_{i - 1})' for i, (lo, hi) in enumerate(zip((1, 5, 10, 50, 100), (5, 10, 50, 100, 500)), 1))} ELSE 500.0 END, 6)::DOUBLE AS p50 FROM h""",
    "error_ratio_alert": f"WITH {_EV}, {_ER} SELECT window_start, 'HighErrorRate' AS alertname, 'critical' AS severity, round(ratio, 9) AS ratio FROM w WHERE ratio > 0.05",
    "alert_for_islands": f"""WITH {_EV}, {_ER}, b AS (SELECT window_start, epoch(window_start) - 3600 * row_number() OVER (ORDER BY window_start) AS g FROM w WHERE ratio > 0.05)
SELECT 'HighErrorRate' AS alertname, min(window_start) AS start, max(window_start) AS "end", count(*) AS windows FROM b GROUP BY g HAVING count(*) >= 3""",
    "alert_inhibit": f"""WITH {_EV}, a AS (SELECT event_type AS alertname, 'c' || (user_id % 5) AS cl, 's' || (event_id % 7) AS sv, CASE WHEN value > 50 THEN 'critical' ELSE 'warning' END AS severity FROM e)
SELECT alertname, severity, count(*) AS n FROM a WHERE severity = 'critical' OR NOT EXISTS (SELECT 1 FROM a b WHERE b.severity = 'critical' AND b.alertname = a.alertname AND b.cl = a.cl AND b.sv = a.sv) GROUP BY 1, 2""",
    "session_activity": f"""WITH {_EV}, f AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours', true)::INT AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS events FROM g GROUP BY user_id, g""",
    "rate_limit": f"WITH {_EV}, s AS (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS s FROM e), c AS (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM s) SELECT * FROM c WHERE in_window > 4",
    "metrics_summary": f"WITH {_EV}, s AS (SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_latency, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM e) SELECT *, round(hits / (hits + misses), 6) AS hit_rate FROM s",
    "benchmark_summary": f"WITH {_EV} SELECT event_type, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min FROM e GROUP BY 1",
    "stream_rate_5m": f"WITH {_EV}, c AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS count FROM e GROUP BY 1, 2) SELECT * FROM c WHERE window_start + INTERVAL '5 minutes' <= (SELECT max(ts) FROM e) - INTERVAL '1 hour'",
    "ocr_summary": f"WITH {_WO} SELECT page, count(*) FILTER (trim(text) <> '') AS word_count, round(avg(CASE WHEN conf <> -1 THEN conf END), 6) AS confidence FROM w GROUP BY page",
    "ocr_tables": f"WITH {_WO}, {_OT} SELECT page, block, top, cells FROM ot",
    "ocr_blocks": f"""WITH {_WO}, {_OB} SELECT page, top, "left", width, text, confidence FROM ob""",
    "table_clean": "SELECT event_id || ' | ' || event_type AS line, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY 1",
    "table_stats": "SELECT count(*) AS row_count, 4 AS column_count, 'a,b,c,v' AS column_names, (2 * count(*) FILTER (event_id % 4 = 0) + count(*) + count(*) FILTER (event_id % 4 <> 1)) AS empty_cells, 'a,v' AS numeric_columns FROM events",
    "code_complexity": "WITH " + _CODE + r""" SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'JavaScript' ELSE 'Python' END AS language, length(c)::INTEGER AS characters, len(string_split(regexp_replace(c, '\n$', ''), chr(10)))::INTEGER AS lines,
(1 + len(regexp_extract_all(c, '\bif\b')) + len(regexp_extract_all(c, '\bwhile\b')) + len(regexp_extract_all(c, '\bfor\b')) + len(regexp_extract_all(c, '\bcase\b')) + len(regexp_extract_all(c, '\bcatch\b')) + len(regexp_extract_all(c, '\b&&\b')) + len(regexp_extract_all(c, '\b\|\|\b')))::INTEGER AS cyclomatic FROM c""",
    "code_names": "WITH " + _CODE + ", t AS (SELECT c.doc_id, c.c || E'\\n# ' || coalesce(text, '') AS c FROM c JOIN documents USING (doc_id)) SELECT doc_id, " + ", ".join(f"array_to_string(CASE WHEN doc_id % 2 = 0 THEN regexp_extract_all(c, {_quoted(ingest.JS[k])}, 1) ELSE regexp_extract_all(c, {_quoted(ingest.GENERIC[k])}, 1) END, ',') AS {k}" for k in ingest.JS) + " FROM t",
    "code_structure": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'C' || doc_id || ':2' ELSE 'C' || doc_id || ':3' END AS classes, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id || ':4' ELSE 'f' || doc_id || ':8,m:4' END AS functions,
CASE WHEN doc_id % 2 = 0 THEN 'lib' || doc_id ELSE 'os,a' END AS imports, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id || ':4,v' || doc_id || ':6' ELSE 'x:12' END AS variables FROM documents""",
    "query_synonyms": f"WITH {_QX} SELECT qid, term, array_to_string(s, ',') AS synonyms FROM sy",
    "semantic_terms": f"WITH {_QX} SELECT qid, term, round(sim, 6) AS similarity, rank FROM sem",
    "query_expand": f"""WITH {_QX}, a AS (SELECT qid, flatten(list(s ORDER BY term)) AS s FROM sy GROUP BY qid), b AS (SELECT qid, list(term ORDER BY rank) AS t FROM sem GROUP BY qid)
SELECT qid, array_to_string(list_concat([q], coalesce(s, []), list_filter(coalesce(t, []), lambda x: NOT list_contains(coalesce(s, []), x))), ' ') AS expanded, coalesce(len(s), 0)::INTEGER AS synonym_count, coalesce(len(t), 0)::INTEGER AS semantic_term_count FROM q LEFT JOIN a USING (qid) LEFT JOIN b USING (qid)""",
    "session_lifecycle": """WITH o AS (SELECT DISTINCT conv_id AS id FROM conversations), n AS (SELECT DISTINCT id + 5 AS id FROM o), a AS (SELECT id, TIMESTAMP '2024-01-01' AS created_at FROM o UNION ALL SELECT id, TIMESTAMP '2024-02-01' FROM n WHERE id NOT IN (SELECT id FROM o)),
c AS (SELECT conv_id AS id, count(*) AS m FROM conversations GROUP BY 1) SELECT id, created_at, coalesce(m, 0) AS messages FROM a LEFT JOIN c USING (id) WHERE id NOT BETWEEN 0 AND 9""",
    "cache_set": f"""WITH {_EV}, {_CA}, l AS (SELECT key, arg_min(value, t) AS value FROM c WHERE t <= TIMESTAMP '2024-01-15 12:00:00' AND floor(epoch(t)) + ttl > epoch(TIMESTAMP '2024-01-15 12:00:00') GROUP BY key),
n AS (SELECT 'doc:' || (user_id % 700) AS key, min(event_id + 1000000) AS value FROM e GROUP BY 1) SELECT key, value FROM l UNION ALL SELECT key, value FROM n WHERE key NOT IN (SELECT key FROM l)""",
    "request_durations": "SELECT 't' || (event_id // 2) AS trace_id, min(ts::TIMESTAMP) FILTER (event_id % 2 = 0) AS started, round((epoch_us(max(ts::TIMESTAMP) FILTER (event_id % 2 = 1)) - epoch_us(min(ts::TIMESTAMP) FILTER (event_id % 2 = 0))) / 1000000.0, 3) AS seconds FROM events GROUP BY 1",
    "all_alerts": f"""WITH {_EV}, w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS t, count(*) AS n, count(*) FILTER (event_type = 'error') AS er, count(*) FILTER (event_type = 'view') AS vi, count(*) FILTER (event_type = 'click') AS cl, max(value) AS top, avg(value) AS mean FROM e GROUP BY 1),
m AS (SELECT t, unnest([{{'a': 'HighErrorRate', 's': 'critical', 'l': 0.05, 'v': er / n}}, {{'a': 'HighResponseLatency', 's': 'warning', 'l': 2.0, 'v': mean / 20}}, {{'a': 'DatabasePoolSaturation', 's': 'warning', 'l': 0.8, 'v': least(top / 100, 1.0)}}, {{'a': 'HighMemoryUsage', 's': 'warning', 'l': 0.85, 'v': vi / n * 2}},
  {{'a': 'HighCpuUsage', 's': 'warning', 'l': 0.8, 'v': cl / n * 2}}, {{'a': 'LowDiskSpace', 's': 'warning', 'l': 0.85, 'v': mean / 100}}, {{'a': 'HighCacheMissRate', 's': 'warning', 'l': 0.4, 'v': CASE WHEN cl + vi = 0 THEN 0 ELSE cl / (cl + vi) END}}, {{'a': 'SlowVectorSearch', 's': 'warning', 'l': 1.0, 'v': mean / 60}}, {{'a': 'DocumentProcessingFailures', 's': 'critical', 'l': 0.1, 'v': er / n / 2}}], recursive := true) FROM w),
b AS (SELECT a, s, epoch(t) - 300 * row_number() OVER (PARTITION BY a ORDER BY t) AS g FROM m WHERE v > l), i AS (SELECT a, s, count(*) AS k FROM b GROUP BY a, s, g) SELECT a AS alertname, s AS severity, count(*) AS alerts, sum(k)::BIGINT AS windows FROM i GROUP BY a, s""",
    "image_chunks": f"""WITH {_WO}, {_OB}, {_OT}, u AS (SELECT page, 0 AS o, block AS x, top AS y, 0 AS z, 'table' AS kind, cells AS c FROM ot UNION ALL SELECT page, 1, line, 0, g, 'text', text FROM ob)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY o, x, y, z) - 1)::INTEGER AS chunk_index, kind, length(c)::INTEGER AS chars FROM u""",
    "email_parse": r"SELECT conv_id, turn, 'Note ' || conv_id AS subject, 'a@x.example' AS sender, 'b@x.example' AS recipients, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM conversations",
    "mime_route": """WITH t AS (SELECT doc_id, (['application/pdf','image/png','image/jpeg','application/octet-stream','text/plain','text/x-python'])[doc_id % 6 + 1] AS content_type FROM documents)
SELECT doc_id, content_type, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'error' WHEN 4 THEN 'text' ELSE 'code' END AS branch, CASE WHEN doc_id % 6 = 3 THEN 'unsupported type: ' || content_type END AS error FROM t""",
}

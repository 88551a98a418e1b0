"""A document store as tables: uploads, documents with their chunks, chats, caches.

Tables are DataFrames in and out: a change returns the new tables, which the caller writes (``write_table``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.storage import stored

#: Extensions that may be uploaded, and the largest size.
ALLOWED_EXTENSIONS = ("txt", "pdf", "doc", "docx", "csv", "xls", "xlsx", "json", "md", "rst")
MAX_CONTENT_LENGTH = 16 * 1024 * 1024

DOCUMENTS = "id long, filename string, content_type string, file_size long, created_at timestamp, updated_at timestamp, doc_metadata string"
CHUNKS = "id long, document_id long, content string, chunk_index int, embedding array<float>, token_count int, chunk_metadata string, created_at timestamp"
SESSIONS = "id long, created_at timestamp, updated_at timestamp, session_metadata string"
MESSAGES = "id long, session_id long, role string, content string, created_at timestamp, message_metadata string"


def created_tables(spark, drop: bool = False, database: str = "default") -> None:  # noqa: ANN001
    """Create the four tables; ``drop`` recreates them."""
    for name, schema in (("documents", DOCUMENTS), ("document_chunks", CHUNKS), ("chat_sessions", SESSIONS), ("chat_messages", MESSAGES)):
        if drop:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def upload_checked(rows: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (extension, empty, size; null if accepted) and a ``content_type`` if there is none."""
    ext = F.substring(T.suffix(F.col("filename")), 2, 100)
    reason = F.when(~ext.isin(*ALLOWED_EXTENSIONS), "extension").when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty")
    reason = reason.when(F.col("file_size") > MAX_CONTENT_LENGTH, "size")
    kind = F.concat(F.lit("application/"), F.when(ext == "", "octet-stream").otherwise(ext))
    if "content_type" in rows.columns:
        kind = F.coalesce("content_type", kind)
    return rows.withColumn("reject_reason", reason).withColumn("content_type", kind)


def numbered(new: DataFrame, order: Sequence[str], first: int, id_col: str = "id") -> DataFrame:
    """Ids from ``first`` without gaps in the order given, without a single-task window. The ranges are written once with
    their numbers; counts and rows are both read from that table, so they can't differ."""
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    ranged = stored(ranged, "numbered")
    sizes = ranged.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(sizes), "_p").withColumn(id_col, F.col("_before") + F.col("_n") + first).drop("_p", "_n", "_before")


def stored_documents(docs: DataFrame, chunks_of: Column, first_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """New document rows with ids, and their chunk rows (content, chunk_index) from an array expression."""
    with_ids = numbered(docs, ["filename"], first_id)
    chunks = with_ids.select(F.col("id").alias("document_id"), F.posexplode(chunks_of).alias("chunk_index", "content"))
    return with_ids, chunks.withColumn("token_count", T.token_estimate(F.col("content")))


def appended_chunks(chunks: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """``new`` (document_id, ord, content) numbered behind each document's last chunk; chunks of unknown documents
    are left out."""
    last = chunks.groupBy("document_id").agg(F.max("chunk_index").alias("last"))
    known = new.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").join(last, "document_id", "left")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("ord"))
    return known.select("document_id", "content", (F.coalesce("last", F.lit(-1)) + n).cast("int").alias("chunk_index"))


def cascade_delete(parents: DataFrame, children: DataFrame, ids: DataFrame, foreign_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents of ``ids(id)`` and their children."""
    return (
        parents.join(ids, "id", "left_anti"),
        children.join(ids.withColumnRenamed("id", foreign_key), foreign_key, "left_anti"),
    )


def with_chunk_count(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    return documents.join(n, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def listed(documents: DataFrame, skip: int = 0, limit: int = 100, content_types: Sequence[str] | None = None, created: tuple[str, str] | None = None) -> DataFrame:
    if content_types is not None:
        documents = documents.filter(F.col("content_type").isin(list(content_types)))
    if created is not None:
        documents = documents.filter(F.col("created_at").between(*(F.lit(x).cast("timestamp") for x in created)))
    return documents.orderBy("id").offset(skip).limit(limit)


def refilled_embeddings(chunks: DataFrame, cached: DataFrame, embed, force: bool = False) -> DataFrame:  # noqa: ANN001
    """Missing embeddings from a cache table (key, embedding) keyed by the content's digest, else from the provider
    ``embed(Column) -> Column``; ``force`` recomputes all."""
    old = F.lit(None) if force else F.col("embedding")
    j = chunks.withColumn("key", F.sha2("content", 256)).join(cached.select("key", F.col("embedding").alias("hit")), "key", "left")
    return j.withColumn("embedding", F.coalesce(old, F.col("hit"), embed(F.col("content")))).drop("hit", "key")


def last_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last n turns of each session (session_id, turn, role, content); the cut is made before the shuffle."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("back")


def history_text(messages: DataFrame, n: int = 5) -> DataFrame:
    rows = last_messages(messages, n).select("session_id", F.struct("turn", F.concat("role", F.lit(": "), "content").alias("line")).alias("x"))
    return rows.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], "\n").alias("history"))


def answer_rows(question: DataFrame, sources: DataFrame) -> DataFrame:
    """A user and an assistant message for each (session_id, query, response); the assistant's carries its sources
    (session_id, content, score, document_id, chunk_index) in order of score."""
    s = sources.groupBy("session_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("score", "content", "document_id", "chunk_index")), asc=False),
            lambda x: F.struct(x["content"].alias("content"), x["score"].alias("score"), x["document_id"].alias("document_id"), x["chunk_index"].alias("chunk_index")),
        ).alias("sources")
    )
    j = question.join(s, "session_id", "left")
    user = j.select("session_id", F.lit("user").alias("role"), F.col("query").alias("content"), F.lit(None).cast("string").alias("message_metadata"))
    bot = j.select("session_id", F.lit("assistant").alias("role"), F.col("response").alias("content"), F.to_json(F.struct("sources")).alias("message_metadata"))
    return user.unionByName(bot)


def created_sessions(sessions: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Sessions (id, created_at, updated_at) with a row for each id of ``wanted(id)`` that has none yet."""
    new = wanted.select("id").distinct().join(sessions, "id", "left_anti")
    return sessions.select("id", "created_at", "updated_at").unionByName(new.select("id", now.alias("created_at"), now.alias("updated_at")))


def deleted_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions of ``ids(id)`` and their messages."""
    return cascade_delete(sessions, messages, ids, "session_id")


# Caches are tables (key, value, inserted_at, ttl seconds); the first live write of a key wins.


def cache_key(namespace: str, *parts: Column) -> Column:
    """A digest of all parameters, so that no two requests share a key."""
    return F.concat(F.lit(namespace + ":"), F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256))


def cache_written(cache: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The cache with the rows of ``new(key, value, ttl)`` whose keys have no live value; of several rows of one key the
    one with the smallest value."""
    one = new.groupBy("key").agg(F.min(F.struct("value", "ttl")).alias("w")).select("key", "w.value", "w.ttl")
    fresh = one.join(cache_live(cache, now).select("key"), "key", "left_anti").withColumn("inserted_at", now)
    return cache.select("key", "value", "inserted_at", "ttl").unionByName(fresh.select("key", "value", "inserted_at", "ttl"))


def cache_live(cache: DataFrame, as_of: Column) -> DataFrame:
    """The value each key has at a time: of its unexpired writes, the earliest."""
    alive = cache.filter((F.col("inserted_at") <= as_of) & (F.unix_timestamp("inserted_at") + F.col("ttl") > F.unix_timestamp(as_of)))
    return alive.groupBy("key").agg(F.min_by("value", "inserted_at").alias("value"), F.min("inserted_at").alias("inserted_at"))


def cache_invalidated(cache: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Without the metadata keys of the documents (``doc:<id>``) and query results that name them (``q:...:d:<id>``)."""
    of = F.regexp_extract("key", r"^(?:doc:|q:.*:d:)(\d+)$", 1)
    gone = document_ids.select(F.col("id").cast("string").alias("_d"))
    return cache.withColumn("_d", of).join(gone, "_d", "left_anti").drop("_d")

"""Structured Streaming forms of the metric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A file stream of events; its time is cast, as watermarks don't take timestamps without a zone."""
    read, schema = spark.readStream, spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # a stream reads folders
        read, path = read.option("pathGlobFilter", where.getName()), where.getParent().toString()
    stream = read.schema(schema).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed_counts(stream: DataFrame, by: str = "event_type", length: str = "5 minutes", ts: str = "ts") -> DataFrame:
    w = F.window(ts, length)
    return stream.groupBy(w, by).agg(F.count("*").alias("count")).select(F.col("window.start").alias("window_start"), by, "count")


def first_writes(stream: DataFrame, key: str) -> DataFrame:
    """The first write of each key inside the watermark: a cache's set-if-absent."""
    return stream.dropDuplicatesWithinWatermark([key])


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run to the end of what is there, into Parquet files."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

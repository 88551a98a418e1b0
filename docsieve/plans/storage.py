"""Tables in the shared folder, and partitioning of inputs."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file, where the most rows that a table can have are known.
FILE_ROWS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that setting is missing in a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="docsieve-")
        shared_dir.own = where
    return where.rstrip("/")


def stored(df: DataFrame, label: str, path: str | None = None, by: str | None = None, most: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    ``checkpoint()`` would compute the plan twice (once to count, once to write); a table is written in one run. With
    ``path``, the rows are added to the table that is there; with ``by``, each value of that column has its own folder.

    ``most``, the most rows it can have, bounds the number of files: a small table isn't dealt to as many as a shuffle has
    partitions. For each file in a local folder Hadoop starts three processes (``chmod``), and until such a process runs
    its own program the system counts the executor's whole memory for it again.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(1, -(-most // FILE_ROWS)))
    path = path or f"{shared_dir(spark)}/docsieve/{label}-{uuid.uuid4().hex}"
    df.write.mode("append").partitionBy(*([by] if by else [])).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(df: DataFrame, folder: str = "") -> None:
    """Delete the files of a ``stored`` table, or of one folder in it, that nothing reads any more."""
    path = getattr(df, "stored_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path + folder)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, and executors give back the heap that these steps filled.

    Spark deletes the files when the driver collects garbage, which a large heap puts off for up to half an hour. An
    executor's heap grows with what a step leaves behind, not with what it needs, and shrinks at a whole collection only:
    beside it, the next step's Python workers and native buffers would have less and less room.
    """
    gc.collect()  # what Python still holds of finished steps
    time.sleep(1)  # the scheduler lets go of a job a moment after its end
    spark._jvm.System.gc()
    if not spark.sparkContext._jsc.sc().isLocal():  # a task for every core, so that each executor has one
        cores = spark.sparkContext.defaultParallelism
        spark.range(0, cores, 1, cores).selectExpr("reflect('java.lang.System', 'gc')").collect()


def spread(df: DataFrame) -> DataFrame:
    """At least one partition a core: a table of one file with one row group would run as one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

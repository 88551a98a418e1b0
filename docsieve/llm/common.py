"""What the operators of this subpackage share: storage, samples, Arrow maps over texts, the word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import dropped, released, shared_dir, spread, stored, table

__all__ = ["LOWER", "SPACES", "UPPER", "among", "dropped", "joined", "map_texts", "released", "sampled", "shared_dir", "spread", "stored", "table", "trim"]

#: ASCII white space; words are the runs between these characters. ``bytes.split()`` splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside those of other steps."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def sampled(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """The ``most`` rows of the smallest hashes of ``key``, or all if there are no more: the same at every partitioning.
    The rows are counted first, so that what is sorted and moved has a bound whatever the table's size."""
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    share = 1.25 * most / max(1, rows.count())
    order = (h, *(c for c in rows.columns))
    few = rows.filter(h < int(share * (1 << 40))) if share < 1 else rows
    if share < 1 and few.count() < most:  # rows that repeat have one hash
        few = rows
    return few.orderBy(*order).limit(most)


def among(rows: DataFrame, keys: DataFrame, most: int = 1 << 21) -> DataFrame:
    """Of ``rows`` those whose columns may be a row of the stored table ``keys`` (columns of the same names): a Bloom filter
    ahead of a shuffle of wide rows. None that is there is lost; the join that follows tells the others.

    The filter has a word of 64 bits for every four keys, up to ``most`` words (about 100 MB on a task's machine), which go to
    every task; a key sets four bits of one word. It passes about one in 100 of the other rows as long as the words suffice,
    for 8 million keys, and more of them beyond that.
    """
    words = min(most, 1 << max(0, keys.count() // 4).bit_length())
    h = F.xxhash64(*keys.columns)
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftright(_hash, {k}) & 63 as int))")
    bits = bit(24).bitwiseOR(bit(32)).bitwiseOR(bit(40)).bitwiseOR(bit(48))
    own = keys.select(h.alias("_hash")).select(F.pmod("_hash", F.lit(words)).alias("_word"), bits.alias("_bits"))
    table = own.groupBy("_word").agg(F.bit_or("_bits").alias("_set"))
    asked = rows.withColumn("_hash", h).withColumn("_word", F.pmod("_hash", F.lit(words))).withColumn("_bits", bits)
    return asked.join(F.broadcast(table), "_word").filter("_set & _bits = _bits").drop("_hash", "_word", "_bits", "_set")


def joined(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int, most: int = 100_000, least: int = 64) -> DataFrame:
    """``rows`` joined with the stored table ``keyed``, one row a key, whose column ``size`` says how many of the ``total``
    rows have the key (it is left out of the result).

    Keys with more than ``total / most`` rows, so at most ``most`` of them, go to every task; the others meet in a shuffle.
    No key's rows all come to one task, however many there are, and what is broadcast has a bound.
    """
    limit = max(least, total // most)
    hot, cold = (keyed.filter(F.col(size) > limit).drop(size), keyed.filter(F.col(size) <= limit).drop(size))
    beside = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(beside.join(cold, key))


def map_texts(
    df: DataFrame, id_col: str, text_col: str, out_schema: str, work: Callable[[], Callable[[list, list], list]]
) -> DataFrame:
    """Arrow map over (id, text) alone, so that other columns can have any name.

    ``work()`` runs once a task and returns ``f(ids, texts)``, which gives the output columns as lists or arrays.
    A null text reaches ``f`` as None.
    """
    small = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    schema = small.sparkSession.createDataFrame([], out_schema).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        f, types = work(), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # a bounded number of texts as Python objects at a time
                part = batch.slice(at, 512)
                cols = f(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=types.field(n).type) for c, n in zip(cols, names)], schema=types
                )

    return small.mapInArrow(run, schema)

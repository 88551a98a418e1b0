r"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21. Two fingerprints that differ in at most two bits agree
wholly on at least one segment (pigeonhole), and differ in at most two bits on the next. The binary Golay code
[23, 12, 7] is perfect: every 23-bit word is within three bits of exactly one of 4,096 codewords. Two words that differ
in at most two bits have a word between them that is within one bit of both, so if each word takes the indices of the
codewords to which it and its one-bit neighbours decode (at most six), the two share an index. A fingerprint's keys
are therefore (which segment, its bits, an index of the next segment): about 16 keys of 34 bits.

Exact copies of fingerprints are merged before. Keys with few fingerprints are compared pair by pair in their row; for
keys with more, fingerprints meet instead at the words within one bit of them: fingerprints that share such a word are
within two bits of one another, and two that are share one, so links to the smallest of each word give the same
components with no pairs. Components come from large-star and small-star steps.

Words: A-Z lower-cased, runs of ``[^\x20\x09-\x0D]``. Null and empty texts have fingerprint zero and link like any
other. Repeated rows stay in the result. A null id never is a component's id unless all its ids are null. An empty table
gives no rows. A text of any length is read whole, its shingles in pieces; other columns may have any name.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, map_texts, stored
from .components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is 1 if set in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data, h = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begin, end = (ends - lengths)[:n], ends[len(words) - n :]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        cut = slice(k, k + (1 << 15))
        hashes = np.array([h(data[a:b], seed) for a, b in zip(begin[cut].tolist(), end[cut].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def text_hash(text: str | None) -> int:
    """Spark's ``xxhash64(text)``."""
    return int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64)) if text is not None else 42


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id, th, fp`` for every row; ``th`` is Spark's ``xxhash64(text)``, which tells rows of one id apart."""

    def work() -> Callable:
        return lambda keys, texts: [keys, [text_hash(t) for t in texts], [fingerprint(t, width, seed) for t in texts]]

    return map_texts(df, id_col, text_col, "id long, th long, fp long", work)


@functools.lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits of a word, and the error pattern of each of the 2,048 remainders."""

    def remainder(words: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
        return words

    flips = [0] + [1 << a for a in range(23)]
    patterns = np.array(sorted({a ^ b ^ c for a in flips for b in flips for c in flips}, key=lambda x: x.bit_count()))
    errors = np.zeros(2048, np.int64)
    errors[remainder(patterns)] = patterns
    return remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    low, high, errors = _golay()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, key) of every distinct key."""
    bits = fps.view(np.uint64)
    parts = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        near = np.array([0] + [1 << b for b in range(SEGMENTS[j][1])])
        index = np.sort(codeword_index(parts[j][:, None] ^ near[None, :]), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(i << 40 | parts[i][r] << 12 | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                rows, keys = keys_of(fp[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + 4096][rows])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, most: int = 2, pairwise: int = 64) -> DataFrame:
    """``u, v`` links among distinct fingerprints, enough for the components of all pairs within ``most`` <= 2 bits.

    Keys with up to ``pairwise`` fingerprints give their true pairs, larger keys star links through shared neighbours.
    """
    if not 0 <= most <= 2:
        raise ValueError("the keys find pairs of at most two differing bits")
    keyed = stored(_keyed(fps), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1")
    sizes = stored(sizes, "sizes", most=9 * fps.count())  # at most 18 keys each
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most
    twos = sizes.filter("n = 2").select("u", "v").filter(near)
    few = keyed.join(sizes.filter(f"n > 2 and n <= {pairwise}").select("key"), "key")
    few = few.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    few = few.select("fps", F.explode("fps").alias("u")).select("u", F.explode("fps").alias("v")).filter("u < v").filter(near)
    many = keyed.join(sizes.filter(f"n > {pairwise}").select("key"), "key").select("fp").distinct()
    flips = [0] + [1 << b for b in range(63)] + [-(1 << 63)]
    if most == 2:
        meets = F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.col("fp").bitwiseXOR(x))
        met = many.select("fp", F.explode(meets).alias("at"))
        least = met.groupBy("at").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1").select("at", "u")
        stars = met.join(least, "at").filter("u <> fp").select("u", F.col("fp").alias("v"))
    else:  # within one bit: a neighbour is itself a fingerprint
        other = many.select("fp", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in flips[1 : most * 64 + 1]]), lambda x: F.col("fp").bitwiseXOR(x))).alias("v"))
        stars = other.join(many.select(F.col("fp").alias("v")), "v").select(F.col("fp").alias("u"), "v")
    return twos.unionByName(few).unionByName(stars).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, most: int = 2
) -> DataFrame:
    """``id, th, fp, root, component_id`` for every row: the smallest fingerprint and the smallest id reachable."""
    docs = stored(fingerprints(df, id_col, text_col, width, seed), "fingerprints")
    each = stored(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("many")), "distinct")
    return grouped(docs, each, components(links(each, most))).select("id", "th", "fp", "root", "component_id")


def grouped(docs: DataFrame, each: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``root, component_id``: from stored tables ``docs`` (fp, ...), ``each`` (fp, least id, many) and the
    components ``found`` (node, root). No fingerprint's or component's rows come to one task, however many there are."""
    rooted = each.join(found, each.fp == found.node, "left").select("fp", "least", "many", F.coalesce("root", "fp").alias("root"))
    total = docs.count()
    rooted = stored(rooted, "rooted", most=total)
    ids = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), "roots", most=total)
    known = stored(joined(rooted.drop("least"), ids, "root", "fps", total), "known", most=total)
    return joined(docs, known, "fp", "many", total)


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id (of several such
    rows, one with the smallest text hash)."""
    return first_of_each(df, near_duplicates(df, id_col, text_col, **how), id_col, text_col)


def first_of_each(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for components ``id, th, root, component_id`` found before."""
    mine = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root")
    first = mine.agg(F.min(F.struct("id", "th")).alias("k")).select("k.id", F.col("k.th").alias("th"))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("a"), F.xxhash64(text_col).alias("b"))
    kept = rows.join(first, F.col("a").eqNullSafe(F.col("id")) & (F.col("b") == F.col("th")), "left_semi")
    w = Window.partitionBy("a", "b").orderBy("b")
    return kept.withColumn("n", F.row_number().over(w)).filter("n = 1").select("row.*")

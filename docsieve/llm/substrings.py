r"""Substring deduplication of word windows with a count-min prefilter.

A window is ``width`` consecutive words of one document; each word covered by a window whose words also start in a
document with a smaller id is removed, judged on the input.

1. Each task deals its documents to slices of about ``SLICE`` windows and counts a slice's windows (once a document) in two
   rows of counters. Only touched counters are written, as gaps, cut into blocks of counters. The slices' sketches are
   added up block by block, and each slice gets back a bit for every counter that it touched: two or more. Counts are
   never too low, so a window of two documents always shows as repeated.
2. A second pass over the slices keeps only windows that both rows call repeated, and groups these exactly: a slice sends
   each distinct one once, with its smallest id there, as sorted columns cut into buckets of the hash; the bucket answers
   a bit a window, whether another slice has a smaller id. A window of a third of all documents is thus one entry a slice.
3. With both answers a slice works out its documents' places and cuts the covered words.

Both tables of counters are dealt by hash range and grow with the corpus (1.5 to 3 counters a word and row), so the filter
passes the same share of windows at every size; nothing is broadcast, nothing is collected. Blocks grow with the tables, to
2^25 counters, and buckets are as few as the windows sent allow: a slice sends at most 512 sketches up to about 5.7 billion
words. Beyond, and for buckets, what a slice sends comes in more and smaller rows as the corpus grows. Windows are told apart by 96
bits of two independent sums over 64-bit word hashes: among 10^13 windows a false match is a matter of 10^-3.

Words: runs of ``[^\x20\x09-\x0D]``. A null text has no words. A null id removes nothing and loses nothing. Repeated rows
of one id don't remove each other. An empty table gives no rows. A text of any length is judged whole, in one slice;
other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dropped, released, spread, stored, trim

#: Counters of a block (as a power of two), windows of a slice, and windows sent to a bucket, about.
BLOCK_BITS, SLICE, BUCKET = 20, 1 << 19, 1 << 20
#: A row has 2 ** BLOCKS blocks at most, whatever the corpus, until blocks have 2 ** MOST_BITS counters (a byte each).
BLOCKS, MOST_BITS = 8, 25
#: Characters of documents that are packed as one value, about: values of megabytes burden the JVM's heap.
PIECE = 1 << 19
#: Words hashed at once, about.
GROUP = 1 << 15


def _factors(width: int) -> np.ndarray:
    """Odd 64-bit multipliers, a row for either hash, from a fixed seed."""
    return np.random.default_rng(7).integers(1, 1 << 62, (2, width), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: list[bytes], factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window: sums of the words' hashes times the factor of their place, then mixed."""
    width = factors.shape[1]
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    out = []
    for k in range(2):
        one, s = np.ascontiguousarray(h[:, k]), np.zeros(n, np.uint64)
        for j in range(width):
            s += one[j : j + n] * factors[k, j]
        s ^= s >> np.uint64(32)
        out.append(s * factors[k, 0])
    return out[0], out[1]


class Sizes:
    """The hash ranges for a corpus of about ``n`` words: counters of a row, blocks of counters, buckets of windows."""

    def __init__(self, n: float, width: int):
        self.bits = max(8, math.ceil(math.log2(max(2.0, 1.5 * n))))
        self.block = min(self.bits, max(BLOCK_BITS, min(self.bits - BLOCKS, MOST_BITS)))
        self.asked(n)
        self.factors = _factors(width)

    def asked(self, windows: float) -> None:
        """Take buckets for so many windows that slices ask about."""
        self.buckets = 1 << max(6, math.ceil(math.log2(max(1.0, windows / BUCKET))))

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def windows(self, ids: list, texts: list) -> tuple[np.ndarray, ...]:
        """(hash, other hash, place, document) of all windows of documents with an id."""
        found = [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2]
        words, docs, lengths = [], [], []
        for doc, (key, text) in enumerate(zip(ids, texts)):
            if key is not None and text:
                own = text.encode().split()
                words += own
                docs.append(doc)
                lengths.append(len(own))
            if len(words) >= GROUP:
                found.append(self._of_group(words, docs, lengths))
                words, docs, lengths = [], [], []
        found.append(self._of_group(words, docs, lengths))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _of_group(self, words: list[bytes], docs: list[int], lengths: list[int]) -> tuple[np.ndarray, ...]:
        """The same of documents whose words stand one behind the other: hashed at once, windows across two left out."""
        one, two = window_hashes(words, self.factors)
        n = np.array(lengths, np.int64)
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        whole = np.nonzero(place[: len(one)] + self.factors.shape[1] <= np.repeat(n, n)[: len(one)])[0]
        return one[whole], two[whole], place[whole], np.repeat(np.array(docs, np.int64), n)[whole]


def pack_gaps(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers as their gaps, byte plane by byte plane."""
    return planes(np.diff(cells.astype(np.uint64), prepend=np.uint64(0)))


def unpack_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers from 0 byte plane by byte plane, behind the count of planes that are needed."""
    x = np.ascontiguousarray(numbers, dtype="<u8")
    k = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([k]) + x.view(np.uint8).reshape(len(x), 8)[:, :k].T.tobytes() + len(x).to_bytes(8, "little")


def unplaned(data: bytes) -> np.ndarray:
    k, n = data[0], int.from_bytes(data[-8:], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(data, np.uint8, k * n, 1).reshape(k, n).T
    return out.view("<u8").ravel()


_SLICED = "s long, part long, data binary, counts binary"


def _packed(rows: pa.RecordBatch) -> bytes:
    """Rows as a compressed Arrow stream: a third of what the shuffle's own compression makes of texts."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpacked(data: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in data])


def _slices(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """Of documents ``id, text, carried``: rows of each slice s with its documents in ``data`` (part is null), and with its
    sketch, ``data, counts`` for each block that it touched (part is row * blocks + block)."""

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["s", "part", "data", "counts"])

    def sketch(s: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, blocks = [], 1 << (sizes.bits - sizes.block)
        for row in range(2):
            cells, counts = np.unique(np.concatenate(held[row]), return_counts=True)
            block = cells >> np.uint64(sizes.block)
            for at, end in _runs(block):
                n = np.minimum(counts[at:end], 255).astype(np.uint8).tobytes()
                rows.append((s, row * blocks + int(block[at]), pack_gaps(cells[at:end] & np.uint64((1 << sizes.block) - 1)), zlib.compress(n, 1)))
        yield rows_of(rows)

    def hold(held: list[list[np.ndarray]], ids: list, texts: list) -> int:
        """Add the counters of the documents' windows, and say how many. A window counts once a document, or once more
        where it has others between: it is one of two documents then."""
        one, two, _, doc = sizes.windows(ids, texts)
        order = np.argsort(one)
        one, doc = one[order], doc[order]
        new = np.append(True, (one[1:] != one[:-1]) | (doc[1:] != doc[:-1]))[: len(one)]
        held[0].append(sizes.cells(one[new]))
        held[1].append(sizes.cells(two[order][new]))
        return int(new.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held, n = TaskContext.get().partitionId() << 24, [[], []], 0
        for b in batches:
            begun, raw, ids, texts, chars = 0, 0, [], [], 0
            for at, (key, text) in enumerate(zip(b.column(0), b.column(1)), 1):
                ids.append(key.as_py())
                texts.append(text.as_py())
                raw += len(texts[-1] or "")
                chars += len(texts[-1] or "")
                if chars >= min(4 * GROUP, SLICE) or at == b.num_rows or raw >= PIECE:
                    n += hold(held, ids, texts)
                    ids, texts, chars = [], [], 0
                if n >= SLICE or raw >= PIECE:
                    yield rows_of([(s, None, _packed(b.slice(begun, at - begun)), None)])
                    begun, raw = at, 0
                if n >= SLICE:
                    yield from sketch(s, held)
                    s, held, n = s + 1, [[], []], 0
            if begun < b.num_rows:
                yield rows_of([(s, None, _packed(b.slice(begun)), None)])
        if n:
            yield from sketch(s, held)
        trim()

    return docs.mapInArrow(run, _SLICED)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal numbers."""
    if not len(x):
        return []
    cuts = np.nonzero(x[1:] != x[:-1])[0] + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)]))


def _added(sketches: DataFrame, sizes: Sizes) -> DataFrame:
    """``s, part, bits, many``: of each slice's counters in a block, in order, a bit for two or more in all slices, and the
    number of these."""

    def add(sent: pa.Table) -> pa.Table:
        counter, two = np.zeros(1 << sizes.block, np.uint8), np.uint8(2)  # counts to two
        for c, counts in zip(sent["data"], sent["counts"]):
            at = unpack_gaps(c.as_py()).astype(np.int64)
            counter[at] = np.minimum(counter[at] + np.minimum(np.frombuffer(zlib.decompress(counts.as_py()), np.uint8), two), two)
        found = [counter[unpack_gaps(c.as_py()).astype(np.int64)] == 2 for c in sent["data"]]
        bits, many = pa.array([np.packbits(x).tobytes() for x in found], pa.binary()), pa.array([int(x.sum()) for x in found], pa.int64())
        return pa.table({"s": sent["s"], "part": sent["part"], "bits": bits, "many": many})

    return sketches.groupBy("part").applyInArrow(add, "s long, part long, bits binary, many long")


class Slice:
    """A slice's windows that both rows call repeated, each distinct one once, in the order of their hashes."""

    def __init__(self, sizes: Sizes, ids: list, texts: list, parts: list, bits: list):
        one, two, at, doc = sizes.windows(ids, texts)
        keep, blocks = np.ones(len(one), bool), 1 << (sizes.bits - sizes.block)
        for row, h in enumerate((one, two)):
            cells, back = np.unique(sizes.cells(h), return_inverse=True)
            block = (cells >> np.uint64(sizes.block)).astype(np.int64)
            mine = {p - row * blocks: x for p, x in zip(parts, bits) if p // blocks == row}
            said = [np.unpackbits(np.frombuffer(mine[int(block[a])], np.uint8), count=z - a) for a, z in _runs(block)]
            keep &= np.concatenate([np.zeros(0, np.uint8), *said]).astype(bool)[back]
        one, two, at, doc = one[keep], two[keep], at[keep], doc[keep]
        order = np.lexsort((two >> np.uint64(32), one))
        self.at, self.doc = at[order], doc[order]
        one, two = one[order], two[order] >> np.uint64(32)
        self.starts = np.nonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[0] if len(one) else np.zeros(0, np.int64)
        self.one, self.two = one[self.starts], two[self.starts]
        self.keys = np.array([-1 if k is None else k for k in ids], np.int64)[self.doc] if len(one) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(self.keys, self.starts) if len(one) else self.keys

    def buckets(self, sizes: Sizes) -> list[tuple[int, int, int]]:
        """(bucket, start, end) of the distinct windows."""
        of = (self.one >> np.uint64(64 - int(math.log2(sizes.buckets)))).astype(np.int64)
        return [(int(of[a]), a, z) for a, z in _runs(of)]

    def gone(self, outside: np.ndarray) -> dict[int, np.ndarray]:
        """Places of windows by document, where another slice (a bit a distinct window) or this one has a smaller id."""
        counts = np.diff(np.append(self.starts, len(self.at)))
        hit = np.repeat(outside, counts) | (self.keys > np.repeat(self.least, counts))
        doc, at = self.doc[hit], self.at[hit]
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order]
        return {int(doc[a]): at[a:z] for a, z in _runs(doc)}


_ASKED = "bucket int, s long, a binary, b binary, c binary"


def _asked(docs: DataFrame, added: DataFrame, sizes: Sizes) -> DataFrame:
    """Of each slice the distinct windows estimated repeated, cut into buckets of their first bits: hashes (a, b) and the
    smallest id of the slice (c, after their least)."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        s, docs = left["s"][0].as_py(), _unpacked(left["data"].to_pylist())
        x = Slice(sizes, docs["id"].to_pylist(), docs["text"].to_pylist(), right["part"].to_pylist(), right["bits"].to_pylist())
        rows = [
            (k, s, pack_gaps(x.one[a:z]), planes(x.two[a:z]), int(x.least[a:z].min()).to_bytes(8, "little", signed=True) + planes(x.least[a:z] - x.least[a:z].min()))
            for k, a, z in x.buckets(sizes)
        ]
        cols = list(zip(*rows)) or [()] * 5
        trim()
        return pa.table(dict(zip(("bucket", "s", "a", "b", "c"), (pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))))))

    return docs.groupBy("s").cogroup(added.groupBy("s")).applyInArrow(ask, _ASKED)


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each slice's windows, a bit where another slice has a smaller id."""
    one = [unpack_gaps(x) for x in pdf["a"]]
    sizes = np.array([len(x) for x in one])
    one, two = np.concatenate(one), np.concatenate([unplaned(x) for x in pdf["b"]])
    least = np.concatenate([unplaned(c[8:]).astype(np.int64) + int.from_bytes(c[:8], "little", signed=True) for c in pdf["c"]])
    order = np.lexsort((two, one))
    new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
    smallest = np.minimum.reduceat(least[order], np.nonzero(new)[0])
    smaller = np.empty(len(one), bool)
    smaller[order] = smallest[np.cumsum(new) - 1] < least[order]
    return pd.DataFrame({"s": pdf["s"], "part": -1 - pdf["bucket"].astype("int64"), "bits": [np.packbits(x).tobytes() for x in np.split(smaller, np.cumsum(sizes)[:-1])]})


def kept_words(text: str | None, at: np.ndarray | None, width: int) -> tuple[int, int, bytes]:
    """The number of words, that of the kept ones, and these; ``at`` has each place of a window that goes once."""
    words = (text or "").encode().split()
    if at is None or not len(at):
        return len(words), len(words), b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + width] -= 1
    kept = [words[i] for i in np.nonzero(np.cumsum(edge[:-1]) == 0)[0].tolist()]
    return len(words), len(kept), b" ".join(kept)


def substring_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 13,
    carry: tuple[str, ...] = (),
    keep_layout: bool = False,
) -> DataFrame:
    """``id, carried, n_words, n_removed, kept_text`` for every row; ``carried`` is a struct of the columns ``carry``.

    ``kept_text`` is the kept words joined by one space; with ``keep_layout``, the text itself where no word goes.
    """
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(0).alias("none"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), carried.alias("carried"))
    sizes = Sizes((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6, width)  # about the words
    schema = StructType([*docs.select("id", "carried").schema.fields]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    kind = F.when(F.col("part").isNull(), "docs").otherwise("sketch").alias("kind")
    sliced = stored(_slices(spread(docs), sizes).select("*", kind), "slices", by="kind")
    docs = sliced.filter("kind = 'docs'").select("s", "data")
    added = stored(_added(sliced.filter("kind = 'sketch'").drop("kind"), sizes), "added")
    dropped(sliced, "/kind=sketch")
    released(df.sparkSession)
    # a window that both rows call repeated is one of the first row's counters, so this many are sent at most, about
    sizes.asked(added.filter(F.col("part") < 1 << (sizes.bits - sizes.block)).agg(F.sum("many")).first()[0] or 0)
    added = added.drop("many")
    asked = _asked(docs, added, sizes)
    answered = asked.groupBy("bucket").applyInPandas(_answered, "s long, part long, bits binary")
    # written before the texts are shuffled: both at once would have the heap and the Python workers full together
    answers = added.unionByName(stored(answered, "answered"))
    released(df.sparkSession)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, parts, bits = _unpacked(left["data"].to_pylist()), right["part"].to_pylist(), right["bits"].to_pylist()
        ids, texts = docs["id"].to_pylist(), docs["text"].to_pylist()
        sketched, said = [k for k, p in enumerate(parts) if p >= 0], {-1 - p: b for p, b in zip(parts, bits) if p < 0}
        x = Slice(sizes, ids, texts, [parts[k] for k in sketched], [bits[k] for k in sketched])
        outside = [np.unpackbits(np.frombuffer(said[k], np.uint8), count=z - a) for k, a, z in x.buckets(sizes)]
        places = x.gone(np.concatenate([np.zeros(0, np.uint8), *outside]).astype(bool))
        counts, gone, kept = [], [], []
        for k, text in enumerate(texts):
            n, left_over, words = kept_words(text, places.get(k), width)
            counts.append(n)
            gone.append(n - left_over)
            kept.append(text if keep_layout and not gone[-1] else words.decode())
        del x, texts, places
        trim()
        return pa.table({"id": docs["id"], "carried": docs["carried"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return docs.groupBy("s").cogroup(answers.groupBy("s")).applyInArrow(cut, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

"""Best-fit packing of token sequences under several capacities.

Documents become pieces of at most ``tokens`` tokens; a bin (training sequence) has three capacities: tokens, documents
and attention cost (the sum of squared piece lengths). Pieces of one length are alike, so vector best-fit decreasing runs
on the histogram of lengths, which has at most ``tokens`` rows whatever the corpus: groups of equal bins are filled with
the next shorter length, the group chosen by weighted dot product or by residual norm, every constraint held. The plan
says for the r-th piece of a length which bin and offset it gets; ranks come from counts a task and length, so no task
holds the pieces of a length, the texts are tokenised once and only piece rows are shuffled.

Token ids are those of the ``tokenizers`` library for its file. For texts without an added token's string they are made
by the faster tiktoken engine from the vocabulary of the same file, if that is a plain byte-level BPE whose ids follow
its merges; tests compare both.
"""

from __future__ import annotations

import functools
import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import safe_pieces
from .common import map_texts, stored


#: Production capacities. Those of documents and attention cost are the most that 1,024 tokens can need: they shut out no
#: packing, but all three residuals take part in the choice of a sequence.
TOKENS, DOCUMENTS, ATTENTION = 1024, 1024, 1024 * 1024


@functools.lru_cache(maxsize=2)
def token_ids(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """The encoder of a ``tokenizers`` file, without special tokens; ``pattern`` is its split pattern."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    slow = lambda t: np.asarray(exact.encode(t, add_special_tokens=False).ids, "<u4")
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    plain = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    letters = plain | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    back = {c: b for b, c in letters.items()}
    ranks = {bytes(back[c] for c in w): k for w, k in said["model"]["vocab"].items() if all(c in back for c in w)}
    merged = [bytes(back[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in said["model"]["merges"]]
    in_order = len(ranks) == len(merged) + 256 and [ranks.get(m) for m in merged] == list(range(256, len(ranks)))
    kind = said.get("pre_tokenizer") or {}
    if not in_order or said.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space"):
        return slow
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = [a["content"] for a in said.get("added_tokens", [])]

    def encode(text: str) -> np.ndarray:
        if any(a in text for a in added):
            return slow(text)
        try:
            return np.concatenate([np.asarray(fast.encode_ordinary(p), "<u4") for p in safe_pieces(text)])
        except BaseException as e:  # the Rust splitter panics on huge runs of white space
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: whole ones, the first may be shorter."""
    first = n % most or most
    cuts = [0, *range(first, n + 1, most)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def pieces(df: DataFrame, path: str, pattern: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, part, nth``: the task, and the piece's number among those of its length
    there; only stable once written. A null text counts as empty: it is the end token alone."""
    none = "array<struct<piece:int,start:long,length:long,ids_crc32:long,part:int,nth:long>>"

    def work() -> Callable:
        encode, seen, part = token_ids(path, pattern), [0] * (most + 1), TaskContext.get().partitionId()

        def f(keys: list, texts: list) -> list:
            rows = []
            for t in texts:
                ids = np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")
                mine = []
                for k, (a, n) in enumerate(pieces_of(len(ids), most)):
                    crc = zlib.crc32(ids[a : a + n].tobytes())
                    mine.append({"piece": k, "start": a, "length": n, "ids_crc32": crc, "part": part, "nth": seen[n]})
                    seen[n] += 1
                rows.append(mine)
            return [keys, rows]

        return f

    return map_texts(df, id_col, text_col, f"id long, p {none}", work).select("id", F.inline("p"))


def plan(counts: dict[int, int], tokens: int, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, int]:
    """Best-fit decreasing on a histogram: rows (length, first rank, first bin, pieces a bin, offset), and the bins.

    The rank r of a length falls in the row with the largest first rank <= r; with d = r - first rank it gets bin
    ``first bin + d // pieces`` at ``offset + (d % pieces) * length``.
    """
    capacity = np.array([tokens, documents or tokens, attention or tokens * tokens], float)
    used = [k for k, c in enumerate((tokens, documents, attention)) if c]
    w = np.array(weights)[used] / capacity[used] ** 2
    groups: list[list] = []  # residual, bins, history
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        need, left = np.array([length, 1, length * length], float), counts[length]
        if groups:
            state = np.array([g[0] for g in groups])
            fits = np.nonzero((state >= need).all(1))[0]
            s = state[fits][:, used]
            score = ((s - need[used]) ** 2 * w).sum(1) if rule == "norm" else -(s * need[used] * w).sum(1)
            order = fits[np.argsort(score, kind="stable")].tolist()
        else:
            order = []
        for k in order:
            if not left:
                break
            residual, bins, history = groups[k]
            each = int((residual // need).min())
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            if rest >= each:
                rest = 0
            parts = [(full, each)] * (full > 0) + [(1, rest)] * (rest > 0)
            taken = sum(b for b, _ in parts)
            new = [[residual - n * need, b, (history, length, n, int(tokens - residual[0]))] for b, n in parts]
            left -= sum(b * n for b, n in parts)
            if taken < bins:
                new.append([residual, bins - taken, history])
            groups[k] = new[0]
            groups.extend(new[1:])
        if left:
            each = int((capacity // need).min())
            if not each:
                raise ValueError(f"a piece of {length} tokens exceeds a capacity by itself")
            for b, n in ((left // each, each), (1, left % each)):
                if b and n:
                    groups.append([capacity - n * need, b, (None, length, n, 0)])
    rows, ranks, first = [], dict.fromkeys(counts, 0), 0
    for _, bins, history in groups:
        while history:
            history, length, n, offset = history
            rows.append((length, ranks[length], first, n, offset))
            ranks[length] += bins * n
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5), first


def pack(found: DataFrame, tokens: int, documents: int | None = None, attention: int | None = None, rule: str = "norm") -> DataFrame:
    """Adds ``sequence_id, offset`` to a stored table of ``pieces``."""
    tasks = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    tasks = stored(tasks, "lengths")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, tokens, documents, attention, rule)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = found.join(offsets, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    key = rows[:, 0] << 44 | rows[:, 1] if len(rows) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            row = rows[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            d = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(row[:, 2] + d // row[:, 3]), pa.array(row[:, 4] + d % row[:, 3] * length)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(
    df: DataFrame,
    path: str,
    pattern: str,
    end_id: int = 2,
    tokens: int = 1024,
    documents: int | None = None,
    attention: int | None = None,
    rule: str = "norm",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise, cut and pack every row: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``documents`` and ``attention`` bound a sequence's pieces and sum of squared lengths; None sets no bound. Repeated
    rows are packed as often as they stand; an empty table gives no rows.
    """
    longest = tokens if not attention else min(tokens, math.isqrt(attention))
    found = stored(pieces(df, path, pattern, end_id, longest, id_col, text_col), "pieces")
    return pack(found, tokens, documents, attention, rule)

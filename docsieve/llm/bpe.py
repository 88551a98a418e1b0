"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding at safe boundaries: right before a space that follows a character which is not
white space. No match of the split pattern holds a character other than white space followed by white space, and its
only look-ahead starts inside white space, so encoding the pieces gives the ids of the whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Cut long texts into pieces of about so many characters.
PIECE = 1 << 16
_SAFE = regex.compile(r"\S(?= )")


def safe_pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at safe boundaries into pieces of ``size`` characters or, where no boundary follows, more."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size - 1)
        if not m:
            break
        out.append(text[start : m.end()])
        start = m.end()
    return [*out, text[start:]]


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Codec:
    """``ids(text)`` and ``raw(ids)``."""

    def __init__(self, ranks_path: str, pattern: str):
        self.enc, self.split = encoding(ranks_path, pattern), regex.compile(pattern)

    def ids(self, text: str) -> np.ndarray:
        parts = [self._piece(p) for p in safe_pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _piece(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.enc.encode_ordinary(text), "<u4")
        except BaseException as e:  # the Rust splitter gives up (a panic isn't an Exception) on huge runs of spaces
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            words = (m[0].encode() for m in self.split.finditer(text))
            return np.asarray([i for w in words for i in self.enc._core_bpe.encode_single_piece(w)], "<u4")

    def raw(self, ids: np.ndarray) -> bytes:
        return self.enc.decode_bytes(ids.tolist())


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id``, ``ids`` (array of long). A null text counts as empty and gets no ids; repeated rows stay."""

    def work() -> Callable:
        codec = Codec(ranks_path, pattern)
        return lambda keys, texts: [keys, [codec.ids(t or "") for t in texts]]

    return map_texts(df, id_col, text_col, "id long, ids array<long>", work)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Columns ``id``, ``bytes`` (binary): the raw bytes of each row's ids; null ids give no bytes."""

    def work() -> Callable:
        codec = Codec(ranks_path, pattern)
        return lambda keys, ids: [keys, [codec.raw(np.asarray(i or [], "<u4")) for i in ids]]

    return map_texts(df, id_col, ids_col, "id long, bytes binary", work)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; only digests leave the worker: ``id, n_tokens, ids_sha256, decoded_sha256``."""

    def work() -> Callable:
        codec = Codec(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def f(keys: list, texts: list) -> list:
            all_ids = [codec.ids(t or "") for t in texts]
            return [
                keys,
                [len(i) for i in all_ids],
                [sha(i.tobytes()) for i in all_ids],
                [sha(codec.raw(i)) for i in all_ids],
            ]

        return f

    return map_texts(df, id_col, text_col, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)

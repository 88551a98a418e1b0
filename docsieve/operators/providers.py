"""Pluggable providers for what needs an outside model, with deterministic local defaults.

A provider is a function of Columns to a Column, so that a model can come in as a pandas UDF (see ``batched``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from .lexical import STOP_WORDS

def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A unit vector of hashed word counts: equal texts have similarity 1, texts without a word in common about 0."""
    words = F.filter(F.split(F.lower(T.normalised(text)), r"\W+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))
    n = V.norm(raw)
    return F.when(n > 0, F.transform(raw, lambda x: x / n)).otherwise(raw)


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in cross-encoder: share of the query's words that the text holds."""
    q = F.array_distinct(F.split(F.lower(T.normalised(query)), " "))
    return F.size(F.array_intersect(q, F.split(F.lower(T.normalised(text)), " "))) / F.size(q)


def capitalised_entities(text: Column) -> Column:
    """A stand-in named-entity finder: map of label to distinct capitalised runs in first-seen order."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b(\p{Lu}\w+(?: \p{Lu}\w+)*)"), F.lit(1)))
    return F.create_map(F.lit("NAME"), found)


def query_terms(query: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """A stand-in part-of-speech filter: distinct lower-case words without stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(T.normalised(query)), r"\W+"), lambda w: (w != "") & ~w.isin(*stop_words)))


def stopword_language(text: Column) -> Column:
    """A stand-in language detector: the language with most of its commonest words in the text."""
    common = {"en": ("the", "and", "of", "to"), "de": ("der", "die", "und", "das"), "fr": ("le", "la", "et", "les"), "es": ("el", "los", "y", "que")}
    words = F.split(F.lower(text), r"\W+")
    votes = {k: _hits(words, v) for k, v in common.items()}
    best, out = F.greatest(*votes.values()), None
    for k, v in votes.items():
        out = F.when(v == best, k) if out is None else out.when(v == best, k)
    return F.when(best > 0, out)


def _hits(words: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*wanted)))


def missing(what: str) -> Callable[[Column], Column]:
    """A provider that there is no local stand-in for: a row that asks for it fails with this message."""
    return lambda content: F.when(content.isNotNull(), F.raise_error(f"no provider for {what}; pass one in Providers"))


@dataclass
class Providers:
    """What the pipelines call for outside models; each can be replaced."""

    embed: Callable[[Column], Column] = hashed_embedding
    cross_encode: Callable[[Column, Column], Column] = overlap_score
    entities: Callable[[Column], Column] = capitalised_entities
    terms: Callable[[Column], Column] = query_terms
    language: Callable[[Column], Column] = stopword_language
    pdf_text: Callable[[Column], Column] = missing("text and metadata of PDF files")
    pdf_tables: Callable[[Column], Column] = missing("tables of PDF files")
    ocr_words: Callable[[Column], Column] = missing("words of images")
    count_tokens: Callable[[Column], Column] = T.token_estimate
    classify: Callable[[str], dict[str, float]] = field(default=lambda q: {"general": 1.0})
    answer: Callable[[Column, Column], Column] = field(default=lambda question, context: context)


def batched(call: Callable[[list], list], returns: str, size: int = 100, tries: int = 3, longest_wait: float = 10.0) -> Callable[[Column], Column]:
    """A provider from a function of lists: Arrow batches cut to ``size``, tried again with doubling waits."""

    @F.pandas_udf(returns)
    def run(values):  # noqa: ANN001, ANN202
        import pandas as pd

        out: list = []
        for k in range(0, len(values), size):
            for attempt in range(tries):
                try:
                    out += call(values.iloc[k : k + size].tolist())
                    break
                except Exception:
                    if attempt == tries - 1:
                        raise
                    time.sleep(min(2.0**attempt, longest_wait))
        return pd.Series(out)

    return lambda c: run(c)

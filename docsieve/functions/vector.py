"""Vector arithmetic as Column expressions on ``array<double>``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v: Sequence[float]) -> Column:
    """One call for the whole array, however long the vector."""
    one = lambda x: f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)!r}')"
    return F.expr(f"array({', '.join(map(one, v))})") if len(v) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; null for a null or zero vector; vectors of different sizes raise."""
    same = F.assert_true(F.size(a) == F.size(b), "vectors differ in size")
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(a.isNull() | b.isNull(), None).when(same.isNull(), value)


def recency(created: Column, as_of: Column) -> Column:
    """1 / (1 + whole days of age)."""
    return 1.0 / (1 + F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created)) / 86400))


def token_density(tokens: Column) -> Column:
    return F.least(F.lit(1.0), tokens / 500)


def combined_score(similarity: Column, recency_: Column, density: Column) -> Column:
    return 0.7 * similarity + 0.2 * recency_ + 0.1 * density


def hybrid_score(distance: Column, text_rank: Column) -> Column:
    return 0.7 * (1 - distance) + 0.3 * text_rank


#: The SQL function of the same name, for ``spark.sql``.
COSINE_SQL = """CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
  sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"""

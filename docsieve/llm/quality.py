r"""Quality rules as a learned decision list.

Statistics of every whole text are taken in one pass. From labelled rows, sequential covering grows one rule at a time
for the unwanted class: a conjunction of thresholds, extended by the condition of best information gain on two thirds of
the rows, then pruned from its end on the other third; the rows it covers leave, and the next rule is grown until one
would not be precise enough. The list becomes one ordered ``when ... when ... otherwise`` expression of Spark, so that
judging runs inside the scan and the rules can be read.

Learning takes at most ``sample`` labelled rows: of those that can be used (a label of 0 or 1, a document of that id that
the base rule keeps), the ones with the smallest hash of their id. With no labels, or one class alone, the list is empty
and keeps everything the base rule keeps.

Words: runs of ``[^\x20\x09-\x0D]``. A null text has no words (all statistics 0) and fails the base rule. Repeated rows
are judged alike. Only (id, statistics) are joined with the labels, never the texts. An empty table gives no rows. A text
of any length is judged whole, in memory of its words' size; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_texts, sampled, stored

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")
#: Shares that rules may test, as (name, numerator, denominator).
SHARES = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("upper_per_char", "n_upper", "word_chars"),
    ("bangs_per_word", "n_bangs", "n_words"),
    ("repeats_per_word", "n_repeat_words", "n_words"),
    ("dup_lines_per_word", "n_dup_lines", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
)
#: Rules test shares alone: counts, and the share of distinct words, move with a text's length and would drop long texts.
TESTED = tuple(s[0] for s in SHARES)


def statistics(text: str | None, window: int = 5) -> list[int]:
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n > window:
        data = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        cut = [data[a:b] for a, b in zip(starts[: n - window + 1].tolist(), ends[window - 1 :].tolist())]
        if len(set(cut)) < len(cut):
            seen: dict[bytes, int] = {}
            for c in cut:
                seen[c] = seen.get(c, 0) + 1
            edge = np.zeros(n + 1, np.int64)
            at = np.array([i for i, c in enumerate(cut) if seen[c] > 1])
            edge[at] += 1
            edge[at + window] -= 1
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    return [
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count("!"),
    ]


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the columns COUNTS (long) of every row."""

    def work() -> Callable:
        return lambda keys, texts: [keys, *zip(*map(statistics, texts))] if keys else [[] for _ in range(1 + len(COUNTS))]

    return map_texts(df, id_col, text_col, "id long, " + ", ".join(f"{c} long" for c in COUNTS), work)


def with_shares(stats: DataFrame) -> DataFrame:
    of = {n: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for n, a, b in SHARES}
    return stats.withColumns(of)


@dataclass
class Rule:
    """All conditions (name, is_at_least, threshold) hold."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, up, t in self.conditions:
            out &= x[name] >= t if up else x[name] < t
        return out

    def expression(self) -> Column:
        out = F.lit(True)
        for name, up, t in self.conditions:
            out = out & (F.col(name) >= t if up else F.col(name) < t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<'} {t:.6g}" for n, up, t in self.conditions)


def _grown(x: dict[str, np.ndarray], y: np.ndarray, cuts: int, most: int) -> Rule:
    rule, inside = Rule(), np.ones(len(y), bool)
    while len(rule.conditions) < most and (y[inside] == 0).any():
        p, n = y[inside].sum(), (~y[inside].astype(bool)).sum()
        best = (1e-9, None)
        for name, v in x.items():
            values = v[inside]
            for t in np.unique(np.quantile(values, np.linspace(0, 1, cuts + 1)[1:], method="higher")):
                for up in (True, False):
                    hit = values >= t if up else values < t
                    p1 = y[inside][hit].sum()
                    n1 = hit.sum() - p1
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best[0]:
                            best = (gain, (name, up, float(t)))
        if best[1] is None:
            break
        name, up, _ = best[1]  # a tighter threshold takes the place of a looser one
        rule.conditions = [c for c in rule.conditions if c[:2] != (name, up)] + [best[1]]
        inside = rule.covers(x)
    return rule


def _pruned(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = r.covers(x)
        p = y[hit].sum()
        return (2 * p - hit.sum()) / hit.sum() if hit.any() else -1.0

    cut = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    return max(cut, key=lambda r: (worth(r), -len(r.conditions)), default=rule)


def learn(x: dict[str, np.ndarray], y: np.ndarray, precision: float = 0.95, cuts: int = 32, conditions: int = 4, rules: int = 12) -> list[Rule]:
    """An ordered rule list for y == 1; rows are split by their position, two thirds to grow and one to prune."""
    out, left = [], np.ones(len(y), bool)
    grow = np.arange(len(y)) % 3 != 0
    while len(out) < rules and y[left].any():
        part = lambda m: ({k: v[m] for k, v in x.items()}, y[m])
        g, p = left & grow, left & ~grow
        if not y[g].any():
            break
        rule = _grown(*part(g), cuts, conditions)
        if not rule.conditions:
            break
        if p.any():
            rule = _pruned(rule, *part(p))
        hit = rule.covers(x) & left
        if hit.sum() < 5 or y[hit].mean() < precision:
            break
        out.append(rule)
        left &= ~hit
    return out


def decision(rules: list[Rule]) -> Column:
    """1 where a rule says unwanted, by the first rule that covers the row."""
    out = F.when(F.lit(False), F.lit(0))
    for r in rules:
        out = out.when(r.expression(), F.lit(1))
    return out.otherwise(F.lit(0))


def learned_rules(shared: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", sample: int = 20000) -> list[Rule]:
    """Rules for label 0, from statistics with shares and a label table. Only rows that have both count as labelled."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null")
    usable = stored(shared.select("id", *TESTED).join(known, "id"), "labelled")
    rows = sampled(usable, sample, "id").toPandas()
    x = {c: rows[c].to_numpy(float) for c in TESTED}
    return learn(x, (rows["y"].to_numpy() == 0).astype(int))


def quality_rules(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    least_words: int = 10,
    most_repeated: int = 20,
    sample: int = 20000,
) -> tuple[DataFrame, list[Rule]]:
    """``id``, COUNTS, SHARES, ``base_failed``, ``kept`` for every row, and the rules."""
    shared = with_shares(stored(text_statistics(df, id_col, text_col), "statistics"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = shared.withColumn("base_failed", failed)
    # the list judges what the base rule lets through, and learns from that
    rules = learned_rules(judged.filter(~F.col("base_failed")), labels, label_col=label_col, sample=sample)
    return judged.withColumn("kept", ~F.col("base_failed") & (decision(rules) == 0)), rules


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

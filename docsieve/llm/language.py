"""Hierarchical language identification.

A text's features are its hashed byte bigrams and trigrams of the lower-cased whole text. A linear classifier first tells
the language family; inside a family, one-versus-one linear support vector machines separate its languages and vote.
Both levels are linear, so a text is scored in one gather of weight rows for its n-grams.

Families are a fixed table of ISO 639-1 codes; languages outside it form one family of their own kind. Learning takes at
most ``sample`` of the labelled rows, as many of each language as of any other where there are so many (those with the
smallest hash of id and text); it and predictions read whole texts. A null text or one without a letter is ``und`` with
score 0. The score is the logistic margin of the family times that of the closest pair, so a text of one letter comes out
low; a tie of votes goes to the name that sorts first. Repeated rows are predicted alike, an empty table gives no rows;
nothing but the sample is shuffled, and only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

#: Language families.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
BITS = 15
_A, _B = np.uint32(2654435761), np.uint32(2246822519)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), "other")


def ngrams(text: str) -> np.ndarray:
    """Feature numbers of every bigram and trigram, with a space put at both ends."""
    a = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] << np.uint32(8) | a[1:]
    three = two[:-1] << np.uint32(8) | a[2:]
    return np.concatenate([two * _A >> np.uint32(32 - BITS), three * _B >> np.uint32(32 - BITS)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the features that a text has, and their values, of length 1 together."""
    at, x = np.unique(ngrams(text), return_counts=True)
    x = x.astype(np.float32)
    return at, x / (np.linalg.norm(x) or 1)


def _sparse(text: str) -> Column:
    """A text's features as bytes: 2 for each number, then 4 for each value."""
    packed = lambda at, x: at.astype("<u2").tobytes() + x.astype("<f4").tobytes()

    @F.pandas_udf("binary")
    def of(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: packed(*_features(t)))

    return of(text)


def _unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(x) // 6
    return np.frombuffer(x, "<u2", n).astype(np.int64), np.frombuffer(x, "<f4", n, 2 * n)


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 12, c: float = 1.0) -> np.ndarray:
    """A linear SVM (squared hinge loss) on sparse rows by dual coordinate descent; y in {-1, 1}; the last weight is the
    bias."""
    w, alpha, bias = np.zeros(1 << BITS, np.float32), np.zeros(len(rows)), 0.0
    diagonal = np.array([float((x * x).sum()) for _, x in rows]) + 1 + 0.5 / c
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            gradient = y[i] * (float(w[at] @ x) + bias) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += np.float32(step) * x
                bias += step
                alpha[i] = new
    return np.append(w, np.float32(bias))


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]  # of one family each, or of two families' names
    weights: np.ndarray  # (features + 1) x pairs

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.langs:
            return "und", 0.0
        counts = np.bincount(ngrams(text), minlength=1 << BITS)
        at = np.flatnonzero(counts)  # one order of summing for texts of every length
        x = counts[at].astype(np.float64)
        margins, norm = x @ self.weights[at], np.sqrt(x @ x)
        margins = dict(zip(self.pairs, (margins / norm + self.weights[-1]).tolist()))
        family, sure = self._vote(self.families, margins)
        lang, surer = self._vote([x for x in self.langs if family_of(x) == family], margins)
        return lang, float(sure * surer)

    def _vote(self, names: list[str], margins: dict) -> tuple[str, float]:
        wins, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in itertools.combinations(names, 2):
            m = margins[a, b]
            wins[a if m >= 0 else b] += 1 + 1e-6 * np.tanh(abs(m))
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(names, key=lambda n: wins[n])
        return best, 1.0 if len(names) == 1 else float(1 / (1 + np.exp(-4 * max(least[best], -50.0))))


def fit(x: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
    """A model from texts' features."""
    known = sorted(set(langs))
    families = sorted({family_of(v) for v in known})
    y, f = np.array(langs), np.array([family_of(v) for v in langs])
    pairs, weights = [], []
    for a, b in itertools.combinations(families, 2):
        rows = np.nonzero((f == a) | (f == b))[0]
        pairs.append((a, b))
        weights.append(_svm([x[i] for i in rows], np.where(f[rows] == a, 1.0, -1.0)))
    for family in families:
        for a, b in itertools.combinations([v for v in known if family_of(v) == family], 2):
            rows = np.nonzero((y == a) | (y == b))[0]
            pairs.append((a, b))
            weights.append(_svm([x[i] for i in rows], np.where(y[rows] == a, 1.0, -1.0)))
    w = np.stack(weights, 1) if weights else np.zeros(((1 << BITS) + 1, 0), np.float32)
    return Model(known, families, pairs, w.astype(np.float32))


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many rows of each language to take, ``most`` in all: as even as the counts allow, and one at least."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, left // (len(counts) - k)))
        left -= out[lang]
    return out


def train(df: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 3000) -> Model:
    """A model from ``sample`` labelled rows with a letter where ``use`` holds, or all if there are fewer. Languages share
    the sample evenly, so that a rare one is not lost."""
    rows = df.filter(use).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.trim("lang") != "") & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    wanted = quotas(counts, sample)
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)).alias("h"), "id")
    near = F.lit(False)  # of the rows that can be used: so many hashes hold the smallest ones of each language
    for lang, n in wanted.items():
        near = near | ((F.col("lang") == lang) & (F.col("h") < int(min(1.0, 1.25 * n / counts[lang]) * (1 << 40))))

    def chosen(few: DataFrame) -> list:
        # whole texts become features on the executors; only the chosen rows' features go to the driver
        w = Window.partitionBy("lang").orderBy("h", "id")
        quota = F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col("lang"))
        first = few.withColumn("n", F.row_number().over(w)).filter((F.col("n") <= max(wanted.values())) & (F.col("n") <= quota))
        return first.select("lang", "h", "id", _sparse(F.col("text")).alias("x")).orderBy("lang", "h", "id").collect()

    found = chosen(rows.filter(near)) if wanted else []
    if len(found) < sum(wanted.values()):  # rows that repeat have one hash
        found = chosen(rows) if wanted else []
    return fit([_unpacked(r["x"]) for r in found], [r["lang"] for r in found])


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work() -> Callable:
        m = sent.value
        return lambda keys, texts: [keys, *zip(*map(m.predict, texts))] if keys else [[], [], []]

    return map_texts(df, id_col, text_col, "id long, lang_pred string, score double", work)


def predicted(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The prediction as a struct column, for use beside a row's other columns."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        found = [sent.value.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return of.asNondeterministic()(F.col(text_col))  # so that it isn't run once for each use of its result


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1

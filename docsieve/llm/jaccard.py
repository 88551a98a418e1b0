r"""Near-duplicates by the exact Jaccard similarity of word shingles, on top of Golay-code fuzzy hashing.

A document is the set of its shingles of five words (``width``). Two are near copies if their sets have a Jaccard
similarity of 0.8 (``least``) or more; a group is what such pairs connect. Every candidate is verified on the whole sets.

Candidates come from two kinds of keys. Golay keys (see ``simhash``) join the sets' 64-bit fingerprints that differ in at
most two bits: the copies and the long texts with few changes. They can't find all: at 0.8 fingerprints differ by about
ten bits. So documents also meet at MinHash keys, 24 of five minima each. A pair at 0.8 shares none with a probability of
7 in 100,000, one at 0.9 with one of 10^-9.

Equal sets are merged before. Documents of one key are first compared with its smallest one; the groups that come of it
are then compared where they still meet: all members of a key outside its largest group, with all of its other groups.
So a large group of copies costs no pairs, and no pair is left out unless a path of verified links joins it already. What
is left of a key is dealt to blocks of members; a task has two blocks, takes all their overlaps as a product of matrices
and gives out at most one link a member: pairs are never rows.

Words: A-Z lower-cased, runs of ``[^\x20\x09-\x0D]``; a text of fewer than five is one shingle, null and empty texts
are equal. Sets are those of 64-bit shingle hashes; the sets that are sent to be compared have 32 bits of these, by which two
shingles are taken for one in four billion times. Repeated rows stay in the result; an empty table gives no rows; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, dropped, joined, map_texts, released, stored, trim
from .components import components
from .simhash import grouped, links, text_hash

BANDS, MINIMA = 24, 5
#: Members of a block that a task compares with another, and columns of a matrix.
PART, COLUMNS = 512, 4096
_RNG = np.random.default_rng(0)
_A = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data, h = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begin, end = (ends - lengths)[:n], ends[len(words) - n :]
    return np.unique(np.fromiter((h(data[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, n))


def keys_of(grams: np.ndarray) -> np.ndarray:
    """The MinHash keys of a set; none of the empty set."""
    if not len(grams):
        return np.zeros(0, np.int64)
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        np.minimum(least, (grams[at : at + 512, None] * _A + _B).min(0), out=least)
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def fingerprint_of(grams: np.ndarray) -> int:
    """The 64-bit fingerprint of a set: a bit is 1 if set in over half its hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 15):
        ones += np.unpackbits(grams[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")[0])


def _sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, th, fp, n, code, keys``: ``fp`` is the hash of the whole set, ``n`` its size, ``code`` its fingerprint."""

    def work() -> Callable:
        def f(ids: list, texts: list) -> list:
            sets = [shingles(t, width) for t in texts]
            fps = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) for s in sets]
            return [ids, [text_hash(t) for t in texts], fps, list(map(len, sets)), list(map(fingerprint_of, sets)), list(map(keys_of, sets))]

        return f

    return map_texts(df, id_col, text_col, "id long, th long, fp long, n long, code long, keys array<long>", work)


def _sets(df: DataFrame, width: int) -> DataFrame:
    """``fp, grams``, each once a task."""

    def work() -> Callable:
        seen: set[int] = set()

        def f(fps: list, texts: list) -> list:
            new = [k for k, fp in enumerate(fps) if not (fp in seen or seen.add(fp))]
            return [[fps[k] for k in new], [np.unique(shingles(texts[k], width).astype(np.uint32)).view(np.int32) for k in new]]

        return f

    return map_texts(df, "fp", "text", "fp long, grams array<int>", work)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    a, b = sets.select(F.col("fp").alias("u"), F.col("grams").alias("a")), sets.select(F.col("fp").alias("v"), F.col("grams").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").filter(both / (F.size("a") + F.size("b") - both) >= least).select("u", "v")


def _side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members, their groups, and (member, shingle) of all their shingles."""
    grams = t.column(3).combine_chunks()
    row = np.repeat(np.arange(len(grams)), grams.value_lengths().to_numpy())
    return t.column(1).to_numpy(), t.column(2).to_numpy(), row, grams.flatten().to_numpy()


def overlaps(rows: tuple, grams: tuple, sizes: tuple) -> np.ndarray:
    """Of two blocks of sets the sizes of all intersections."""
    shared, which = np.intersect1d(*grams), []
    for row, g in zip(rows, grams):
        at = np.minimum(np.searchsorted(shared, g), max(0, len(shared) - 1))
        hit = shared[at] == g if len(shared) else np.zeros(len(g), bool)
        order = np.argsort(at[hit], kind="stable")
        which.append((row[hit][order], at[hit][order]))
    out = np.zeros(sizes, np.float64)
    for begin in range(0, len(shared), COLUMNS):
        parts = []
        for (row, at), n in zip(which, sizes):
            cut = slice(*np.searchsorted(at, [begin, begin + COLUMNS]))
            m = np.zeros((n, min(COLUMNS, len(shared) - begin)), np.float32)
            m[row[cut], at[cut] - begin] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _compared(least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        (x, xr, i, g), (y, yr, j, h) = _side(left), _side(right)
        both = overlaps((i, j), (g, h), (len(x), len(y)))
        sizes = np.bincount(i, minlength=len(x))[:, None] + np.bincount(j, minlength=len(y))[None, :]
        i, j = np.nonzero((both / (sizes - both) >= least) & (xr[:, None] != yr[None, :]))
        a, b = np.arange(len(x)), len(x) + np.arange(len(y))
        while True:  # each member takes the smallest number that it is linked to
            before = a.copy(), b.copy()
            np.minimum.at(b, j, a[i])
            np.minimum.at(a, i, b[j])
            if (a == before[0]).all() and (b == before[1]).all():
                break
        node, root = np.concatenate([x, y]), np.concatenate([a, b])
        linked = np.nonzero(root != np.arange(len(node)))[0]
        trim()
        return pa.table({"u": node[linked], "v": node[root[linked]]})

    return compare


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``id, th, root, component_id`` for every row: a number of its group and the smallest id of it."""
    docs = stored(_sketches(df, id_col, text_col, width), "sketches")
    first = {c: F.first(c).alias(c) for c in ("n", "code", "keys")}
    each = docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("many"), F.min(F.struct("id", "th")).alias("of"), *first.values())
    count = docs.count()
    each = stored(each, "distinct", most=count)
    total = each.count()
    keyed = stored(each.select("fp", "n", F.explode("keys").alias("key")), "keys", most=total * BANDS)
    each_keys, each = each, stored(each.select("fp", "least", "many", "of", "n", "code"), "sets", most=total)
    docs_keys, docs = docs, stored(docs.select("id", "th", "fp"), "documents", most=count)
    for old in (each_keys, docs_keys):
        dropped(old)

    codes = stored(each.groupBy("code").agg(F.min("fp").alias("c"), F.count("*").alias("sets")), "codes", most=total)
    near = links(codes.select(F.col("code").alias("fp"))).join(codes.select(F.col("code").alias("u"), F.col("c").alias("a")), "u")
    near = near.join(codes.select(F.col("code").alias("v"), F.col("c").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = joined(each.select("code", "fp"), codes, "code", "sets", total).filter("fp <> c").select(F.col("c").alias("u"), F.col("fp").alias("v"))

    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("fp", "n")).alias("c")).filter("many > 1"), "sizes", most=total * BANDS // 2)
    met = stored(joined(keyed, sizes.withColumn("members", F.col("many")), "key", "many", total * BANDS), "met", most=total * BANDS)
    dropped(keyed)

    alike = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-6  # noqa: E731, sizes that allow for it
    stars = met.filter(F.col("fp") != F.col("c.fp")).filter(alike("n", "c.n")).select(F.col("c.fp").alias("u"), F.col("fp").alias("v"))
    stars = stored(stars.unionByName(near).unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "stars")

    asked = met.select("fp").unionByName(stars.select(F.explode(F.array("u", "v")).alias("fp"))).distinct()
    wanted = stored(each.join(asked, "fp").select("fp", "of.id", "of.th"), "wanted", most=total)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = among(rows, wanted.select("id", "th")).alias("r")
    here = F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.th") == F.col("w.th"))
    rows = rows.join(wanted.alias("w").hint("merge"), here).select("fp", "text")
    sets = stored(_sets(rows, width), "sets")
    if sets.count() > wanted.count():  # repeated rows in several tasks
        more, sets = sets, stored(sets.dropDuplicates(["fp"]), "sets")
        dropped(more)

    released(df.sparkSession)
    verified = stored(_verified(stars, sets, least), "links")
    released(df.sparkSession)
    found = stored(components(verified), "groups", most=total)
    others = met.filter("members > 2 and fp <> c.fp").select("key", "fp")  # the smallest one has been compared with all
    now = stored(others.join(found, others.fp == found.node, "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "grouped", most=total * BANDS)
    dropped(met)
    groups = now.groupBy("key", "root").agg(F.count("*").alias("many"))
    mixed = groups.groupBy("key").agg(F.max(F.struct("many", "root")).alias("main"), F.count("*").alias("k"), F.sum("many").alias("many")).filter("k > 1")
    outside = F.col("many") - F.col("main.many")
    mixed = stored(mixed.select("key", "many", F.col("main.root").alias("main"), *(F.ceil(c / PART).cast("int").alias(n) for c, n in ((outside, "xs"), (F.col("many"), "ys")))), "mixed", most=total * BANDS // 2)
    left = joined(now, mixed, "key", "many", total * BANDS).withColumn("block", F.xxhash64("fp"))
    left = stored(left.join(sets, "fp").select("key", "fp", "root", "grams", "block", "main", "xs", "ys"), "left")
    released(df.sparkSession)
    x = left.filter("root <> main").select("key", F.pmod("block", "xs").alias("p"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("q"), "fp", "root", "grams")
    y = left.select("key", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("p"), F.pmod("block", "ys").alias("q"), "fp", "root", "grams")
    by = [F.xxhash64("key", F.col("p").cast("int"), F.col("q").cast("int")).alias("part")]
    x, y = (t.select(*by, *(F.col(c).alias(side + c) for c in ("fp", "root", "grams"))) for side, t in (("x", x), ("y", y)))
    more = stored(x.groupBy("part").cogroup(y.groupBy("part")).applyInArrow(_compared(least), "u long, v long"), "links")
    found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    for old in (sets, now, stars, wanted, mixed, left, sizes, codes, verified, more):
        dropped(old)
    released(df.sparkSession)
    return grouped(docs, each.select("fp", "least", "many"), found).select("id", "th", "root", "component_id")

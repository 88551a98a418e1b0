r"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are word sequences, each with a key phrase that must stand in a notice. The index keeps, for every template, its
two leads: the highest-IDF words of its key phrase, with their places in the template; IDF is taken over all documents.
Of a file the licence words (the words of the index) that it has are looked up, highest IDF first. A template both of
whose leads are among them gets its postings intersected by relative position: starts ``place in the file - place in
the template`` on which the two leads agree are candidates. A candidate counts if the key phrase stands at its place and
at least ``coverage`` of the template's words stand at theirs. As no notice counts without its key phrase, whose words
are the leads, none can be missed, whatever else of it is changed and whatever the IDFs are: these decide which words
are looked up, not what is found. A base phrase is a template whose key phrase is all of it, so exactly its places are
found.

Words: A-Z lower-cased, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A null text counts as empty; a text without words gives
zero counts, null places, empty labels; an empty table gives no rows. Rows are judged one by one: repeated rows and ids
stay, no row meets another, so a hot source or long texts can't skew a shuffle; only the word counts of the index are
shuffled (a row a word and task). Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, spread

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, template, mandatory key phrase.
NOTICES = (
    ("agpl-3.0", "gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "free software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once a row: no filter above can be pushed through a generator, which would
    put the expression, for every word again, in place of its name."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


class Template:
    def __init__(self, label: str, text: str, key: str, base: bool):
        self.label, self.words, self.base = label, text.split(), base
        self.key, key_words = key.split(), key.split()
        self.key_at = next(i for i in range(len(self.words)) if self.words[i : i + len(key_words)] == key_words)

    def leads(self, idf: dict[str, float]) -> list[tuple[str, int]]:
        """The two highest-IDF words of the key phrase (ties: first in it) with their first place there, in the template."""
        first = {w: self.key_at + i for i, w in reversed(list(enumerate(self.key)))}
        return sorted(first.items(), key=lambda x: (-idf[x[0]], x[1]))[:2]


def templates(base: dict[str, str], notices: tuple) -> list[Template]:
    return [Template(v, k, k, True) for k, v in base.items()] + [Template(*n, False) for n in notices]


def word_idf(df: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the templates' words over all rows; the driver gets one row a word of the templates."""
    of = F.array(*map(F.lit, vocabulary))
    seen = df.select(F.explode(F.array_intersect(words_of(F.col(text_col)), of)).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in seen.collect()}
    n = max(found.values(), default=0)
    return {w: math.log(1 + (n + 1) / (1 + found.get(w, 0))) for w in vocabulary}


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE,
    notices: tuple = NOTICES,
    coverage: float = 0.8,
) -> DataFrame:
    """``id, n_words, matches array<struct<label, base, start, coverage>>``; starts count words from 0."""
    df = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    ts = templates(base, notices)
    idf = word_idf(df, "text", sorted({w for t in ts for w in t.key}))
    index = [(t, t.leads(idf)) for t in ts]
    asked = sorted({w for _, leads in index for w, _ in leads}, key=lambda w: (-idf[w], w))
    scanned = once(df.select("id", "text"), words_of(F.col("text")), "words").select("id", "words", F.size("words").cast("long").alias("n_words"))
    # the file's licence words, highest IDF first, and the templates that these leave possible
    scanned = once(scanned, F.array_intersect(F.array(*map(F.lit, asked)), "words"), "mine")
    possible = F.filter(literal_index(index), lambda t: F.forall(t["leads"], lambda x: F.array_contains("mine", x["w"])))
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,coverage:double>>")
    scanned = once(scanned, F.when(F.size("mine") > 0, possible), "possible")
    places = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.element_at("words", i).isin(asked))
    hits = F.transform(places, lambda i: F.struct(F.element_at("words", i).alias("w"), (i - 1).alias("p")))
    scanned = once(scanned, F.when(F.size("possible") > 0, hits), "hits")

    def starts(lead: Column) -> Column:
        return F.transform(F.filter("hits", lambda h: (h["w"] == lead["w"]) & (h["p"] >= lead["p"])), lambda h: h["p"] - lead["p"])

    def found(t: Column) -> Column:
        agreed = F.array_distinct(F.array_intersect(starts(F.get(t["leads"], F.lit(0))), starts(F.get(t["leads"], F.size(t["leads"]) - 1))))
        kept = F.filter(agreed, lambda s: F.slice("words", s + 1 + t["key_at"], F.size(t["key"])) == t["key"])
        share = lambda s: F.aggregate(
            F.zip_with(F.slice("words", s + 1, F.size(t["words"])), t["words"], lambda a, b: F.when(a == b, 1).otherwise(0)),
            F.lit(0),
            lambda x, y: x + y,
        ) / F.size(t["words"])
        rows = F.transform(kept, lambda s: F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), share(s).alias("coverage")))
        return F.filter(rows, lambda m: m["coverage"] >= F.when(t["base"], 1.0).otherwise(coverage))

    matches = F.when(F.size("hits") > 0, F.flatten(F.transform("possible", found))).otherwise(none)
    return scanned.select("id", "n_words", matches.alias("matches"))


def literal_index(index: list[tuple[Template, list[tuple[str, int]]]]) -> Column:
    """The index as one literal of the plan: label, base, words, key, key_at, leads with their places."""
    text = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    texts = lambda ws: f"array({', '.join(map(text, ws))})"
    one = lambda t, leads: (
        f"named_struct('label', {text(t.label)}, 'base', {str(t.base).lower()}, 'words', {texts(t.words)}, 'key', {texts(t.key)}, "
        f"'key_at', {t.key_at}, 'leads', array({', '.join(f"named_struct('w', {text(w)}, 'p', {p})" for w, p in leads)}))"
    )
    return F.expr(f"array({', '.join(one(*x) for x in index)})")


def digest(scan: DataFrame) -> DataFrame:
    of_base = F.filter("matches", lambda m: m["base"])
    ends = F.transform("base", lambda m: m["start"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    return scan.withColumn("base", of_base).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(ends).cast("long").alias("first_word"),
        F.array_max(ends).cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
    )

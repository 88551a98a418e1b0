"""Duplicate removal among ranked rows.

Greedy removal keeps a row if no earlier *kept* row is similar to it. Given the similar pairs, rounds decide all rows
whose earlier neighbours are decided, until none is left; every round is two joins, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import dropped, stored


def exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``first_id, copies`` of each text that stands more than once; only digests are shuffled."""
    digest = df.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col), 256).alias("h")).filter("h is not null")
    return digest.groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("h")


def greedy_kept(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, pos, kept`` for ranked(id, pos) and undirected pairs(a, b) of ids."""
    pos = ranked.select("id", "pos")
    e = pairs.join(pos.select(F.col("id").alias("a"), F.col("pos").alias("pa")), "a")
    e = e.join(pos.select(F.col("id").alias("b"), F.col("pos").alias("pb")), "b")
    early = F.when(F.col("pa") < F.col("pb"), F.struct(F.col("a").alias("u"), F.col("b").alias("v")))
    e = stored(e.select(early.otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v"))).alias("e")).select("e.*").distinct(), "pairs")
    state = stored(pos.withColumn("kept", F.lit(None).cast("boolean")), "state")
    while state.filter("kept is null").limit(1).count():
        of = state.select(F.col("id").alias("u"), F.col("kept").alias("k"))
        seen = e.join(of, "u").groupBy("v").agg(F.max(F.coalesce("k", F.lit(False))).alias("hit"), F.count_if(F.col("k").isNull()).alias("open"))
        rule = F.when(F.col("hit"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        after = state.join(seen, state.id == seen.v, "left").select("id", "pos", F.coalesce("kept", rule).alias("kept"))
        after = stored(after, "state")
        dropped(state)
        state = after
    return state


def leader_clusters(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, leader``: each row with the earliest kept row it is similar to, kept rows with themselves."""
    state = greedy_kept(ranked, pairs)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lead = both.join(state.filter("kept").select(F.col("id").alias("a"), "pos"), "a").groupBy("b").agg(F.min_by("a", "pos").alias("leader"))
    return state.join(lead, state.id == lead.b, "left").select("id", F.when(F.col("kept"), F.col("id")).otherwise(F.col("leader")).alias("leader"))


def merged(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters as rows: contents joined by newline in rank order, the largest score, the leader's metadata.

    ``rows`` has id, pos, content, score, metadata."""
    j = rows.join(clusters, "id")
    return j.groupBy(F.col("leader").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("content"),
        F.max("score").alias("score"),
        F.min_by("metadata", "pos").alias("metadata"),
    )

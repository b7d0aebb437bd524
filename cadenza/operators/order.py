"""Order of takes from evidence groups: ranks within groups, averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import order_confidence

#: Rank of a take without evidence.
NO_EVIDENCE = 999.0


def evidence_ranks(evidence: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, take_id, grp, media_type, position, rank) from EVIDENCE rows; groups of one say nothing.

    rank runs from 0 to 1 in the group. ``within`` names columns, such as a session, that
    keep groups apart.
    """
    group = Window.partitionBy(*within, "grp")
    order = group.orderBy("ts", "source", "take_id")
    ranked = evidence.withColumn("members", F.count(F.lit(1)).over(group)).withColumn("position", F.row_number().over(order)).withColumn("rank", F.percent_rank().over(order))
    return ranked.where("members > 1").select(*within, "take_id", "grp", "media_type", "position", "rank")


def ambiguous_setups(ranks: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, take_sets, ambiguous): whether video groups cover different sets of takes."""
    sets = ranks.where("media_type = 'video'").groupBy(*within, "grp").agg(F.array_sort(F.collect_set("take_id")).alias("takes"))
    return sets.groupBy(*within).agg(F.countDistinct("takes").alias("take_sets")).withColumn("ambiguous", F.col("take_sets") > 1)


def take_order(evidence: DataFrame, takes: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, position, take_id, confidence, evidence_groups, average_rank) for each of takes.

    Takes are ordered by average rank and id; where video groups cover different takes and
    audio covers all of them, by the audio rank first. Positions count within ``within``:
    that is one session's takes, the largest set that one task orders.
    """
    ranks = evidence_ranks(evidence, within)
    per_take = ranks.groupBy(*within, "take_id").agg(
        F.count(F.lit(1)).alias("evidence_groups"), F.avg("rank").alias("average_rank"), F.min(F.when(F.col("media_type") == "audio", F.col("position"))).alias("audio_rank")
    )
    rows = takes.join(per_take, [*within, "take_id"], "left").withColumns({"evidence_groups": F.coalesce("evidence_groups", F.lit(0)), "average_rank": F.coalesce("average_rank", F.lit(NO_EVIDENCE))})
    setups = ambiguous_setups(ranks, within)
    session = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    if within:
        rows = rows.join(setups, list(within), "left")
    else:
        rows = rows.join(F.broadcast(setups), F.lit(True), "left")  # one row
    by_audio = F.coalesce("ambiguous", F.lit(False)) & (F.count("audio_rank").over(session) == F.count(F.lit(1)).over(session))
    order = session.orderBy(F.when(F.col("by_audio"), F.col("audio_rank")), F.round("average_rank", 12), "take_id")
    return rows.withColumn("by_audio", by_audio).select(
        *within, F.row_number().over(order).alias("position"), "take_id", order_confidence(F.col("evidence_groups")).alias("confidence"), "evidence_groups", "average_rank"
    )


def order_issues(ranks: DataFrame, takes: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """(*within, code, severity, subject): setups that order takes differently, and takes (*within, take_id) that no evidence (evidence_ranks' rows) orders."""
    keys = list(within)
    named = lambda rows, code, subject: rows.select(*keys, F.lit(code).alias("code"), F.lit("warn").alias("severity"), subject.alias("subject"))
    setups = ambiguous_setups(ranks, within).where("ambiguous")
    bare = takes.select(*keys, "take_id").distinct().join(ranks.select(*keys, "take_id"), [*keys, "take_id"], "left_anti")
    bare = bare.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("take_id")), ", ").alias("takes"))
    return named(setups, "take_order_cross_setup_ambiguous", F.lit("order")).unionByName(named(bare, "take_order_evidence_missing", F.col("takes")))

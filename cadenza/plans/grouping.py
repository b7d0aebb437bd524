"""The grouping plan: lanes for each count, assignment, classification, and the choice of a count."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators import assign, clusters, coverage, matching
from cadenza.storage import written

MAX_LANES = 8
#: Lanes of as many audios are assigned set by set: ties by rounding go as the sums do.
SETS = 6
# Weights of the objective, and how much worse a larger count may be.
WEIGHTS = {"production": 3.0, "average": 1.0, "silhouette": 0.8, "partial": -1.8, "unresolved": -1.6, "unassigned": -0.4, "single": -0.35, "oversize": -0.15, "spread": -1.2, "lanes": -0.06}
OVERMERGED = 0.28
TOLERANCE = 0.15
#: Takes that the objective counts as production have this many videos.
OBJECTIVE_VIDEOS = (3, 4)


class Candidates(NamedTuple):
    lanes: DataFrame  # session, lane_count, lane, video
    assignments: DataFrame  # session, lane_count, lane, video, audio, pair_score, assigned
    buckets: DataFrame  # session, lane_count and BUCKET
    measures: DataFrame  # session, lane_count, objective, production, unresolved, silhouette


def _buckets(audios: DataFrame, assigned: DataFrame) -> DataFrame:
    """matching.classify for each session and count: keys are packed into the names for it."""
    key = ["session", "lane_count"]
    pack = lambda c: F.when(F.col(c).isNotNull(), F.struct(*key, F.col(c).alias("name")))
    counts = assigned.select(*key).distinct()
    return matching.classify(
        audios.join(counts, "session").select(pack("audio").alias("audio")), assigned.select(pack("video").alias("video"), pack("audio").alias("audio"), "pair_score", "assigned")
    ).select("source.session", "source.lane_count", F.col("source.name").alias("source"), "media_type", "bucket", "reason", "confidence")


def candidates(audios: DataFrame, videos: DataFrame, pairs: DataFrame, max_lanes: int = MAX_LANES) -> Candidates:
    """All counts of lanes of all sessions.

    audios (session, audio), videos (session, video, descriptor), pairs (session, video,
    audio, pair_score): pair scores do not depend on the count, so they are computed once.
    """
    key = ["session", "lane_count"]
    lanes = written(clusters.lanes(videos, "session", "video", "descriptor", list(range(1, max_lanes + 1))))
    # measures, buckets and takes all read the assignments
    assigned = written(assign.assign(pairs.join(lanes, ["session", "video"]), *key, sets=SETS))
    buckets = _buckets(audios, assigned)
    takes = assigned.where("assigned").groupBy(*key, "audio").agg(F.count(F.lit(1)).alias("n"), F.avg("pair_score").alias("confidence"))
    low, high = OBJECTIVE_VIDEOS
    good = F.col("n").between(low, high) & (F.col("confidence") >= S.MIN_TAKE_SCORE)
    per_take = takes.groupBy(*key).agg(
        F.count_if(good).alias("production"), F.count_if(~good).alias("partial"), F.count_if(S.is_production_take(F.col("n"), F.col("confidence"))).alias("takes")
    )
    scores = assigned.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col("assigned"), F.col("pair_score"))), F.lit(0.0)).alias("average"), F.count_if(~F.col("assigned")).alias("unassigned"))
    with_vectors = lanes.join(videos.select("session", "video", "descriptor"), ["session", "video"]).withColumn("group", F.struct(*key, "lane"))
    spread = clusters.spread(with_vectors.where("descriptor is not null"), "group", "video", "descriptor").select("group.*", "spread")
    n_audio = audios.groupBy("session").agg(F.count(F.lit(1)).alias("audios"))
    sizes = lanes.groupBy(*key, "lane").agg(F.count(F.lit(1)).alias("size")).join(spread, [*key, "lane"], "left").join(n_audio, "session", "left")
    per_lane = sizes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("lanes"), F.count_if(F.col("size") == 1).alias("single"), F.sum(F.greatest(F.lit(0), F.col("size") - F.coalesce("audios", F.lit(0)))).alias("oversize"),
        F.sum(F.greatest(F.lit(0.0), F.coalesce("spread", F.lit(0.0)) - OVERMERGED)).alias("spread"),
    )
    sil = clusters.silhouette(with_vectors.where("descriptor is not null").withColumn("w", F.struct(*key)), "video", "lane", "descriptor", "w").select("w.*", "silhouette")
    unresolved = buckets.where("bucket = 'unresolved'").groupBy(*key).agg(F.count(F.lit(1)).alias("unresolved"))
    rows = reduce(lambda a, b: a.join(b, key, "left"), (per_take, sil, unresolved), per_lane.join(scores, key, "left")).na.fill(0)
    objective = reduce(lambda a, b: a + b, (w * F.col(c) for c, w in WEIGHTS.items()))
    return Candidates(lanes, assigned, buckets, rows.select(*key, objective.alias("objective"), F.col("takes").alias("production"), "unresolved", "silhouette"))


def choose(measures: DataFrame) -> DataFrame:
    """(session, lane_count) of each session's best candidate.

    Counts are gone through in order: a better objective wins, and so does a larger count
    that is not much worse and leaves no more unresolved and no fewer takes. A session has
    MAX_LANES rows at most, folded in one expression.
    """
    rows = measures.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("lane_count", "objective", "production", "unresolved"))).alias("x"))

    def better(best: Column, c: Column) -> Column:
        return (c["objective"] > best["objective"] + 1e-6) | (
            (c["objective"] >= best["objective"] - TOLERANCE) & (c["unresolved"] <= best["unresolved"]) & (c["production"] >= best["production"])
        )

    best = F.aggregate(F.slice("x", 2, MAX_LANES), F.get("x", F.lit(0)), lambda b, c: F.when(better(b, c), c).otherwise(b))
    return rows.select("session", best["lane_count"].alias("lane_count"))


def plan(audios: DataFrame, videos: DataFrame, pairs: DataFrame, max_lanes: int = MAX_LANES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(takes, buckets, issues) of every session.

    takes (session, take_id, audio, video, label, pair_score, confidence, note); buckets with
    session; issues (session, code, severity, subject).
    """
    found = candidates(audios, videos, pairs, max_lanes)
    chosen = choose(found.measures)
    key = ["session", "lane_count"]
    kept = found.assignments.where("assigned").join(chosen, key)
    per = kept.groupBy("session", "audio").agg(F.count(F.lit(1)).alias("videos"), F.avg("pair_score").alias("confidence"))
    per = per.where(S.is_production_take(F.col("videos"), F.col("confidence")))
    numbered = per.withColumn("take_id", S.take_name(F.row_number().over(Window.partitionBy("session").orderBy("audio"))))
    order = clusters.lane_order(found.lanes.join(chosen, key), "lane", "video", "session")
    labels = order.withColumn("label", S.group_label(F.row_number().over(Window.partitionBy("session").orderBy("first")) - 1)).select("session", "lane", "label")
    takes = kept.join(numbered, ["session", "audio"]).join(labels, ["session", "lane"]).select("session", "take_id", "audio", "video", "label", F.round("pair_score", 4).alias("pair_score"), F.round("confidence", 4).alias("confidence"), S.low_confidence_note(F.col("confidence")).alias("note"))
    buckets = found.buckets.join(chosen, key).drop("lane_count")
    # issues read both several times
    takes, buckets = written(takes), written(buckets)
    return takes, buckets, plan_issues(audios, videos, takes, buckets)


def planned_sources(takes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(session, source): all media of a plan's takes, and what it excludes or leaves unresolved."""
    own = takes.select("session", F.explode(F.array("audio", "video")).alias("source")).distinct()
    return own.unionByName(buckets.where(F.col("bucket").isin("excluded", "unresolved")).select("session", "source"))


def plan_issues(audios: DataFrame, videos: DataFrame, takes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(session, code, severity, subject) of a plan's assets, takes and buckets.

    A session with media of one kind only has no other issue, and where videos come with
    descriptors, neither has one without any. Media that a take uses count neither as
    excluded nor as unresolved.
    """
    named = lambda rows, code, severity, subject: rows.select("session", F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.alias("subject"))
    a, v = audios.select("session").distinct(), videos.select("session").distinct()
    whole, parts = a.join(v, "session", "left_semi"), ()
    if "descriptor" in videos.columns:
        seen = videos.where("descriptor is not null").select("session").distinct()
        parts = (named(whole.join(seen, "session", "left_anti"), "lane_clustering_failed", "fail", F.lit("plan")),)
        whole = whole.join(seen, "session", "left_semi")
    per = takes.groupBy("session", "take_id").agg(F.count(F.lit(1)).alias("videos"), F.max("confidence").alias("confidence"))
    used = takes.select("session", F.explode(F.array("audio", "video")).alias("source")).distinct()
    rest = buckets.join(used, ["session", "source"], "left_anti").join(whole, "session", "left_semi")
    parts += (
        named(v.join(a, "session", "left_anti"), "incoming_audio_missing", "fail", F.lit("plan")), named(a.join(v, "session", "left_anti"), "incoming_video_missing", "fail", F.lit("plan")),
        named(whole.join(takes.select("session"), "session", "left_anti"), "grouping_failed", "fail", F.lit("plan")),
        named(rest.where("bucket = 'unresolved'").select("session").distinct(), "unresolved_media_present", "warn", F.lit("plan")),
        named(rest.where("bucket = 'excluded'"), "excluded_media_detected", "info", F.col("source")),
        named(per.where(~F.col("videos").between(S.MIN_TAKE_VIDEOS, S.MAX_TAKE_VIDEOS)), "take_size_invalid", "warn", F.col("take_id")),
        named(per.where(F.col("confidence") < S.MIN_TAKE_SCORE), "take_confidence_low", "warn", F.col("take_id")),
    )
    return reduce(DataFrame.unionByName, parts)


def plan_targets(takes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(session, take_id, source, target): where a plan's files go; excluded ones have no take."""
    own = F.struct(F.col("audio").alias("source"), F.concat(F.lit("audio"), S.path_suffix(F.col("audio"))).alias("name"))
    video = F.struct(F.col("video").alias("source"), F.concat("label", S.path_suffix(F.col("video"))).alias("name"))
    rows = takes.select("session", "take_id", F.explode(F.array(own, video)).alias("x")).select("session", "take_id", "x.*").distinct()
    into = rows.select("session", "take_id", "source", F.concat_ws("/", F.lit("takes"), "take_id", "name").alias("target"))
    out = buckets.where("bucket = 'excluded'").select("session", F.lit(None).cast("string").alias("take_id"), "source", F.concat(F.lit("excluded/"), S.path_name(F.col("source"))).alias("target"))
    return into.unionByName(out)


def preflight(planned: DataFrame, current: DataFrame, targets: DataFrame, found: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(check, subject) of what keeps a plan from being applied: planned and current (source), targets (target, exists, and take_id), issues of the plan, roots (planned, given)."""
    drift = coverage.drift(planned, current, "source").select(F.concat(F.lit("source_"), "side").alias("check"), F.col("source").alias("subject"))
    twice = coverage.duplicates(planned, "source").select(F.lit("source_twice").alias("check"), F.col("source").alias("subject"))
    same = coverage.duplicates(targets, "target").select(F.lit("target_twice").alias("check"), F.col("target").alias("subject"))
    there = targets.where("exists").select(F.lit("target_exists").alias("check"), F.col("target").alias("subject"))
    bad = found.where("severity <> 'info'").select(F.lit("plan_not_passed").alias("check"), F.col("code").alias("subject"))
    parts = [drift, twice, same, there, bad]
    if "take_id" in targets.columns:
        blank = targets.where(F.coalesce("target", F.lit("")) == "").select(F.lit("target_missing").alias("check"), F.coalesce("take_id", F.lit("")).alias("subject"))
        parts.append(blank)
    if roots is not None:
        parts.append(roots.where(~F.col("planned").eqNullSafe(F.col("given"))).select(F.lit("other_root").alias("check"), F.col("given").alias("subject")))
    return reduce(DataFrame.unionByName, parts)

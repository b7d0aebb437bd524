"""Scores of audio and video pairs, and what becomes of media after assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators.coverage import keep_best
from cadenza.storage import spread, written


def duration_pairs(audio: DataFrame, video: DataFrame, lane: str = "lane") -> DataFrame:
    """All pairs within a lane: (lane, audio, video, duration_score, gap); inputs (lane, audio, audio_s) and (lane, video, video_s)."""
    score, gap = S.duration_score(F.col("audio_s"), F.col("video_s"))
    return audio.join(spread(video, lane), lane).select(lane, "audio", "video", score.alias("duration_score"), gap.alias("gap"))


def near_pairs(audio: DataFrame, video: DataFrame, *lane: str) -> DataFrame:
    """The pairs of duration_pairs whose lengths differ by MAX_GAP_SECONDS at most, by a join of buckets that long.

    Any other pair has a duration score of 0, so a pair score below the null choice: it is
    never assigned. An audio meets its own bucket and both neighbours; unlike lengths never
    meet, however many clips a lane has.
    """
    lane = lane or ("lane",)
    bucket = lambda c: F.floor(F.col(c) / S.MAX_GAP_SECONDS)
    around = audio.withColumn("_bucket", F.explode(F.array(*(bucket("audio_s") + k for k in (-1, 0, 1)))))
    met = around.join(video.withColumn("_bucket", bucket("video_s")), [*lane, "_bucket"])
    score, gap = S.duration_score(F.col("audio_s"), F.col("video_s"))
    return met.withColumn("duration_score", score).withColumn("gap", gap).where(F.col("gap") <= S.MAX_GAP_SECONDS).drop("_bucket")


def far_scores(audio: DataFrame, video: DataFrame, waveform: float, *session: str) -> DataFrame:
    """video's rows with a null audio and pair_score: the best of their pairs that near_pairs leaves out, 0 without such.

    Their duration score is 0, so it is the same for all of one waveform score, and whether
    there is one the shortest and longest audio of a session say.
    """
    ends = audio.groupBy(*session).agg(F.min("audio_s").alias("_least"), F.max("audio_s").alias("_most"))
    far = (F.col("video_s") - F.col("_least") > S.MAX_GAP_SECONDS) | (F.col("_most") - F.col("video_s") > S.MAX_GAP_SECONDS)
    score = F.when(far, S.pair_score(F.lit(0.0), F.lit(waveform))).otherwise(0.0)
    rows = video.join(ends, list(session))
    return rows.select(*video.columns, F.lit(None).cast(audio.schema["audio"].dataType).alias("audio"), score.alias("pair_score"))


def take_confidence(assignments: DataFrame) -> DataFrame:
    """(audio, videos, confidence): count and mean pair score of what is assigned."""
    return assignments.where("assigned").groupBy("audio").agg(F.count(F.lit(1)).alias("videos"), F.avg("pair_score").alias("confidence"))


def classify(audios: DataFrame, assignments: DataFrame) -> DataFrame:
    """BUCKET rows from (audio) and ASSIGNMENT rows; production takes and their videos have none.

    A confidence stands only where an audio has videos: the count is asked first. What comes
    of the assignments is read four times, so they are written once, and dealt into tasks
    of bounded size.
    """
    rows = written(assignments)
    n = rows.count()
    assignments = spread(rows, "audio", count=n)
    takes = audios.join(take_confidence(assignments), "audio", "left").withColumn("videos", F.coalesce("videos", F.lit(0)))
    takes = takes.withColumn("production", S.is_production_take(F.col("videos"), F.col("confidence")))
    bucket = F.when((F.col("videos") <= 2) & (F.col("confidence") < S.MIN_TAKE_SCORE), "excluded").otherwise("unresolved")
    reason = F.when(F.col("bucket") == "excluded", "too few or weak videos for a take").otherwise("part of a take only")
    orphans = takes.where("videos = 0").select(F.col("audio").alias("source"), F.lit("audio").alias("media_type"), F.lit("excluded").alias("bucket"), F.lit("no lane gave a video").alias("reason"), F.lit(0.95).alias("confidence"))
    partial = takes.where("videos > 0 and not production").withColumn("bucket", bucket).withColumn("reason", reason)
    sounds = partial.select(F.col("audio").alias("source"), F.lit("audio").alias("media_type"), "bucket", "reason", F.round("confidence", 4).alias("confidence"))
    used = assignments.where("assigned")
    members = used.join(partial.select("audio", "bucket", "reason"), "audio").select(F.col("video").alias("source"), F.lit("video").alias("media_type"), "bucket", "reason", F.round("pair_score", 4).alias("confidence"))
    by_video = spread(rows, "video", count=n)
    loose = by_video.where("not assigned").join(by_video.where("assigned").select("video"), "video", "left_anti").select(
        F.col("video").alias("source"), F.lit("video").alias("media_type"), F.when(F.col("pair_score") < S.MIN_LANE_SCORE, "excluded").otherwise("unresolved").alias("bucket"),
        F.lit("no audio fits this video").alias("reason"), F.round("pair_score", 4).alias("confidence"),
    )
    found = orphans.unionByName(sounds).unionByName(members).unionByName(loose)
    return keep_best(spread(found, "bucket", "media_type", "source", count=n), ("bucket", "media_type", "source"), "confidence", ("reason",))

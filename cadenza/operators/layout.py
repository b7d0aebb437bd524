"""Takes on a timeline: prefix sums of segments, and the check of what was laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.signal import running

GAP_SECONDS = 5.0


def gap_frames(frame_rate: float, seconds: float = GAP_SECONDS) -> int:
    """Half goes to the even neighbour, as in rint."""
    return round(frame_rate * seconds)


def take_segments(takes: DataFrame, clips: DataFrame, session: str = "session", take: str = "take_id") -> DataFrame:
    """(session, take, audio_frames, shift, segment): from (session, take, audio_frames) and (session, take, offset, frames).

    ``shift`` moves a take right so that no clip begins before it; ``segment`` is its length.
    """
    per = clips.groupBy(session, take).agg(F.min("offset").alias("least"), F.max(F.col("offset") + F.col("frames")).alias("most"))
    rows = takes.join(per, [session, take], "left").withColumn("shift", F.greatest(F.lit(0), -F.coalesce("least", F.lit(0))))
    return rows.withColumn("segment", F.col("shift") + F.greatest("audio_frames", F.coalesce("most", F.lit(0)))).drop("least", "most")


def timeline(segments: DataFrame, gap: int, session: str = "session", take: str = "take_id") -> DataFrame:
    """segments with record (where the take begins) and marker (where its audio does); sessions are laid out each by itself."""
    rows = segments.withColumn("record", running(F.col("segment") + gap, session, order=take))
    return rows.withColumn("marker", F.col("record") + F.col("shift"))


def placed_clips(laid: DataFrame, clips: DataFrame, angles: DataFrame, session: str = "session", take: str = "take_id") -> DataFrame:
    """(session, take, label, file, track, start): clips at marker + offset, packed on tracks from 1 by the order of angles (angle, pos), then label and file."""
    rows = clips.join(laid.select(session, take, "marker"), [session, take]).join(angles.select(F.col("angle").alias("label"), "pos"), "label", "left")
    track = F.row_number().over(Window.partitionBy(session, take).orderBy(F.col("pos").asc_nulls_last(), "label", "file"))
    return rows.select(session, take, "label", "file", track.alias("track"), (F.col("marker") + F.col("offset")).alias("start"))


def track_name(kind: Column, index: Column) -> Column:
    """What track_names calls a track."""
    return F.when(kind == "video", F.format_string("compact-v%d", index)).when(index == 1, "master-audio").otherwise(F.format_string("scratch-compact-v%d", index - 1))


def track_names(counts: DataFrame, n: str = "tracks") -> DataFrame:
    """One row for each track, with its kind, index and name: n video tracks, then the master's and n scratch tracks of audio."""
    tracks = F.concat(
        F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.struct(F.lit("video").alias("kind"), i.alias("index"), F.format_string("compact-v%d", i).alias("name"))),
        F.array(F.struct(F.lit("audio").alias("kind"), F.lit(1).alias("index"), F.lit("master-audio").alias("name"))),
        F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.struct(F.lit("audio").alias("kind"), (i + 1).alias("index"), F.format_string("scratch-compact-v%d", i).alias("name"))),
    )
    return counts.select(*[c for c in counts.columns if c != n], F.explode(tracks).alias("t")).select(*[c for c in counts.columns if c != n], "t.*")


def verify(expected: DataFrame, observed: DataFrame, by_start: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, track, take_id, difference): what differs between expected (track, take_id, name, start) and observed (track, name, start).

    ``difference`` is missing, name or start. Items are matched by their place on the track,
    so one that is missing shifts all that follow; ``by_start`` matches them by their start
    instead. An unknown start counts as -1. ``within`` names the sessions' columns.
    """
    keys = [*within, "track"]
    same = [F.col(f"e.{c}") == F.col(f"o.{c}") for c in keys]
    if by_start:
        joined = expected.alias("e").join(observed.alias("o"), [*same, F.col("e.start") == F.col("o.start")], "left")
    else:
        place = lambda df: df.withColumn("start", F.coalesce("start", F.lit(-1))).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "name")))
        joined = place(expected).alias("e").join(place(observed).alias("o"), [*same, F.col("e.i") == F.col("o.i")], "left")
    difference = F.when(F.col("o.track").isNull(), "missing").when(F.col("e.name") != F.col("o.name"), "name").when(F.col("e.start") != F.col("o.start"), "start")
    return joined.select(*(F.col(f"e.{c}").alias(c) for c in keys), F.col("e.take_id").alias("take_id"), difference.alias("difference")).where("difference is not null")

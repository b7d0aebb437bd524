"""Inspection of sessions' projects: snapshots of timelines, bins and settings against what takes ask for.

Snapshots are plain tables with a session column, so any number of sessions is inspected
in one plan; places on a track are counted inside a session's track. Issues are rows of
session, take_id (null for the session's own), code, severity and subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators import layout
from cadenza.storage import spread

START_TIMECODE = "00:00:00;00"
MASTER_CLIP = "audio-master"
SYNC_CONFIDENCE = 0.70
#: Severities of the issues that this module finds.
SEVERITIES = {
    "warn": (
        "color_prep_track_name_mismatch", "color_prep_sync_confidence_low", "timeline_playback_framerate_mismatch", "resolve_setting_drift", "stale_top_level_bin", "stale_top_level_item",
        "stray_timeline", "take_extra_clip", "project_snapshot_missing", "still_source_missing", "still_render_failed",
    ),
}


def _issue(rows: DataFrame, code: str | Column, subject: Column, take: Column | None = None) -> DataFrame:
    named = F.lit(code) if isinstance(code, str) else code
    severity = F.when(F.col("code").isin(*SEVERITIES["warn"]), "warn").otherwise("fail")
    take_id = F.lit(None).cast("string") if take is None else take.cast("string")
    return rows.select("session", take_id.alias("take_id"), named.alias("code"), subject.cast("string").alias("subject")).where("code is not null").withColumn("severity", severity)


def _found(rows: DataFrame, checks: list[tuple[str, Column]], subject: Column, take: Column | None = None) -> DataFrame:
    """Issues of all checks that hold, in one pass."""
    codes = F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in checks)))
    return _issue(rows.withColumn("_code", F.explode(codes)), F.col("_code"), subject, take)


def expected_tracks(cameras: DataFrame, angles: DataFrame | None = None, keys: tuple[str, ...] = ("session", "take_id")) -> DataFrame:
    """cameras (session, take_id, label, file) with track: packed from 1 in the order of the session's angles (session, label, pos), then label and file.

    Without angles cameras bring pos themselves. ``keys`` name a take.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("pos").asc_nulls_last(), "label", "file")
    rows = cameras if angles is None else cameras.join(angles, ["session", "label"], "left")
    return rows.withColumn("track", F.row_number().over(order)).drop("pos")


def _together(*parts: DataFrame) -> DataFrame:
    """The rows of all parts with kind, the number of their part, and null for columns that a part lacks; those without a session join nothing."""
    kinds = (df.where("session is not null").withColumn("_kind", F.lit(k)) for k, df in enumerate(parts))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)


def _kind(k: int, c: str | Column | bool = True) -> Column:
    return F.when(F.col("_kind") == k, F.col(c) if isinstance(c, str) else c)


def timeline_issues(timelines: DataFrame, takes: DataFrame, cameras: DataFrame, tracks: DataFrame, items: DataFrame, links: DataFrame, markers: DataFrame, prefix: str = "take:") -> DataFrame:
    """What differs between sessions' takes and their timelines.

    timelines (session, exists, start_timecode; a null timecode is not known), takes
    (session, take_id, pos), cameras (session, take_id, label, track, and pos of their take
    if they have it), tracks (session, kind, index, name), items (session, kind, track, name,
    start), links (session, name, start, kind, track, to_name, to_start, to_kind, to_track),
    markers (session, frame, custom_data). Items are used up in order: a take's camera has
    the next item of its track, whatever it is, so one that is missing shifts all that
    follow. Where a timeline does not exist that is its only issue.

    All that belongs to a session is dealt by session once and meets there by windows, so a
    row is shipped once however many tables it is compared with. cameras are counted before,
    so they should be a table.
    """
    there = timelines.where("exists").select("session").distinct()
    gone = _issue(timelines.where(~F.col("exists")), "color_prep_timeline_missing", F.lit("timeline"))
    late = _issue(timelines.where(F.col("exists") & (F.col("start_timecode") != START_TIMECODE)), "color_prep_start_timecode_mismatch", F.col("start_timecode"))
    n = cameras.count()

    counts = _together(there, cameras.select("session", F.col("track").cast("long").alias("track")), tracks.select("session", "kind")).groupBy("session").agg(
        F.max(_kind(0)).alias("there"), F.coalesce(F.max("track"), F.lit(0)).alias("videos"), F.count_if(F.col("kind") == "video").alias("v"), F.count_if(F.col("kind") == "audio").alias("a")
    ).where("there")
    few = _found(counts, [("color_prep_video_tracks_missing", F.col("v") < F.col("videos")), ("color_prep_audio_track_missing", F.col("a") < F.col("videos") + 1)], F.col("videos"))
    other = tracks.where((F.col("name") != "") & (F.col("name") != layout.track_name(F.col("kind"), F.col("index")))).join(counts.select("session", "videos"), "session")
    other = other.where(F.col("index") <= F.col("videos") + F.when(F.col("kind") == "audio", 1).otherwise(0))
    misnamed = _issue(other, "color_prep_track_name_mismatch", F.concat_ws("/", "kind", "index"))

    own = F.col("custom_data").startswith(prefix)
    frames = markers.where(own).select("session", F.expr(f"substring(custom_data, {len(prefix) + 1})").alias("take_id"), F.round("frame").cast("long").alias("frame"))
    masters = items.where((F.col("kind") == "audio") & (F.col("track") == 1) & (F.col("name") == MASTER_CLIP)).select("session", "start")
    rows = spread(_together(there, takes.select("session", F.col("take_id").cast("string").alias("take_id"), "pos"), frames, masters), "session", count=n)
    rows = rows.withColumn("there", F.max(_kind(0)).over(Window.partitionBy("session"))).where("there AND _kind > 0")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("session", "_kind").orderBy("pos", F.coalesce("start", F.lit(-1)))))
    place = Window.partitionBy("session", "i")
    rows = rows.withColumn("audio", F.max(_kind(3)).over(place)).withColumn("audio_start", F.max(_kind(3, "start")).over(place)).where("_kind < 3")
    rows = rows.withColumn("marker", F.max("frame").over(Window.partitionBy("session", "take_id"))).where("_kind = 1")
    own = _found(
        rows,
        [
            ("color_prep_take_marker_missing", F.col("marker").isNull()), ("color_prep_audio_item_missing", F.col("audio").isNull()),
            ("color_prep_audio_marker_mismatch", F.col("audio") & F.col("marker").isNotNull() & ~F.col("audio_start").eqNullSafe(F.col("marker"))),
        ],
        F.col("take_id"), F.col("take_id"),
    )

    shots = cameras if "pos" in cameras.columns else cameras.join(takes.select("session", "take_id", "pos"), ["session", "take_id"])
    track = lambda k: (F.col("track") - k).cast("long").alias("track")
    side = lambda kind: items.where(F.col("kind") == kind).select("session", track(int(kind == "audio")), "name", "start")
    tied = links.where((F.col("kind") == "video") & (F.col("to_kind") == "audio") & (F.col("to_track") == F.col("track") + 1) & F.col("name").isNotNull() & F.col("to_name").isNotNull())
    rows = spread(
        _together(
            there, shots.select("session", track(0), F.col("label").alias("name"), F.col("take_id").cast("string").alias("take_id"), "pos"), side("video"), side("audio").where("track > 0"),
            tied.select("session", track(0), "name", "start", F.when(F.col("to_name") != F.col("name"), F.col("to_name")).alias("to_name"), "to_start"),  # most are named alike
        ),
        "session", count=4 * n,
    )
    rows = rows.withColumn("there", F.max(_kind(0)).over(Window.partitionBy("session"))).where("there AND _kind > 0")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("session", "track", "_kind").orderBy("pos", F.coalesce("start", F.lit(-1)), "name")))
    place = Window.partitionBy("session", "track", "i")
    for k, x in ((2, "v"), (3, "s")):
        rows = rows.withColumn(x, F.max(_kind(k, F.struct("name", "start"))).over(place))
    seen = lambda x: F.coalesce(F.col(f"{x}.name") == F.col("name"), F.lit(False))
    both = seen("v") & seen("s")
    # a shot asks for what it has, a link tells what it ties; unknown starts tie nothing
    asked = lambda x, name, start: F.when(F.col("_kind") == 1, F.when(both, F.col(x))).otherwise(F.struct(name.alias("name"), F.col(start).alias("start"))).alias(f"_{x}")
    rows = rows.where("_kind IN (1, 4)").select("session", "track", "_kind", "take_id", "name", "v", "s", asked("v", F.col("name"), "start"), asked("s", F.coalesce("to_name", "name"), "to_start"))
    known = F.col("_v.start").isNotNull() & F.col("_s.start").isNotNull()
    rows = rows.withColumn("tied", F.when(known, F.max(_kind(4)).over(Window.partitionBy("session", "track", "_v", "_s")))).where("_kind = 1")
    placed = _found(
        rows,
        [
            ("color_prep_angle_item_missing", ~seen("v")), ("color_prep_scratch_audio_item_missing", ~seen("s")),
            ("color_prep_scratch_audio_start_mismatch", both & ~F.col("v.start").eqNullSafe(F.col("s.start"))), ("color_prep_video_scratch_unlinked", both & F.col("tied").isNull()),
        ],
        F.col("name"), F.col("take_id"),
    )
    return reduce(DataFrame.unionByName, (gone, late, few, misnamed, own, placed))


def sync_issues(offsets: DataFrame) -> DataFrame:
    """Issues of (session, take_id, label, confidence) rows that are too unsure."""
    return _issue(offsets.where(F.col("confidence") < SYNC_CONFIDENCE), "color_prep_sync_confidence_low", F.col("label"), F.col("take_id"))


def setting_code(key: Column, bootstrap: bool) -> Column:
    """What a setting's mismatch is called; after a bootstrap all but the playback rate are drift."""
    other = "resolve_setting_drift" if bootstrap else "resolve_color_management_mismatch"
    playback = F.when(key == "timelinePlaybackFrameRate", "timeline_playback_framerate_mismatch")
    return (playback if bootstrap else playback.when(key == "timelineFrameRate", "timeline_framerate_mismatch")).otherwise(other)


def _settings(expected: DataFrame, observed: DataFrame, bootstrap: bool) -> DataFrame:
    """expected and observed (session, key, value); a setting that was not observed differs."""
    rows = expected.join(observed.withColumnRenamed("value", "observed"), ["session", "key"], "left").where(~F.col("value").eqNullSafe(F.col("observed")))
    return _issue(rows, setting_code(F.col("key"), bootstrap), F.col("key"))


def _bins(expected: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, stale) of (session, name)."""
    a, b = expected.select("session", "name").distinct(), observed.select("session", "name").distinct()
    return a.join(b, ["session", "name"], "left_anti"), b.join(a, ["session", "name"], "left_anti")


def project_issues(projects: DataFrame, settings: tuple[DataFrame, DataFrame], bins: tuple[DataFrame, DataFrame], take_bins: DataFrame, clips: tuple[DataFrame, DataFrame]) -> DataFrame:
    """What differs between sessions and their projects, timelines aside.

    projects (session, exists, snapshot), settings (expected, observed) of (session, key,
    value), bins (expected, observed) of top-level (session, name), take_bins the observed
    (session, take_id), clips (expected, observed) of (session, take_id, name). A take whose
    bin is missing has that issue alone; else one names all its missing clips. A project
    that does not exist has no other issue but a missing snapshot.
    """
    there = projects.where("exists").select("session")
    within = lambda *tables: tuple(t.join(there, "session", "left_semi") for t in tables)
    missing, stale = _bins(*within(*bins))
    want, have = within(*clips)
    key = ["session", "take_id"]
    # wanted and seen names are grouped together, then by take: one row of each take tells all three issues
    names = want.select(*key, "name", F.lit(True).alias("_asked")).unionByName(have.select(*key, "name", F.lit(False).alias("_asked"))).groupBy(*key, "name").agg(F.bool_or("_asked").alias("_a"), F.bool_and("_asked").alias("_only"))
    listed = lambda holds: F.array_sort(F.collect_set(F.when(holds, F.col("name"))))
    per = names.groupBy(*key).agg(F.bool_or("_a").alias("_wanted"), listed(F.col("_only")).alias("_gone"), listed(~F.col("_a")).alias("_extra"))
    per = per.join(take_bins.select(*key).distinct().withColumn("_bin", F.lit(True)), key, "left").where("_wanted")
    told = lambda code, holds, subject: F.when(holds, F.struct(F.lit(code).alias("code"), subject.alias("subject")))
    bin_lost = F.col("_bin").isNull()
    takes = per.select(*key, F.explode(F.array_compact(F.array(
        told("take_bin_missing", bin_lost, F.col("take_id").cast("string")), told("take_clip_missing", ~bin_lost & (F.size("_gone") > 0), F.array_join("_gone", ", ")),
        told("take_extra_clip", F.size("_extra") > 0, F.array_join("_extra", ", ")),
    ))).alias("_x"))
    parts = (
        _issue(projects.where(~F.col("exists")), "resolve_project_missing", F.lit("project")), _issue(projects.where(~F.col("snapshot")), "project_snapshot_missing", F.lit("snapshot")),
        _settings(*within(*settings), False), _issue(missing, "resolve_bin_missing", F.col("name")), _issue(stale, "stale_top_level_bin", F.col("name")),
        _issue(takes, F.col("_x.code"), F.col("_x.subject"), F.col("take_id")),
    )
    return reduce(DataFrame.unionByName, parts)


def drift_issues(settings: tuple[DataFrame, DataFrame], bins: tuple[DataFrame, DataFrame], root_items: DataFrame, timelines: DataFrame, in_bin: DataFrame) -> DataFrame:
    """What a bootstrap finds changed: settings, bins and items (session, name) at the top, and timelines (session, name) outside their bin."""
    stray = timelines.select("session", "name").distinct().join(in_bin, ["session", "name"], "left_anti")
    parts = (
        _settings(*settings, True), _issue(_bins(*bins)[1], "stale_top_level_bin", F.col("name")), _issue(root_items, "stale_top_level_item", F.col("name")),
        _issue(stray, "stray_timeline", F.col("name")),
    )
    return reduce(DataFrame.unionByName, parts)


def still_issues(clips: DataFrame, files: DataFrame, rendered: DataFrame) -> DataFrame:
    """clips (session, take_id, label, path) without a file (path) or, where there is one, without a rendered still (session, take_id, label)."""
    clip = F.concat_ws("/", "take_id", "label")
    known = clips.join(files.select("path").distinct(), "path", "left_semi")
    lost = clips.join(files.select("path").distinct(), "path", "left_anti")
    failed = known.join(rendered, ["session", "take_id", "label"], "left_anti")
    return _issue(lost, "still_source_missing", clip, F.col("take_id")).unionByName(_issue(failed, "still_render_failed", clip, F.col("take_id")))


FRAME_RATE = 29.97


def still_frame(frames: Column, share: float = 0.5, seconds: Column | None = None, rate: Column | None = None) -> Column:
    """The index of a clip's frame: at a time, if there is one, else at a share of its length; inside the clip, and null without frames.

    A time takes the frame that it rounds to, halves to the even one; a rate that is
    unknown or 0 counts as FRAME_RATE.
    """
    last = frames - 1
    inside = lambda i: F.least(F.greatest(i, F.lit(0)), last)
    index = inside(F.floor(frames * share))
    if seconds is not None:
        known = F.coalesce(F.nullif(rate, F.lit(0.0)), F.lit(FRAME_RATE)) if rate is not None else F.lit(FRAME_RATE)
        index = F.when(seconds.isNotNull(), inside(F.rint(seconds * known).cast("long"))).otherwise(index)
        return F.when((frames > 0) & (known > 0), index)
    return F.when(frames > 0, index)


def matched_files(clips: DataFrame, files: DataFrame) -> DataFrame:
    """clips (.., path) with the columns of files (path, ..); a path that no file has is an error, raised where it is met."""
    rows = clips.join(files.withColumn("_met", F.lit(True)), "path", "left")
    checked = F.when(F.col("_met").isNull(), F.raise_error(F.concat(F.lit("no file for clip "), F.coalesce("path", F.lit("null"))))).otherwise(F.col("path"))
    return rows.withColumn("path", checked).drop("_met")


def clip_lookup(ids: DataFrame, cameras: DataFrame) -> DataFrame:
    """ids (clip_id, 'take/label') with (take_id, label, file) of cameras; the first file of equals, and ``found`` false where there is none."""
    parts = F.split("clip_id", "/", 2)
    first = cameras.groupBy("take_id", "label").agg(F.min("file").alias("file"))
    named = ids.withColumn("take_id", parts[0]).withColumn("label", F.get(parts, F.lit(1)))
    return named.join(first.withColumn("found", F.lit(True)), ["take_id", "label"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_named(rows: DataFrame, name: str, position: str, *keys: str) -> DataFrame:
    """For each name, by keys, the row that comes first."""
    order = Window.partitionBy(*keys, name).orderBy(position)
    return rows.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")


def moved_whole(expected: DataFrame, moved: DataFrame, *keys: str) -> DataFrame:
    """(*keys, whole): whether all (*keys, name) expected have been moved."""
    rows = expected.select(*keys, "name").distinct().join(moved.select(*keys, "name").distinct().withColumn("_met", F.lit(True)), [*keys, "name"], "left")
    return rows.groupBy(*keys).agg(F.bool_and(F.col("_met").isNotNull()).alias("whole"))


def issue_total(*stages: DataFrame) -> DataFrame:
    """(session, issues): issues of all stages together."""
    return reduce(DataFrame.unionByName, (s.select("session") for s in stages)).groupBy("session").agg(F.count(F.lit(1)).alias("issues"))


def reload_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session, take_id, code, subject, severity, change, issues): issues of two inspections, told apart by what they are.

    change is new, gone or same; the severity is that of the later inspection, of what is
    gone that of the earlier; issues counts those of one identity, which may be found more
    than once, in the inspection that the severity comes from.
    """
    key = ["session", "take_id", "code", "subject"]
    rows = before.select(*key, "severity", F.lit(0).alias("later")).unionByName(after.select(*key, "severity", F.lit(1).alias("later")))
    rank = F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    told = rows.groupBy(*key).agg(*(f(F.when(F.col("later") == k, x)).alias(f"{n}{k}") for k in (0, 1) for n, f, x in (("n", F.count, F.lit(1)), ("rank", F.max, rank))))
    later = F.col("n1") > 0
    severity = F.element_at(F.array(*(F.lit(x) for x in ("info", "warn", "fail"))), F.when(later, F.col("rank1")).otherwise(F.col("rank0")) + 1)
    change = F.when(~later, "gone").when(F.col("n0") == 0, "new").otherwise("same")
    return told.select(*key, severity.alias("severity"), change.alias("change"), F.when(later, F.col("n1")).otherwise(F.col("n0")).alias("issues"))


def reload_status(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """(session, reloaded, status, new, gone, same) of (session, reloaded): a session that did not load again fails, whatever was found before; else its later issues decide."""
    rank = F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    count = lambda c: F.coalesce(F.sum(F.when(F.col("change") == c, F.col("issues"))), F.lit(0)).alias(c)
    per = changes.groupBy("session").agg(F.max(F.when(F.col("change") != "gone", rank)).alias("rank"), *(count(c) for c in ("new", "gone", "same")))
    rows = sessions.join(per, "session", "left")
    worst = F.when(~F.col("reloaded"), 2).otherwise(F.coalesce("rank", F.lit(0)))
    return rows.select("session", "reloaded", S.status(worst).alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("new", "gone", "same")))

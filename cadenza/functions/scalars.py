"""Scalar rules of the domain as Column expressions; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of takes, scores and durations.
MIN_TAKE_SCORE, MIN_TAKE_VIDEOS, MAX_TAKE_VIDEOS = 0.60, 1, 8
MIN_LANE_SCORE, NULL_SCORE = 0.56, 0.40
MAX_GAP_SECONDS, EARLY_SECONDS, LATE_SECONDS = 240.0, 45.0, 75.0
EDIT_RATE, EDIT_BITS, EDIT_TOLERANCE = 48_000, 24, 8
LOW_CONFIDENCE = 0.72
SEVERITIES = ("info", "warn", "fail")


def group_label(i: Column) -> Column:
    """angle-a to angle-z, then angle-aa on; two letters at most."""
    one = F.char(i % 26 + 97)
    return F.concat(F.lit("angle-"), F.when(i < 26, one).otherwise(F.concat(F.char(F.floor(i / 26) + 96), one)))


def date_and_title(name: Column, today: Column) -> tuple[Column, Column]:
    """The date that a folder name begins or else ends with, as text, and the rest; else today and the name."""
    compact = r"(?s)^([0-9]{8})(.*)$"
    dashed = r"(?s)^([0-9]{4}-[0-9]{2}-[0-9]{2})(.*)$"
    end_compact = r"(?s)^(.*?)[\s_-]?([0-9]{8})$"
    end_dashed = r"(?s)^(.*?)[\s_-]?([0-9]{4}-[0-9]{2}-[0-9]{2})$"

    def pick(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
        return F.when(name.rlike(compact), a).when(name.rlike(dashed), b).when(name.rlike(end_compact), c).when(name.rlike(end_dashed), d).otherwise(e)

    get = lambda pattern, k: F.regexp_extract(name, pattern, k)
    dash = lambda d: F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
    date = pick(dash(get(compact, 1)), get(dashed, 1), dash(get(end_compact, 2)), get(end_dashed, 2), today)
    title = pick(get(compact, 2), get(dashed, 2), get(end_compact, 1), get(end_dashed, 1), name)
    return date, F.coalesce(F.nullif(F.btrim(title, F.lit(" -_")), F.lit("")), name)


def project_name(folder: Column, default: str = "recording-session") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(folder), "[/:]+", "_"), F.lit("")), F.lit(default))


def session_root(path: Column) -> Column:
    """The folder above ``takes``, if the path's parent is that; else null."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/takes/[^/]+/?$", 1), F.lit(""))


def frame_rate(raw: Column) -> Column:
    """``n/d`` or a number; empty, 0/0 and a zero divisor give 0."""
    parts = F.split(raw, "/", 2)
    ratio = F.try_divide(parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    return F.coalesce(F.when(F.coalesce(raw, F.lit("")).isin("", "0/0"), F.lit(0.0)).when(raw.contains("/"), ratio).otherwise(raw.try_cast("double")), F.lit(0.0))


def clip_frames(frames: Column, duration: Column, rate: Column) -> Column:
    """Frames if given; else those of a timecode H:M:S:F or of seconds; null where nothing fits."""
    text = F.trim(duration)
    parts = F.split(F.replace(text, F.lit(";"), F.lit(":")), ":")
    n = [parts[i].try_cast("int") for i in range(3)]
    code = F.when(F.size(parts) == 4, F.rint((n[0] * 3600 + n[1] * 60 + n[2]) * rate) + F.get(parts, F.lit(3)).try_cast("int"))
    given = frames.try_cast("double")
    return F.greatest(F.lit(1), F.when(given.isNotNull(), given.cast("long")).otherwise(F.coalesce(code, F.rint(text.try_cast("double") * rate)).cast("long")))


def bit_depth(bits: Column, raw_bits: Column, pix_fmt: Column) -> Column:
    """The first given of two counts (0 is none), else the digits that end a pixel format, else 8 for one that ends in p, else 0."""
    count = lambda c: F.nullif(c.try_cast("int"), F.lit(0))
    digits = F.regexp_extract(pix_fmt, r"([0-9]+)(?:le|be)?$", 1).try_cast("int")
    return F.coalesce(count(bits), count(raw_bits), digits, F.when(pix_fmt.endswith("p"), 8).otherwise(0))


def sample_count(duration_ts: Column, time_base: Column, rate: Column, seconds: Column) -> Column:
    exact = duration_ts * frame_rate(time_base) * rate
    return F.rint(F.when((duration_ts > 0) & (frame_rate(time_base) > 0), exact).otherwise(seconds * rate)).cast("long")


def variable_rate(average: Column, nominal: Column, tolerance: Column | float = 0.01) -> Column:
    return F.abs(average - nominal) > tolerance


def triple(raw: Column) -> Column:
    """Three numbers; an error for anything else."""
    parts = F.transform(F.split(raw, ","), lambda x: F.trim(x).cast("double"))
    return F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("three values are needed, not "), raw)).cast("array<double>"))


def is_production_take(videos: Column, confidence: Column) -> Column:
    """The count is asked first: a take without videos has no confidence."""
    return F.coalesce(videos.between(MIN_TAKE_VIDEOS, MAX_TAKE_VIDEOS) & (confidence >= MIN_TAKE_SCORE), F.lit(False))


def duration_score(audio: Column, video: Column) -> tuple[Column, Column]:
    """(score, absolute gap) of two lengths in seconds."""
    delta = audio - video
    gap = F.abs(delta)
    overflow = F.when(delta > LATE_SECONDS, delta - LATE_SECONDS).otherwise(gap - EARLY_SECONDS)
    score = (
        F.when(gap > MAX_GAP_SECONDS, 0.0)
        .when(delta.between(-EARLY_SECONDS, LATE_SECONDS), 1 - F.least(gap / 120, F.lit(0.35)))
        .otherwise(F.greatest(F.lit(0.0), 0.65 - overflow / 120))
    )
    return score, gap


def pair_score(duration: Column, waveform: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * duration + 0.35 * waveform))


def order_confidence(evidence: Column) -> Column:
    return F.when(evidence >= 3, "high").when(evidence == 2, "medium").when(evidence == 1, "low").otherwise("none")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "fail", 2).when(severity == "warn", 1).otherwise(0)


def status(rank: Column) -> Column:
    """PASS, WARN or FAIL of the greatest severity rank; null, no issues, passes."""
    return F.when(rank >= 2, "FAIL").when(rank == 1, "WARN").otherwise("PASS")


def markdown_value(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path_name(path), r"^(.+?)(?:\.[^.]*)?$", 1)


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path_name(path), r"^.+(\.[^.]+)$", 1))


def path_parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_pcm(codec: Column) -> Column:
    return F.coalesce(codec.startswith("pcm_"), F.lit(False))


def needs_edit_proxy(rate: Column, codec: Column, bits: Column) -> Column:
    return ~((rate == EDIT_RATE) & is_pcm(codec) & (bits == EDIT_BITS))


def expected_edit_samples(samples: Column, rate: Column, seconds: Column) -> Column:
    return F.rint(F.when((samples > 0) & (rate > 0), samples * EDIT_RATE / rate).otherwise(seconds * EDIT_RATE)).cast("long")


def edit_audio_action(needed: Column, exists: Column, valid: Column, dry_run: bool) -> Column:
    make = lambda action: F.lit("would-generate" if dry_run else action)
    return F.when(~needed, "reuse-source").when(~exists, make("generate")).when(valid, "reuse-existing").otherwise(make("regenerate"))


def library_record(name: Column, path: Column, kind: Column | None = None) -> Column:
    return F.concat_ws(":", name, path, F.lit("*"), F.lit(""), F.lit(""), F.lit("DISK") if kind is None else kind)


# Folders below a storage root.
STORAGE_FOLDERS = {"cache": "CacheClip", "gallery": ".gallery", "project_backups": "Resolve Project Backups"}


def storage_folders(root: Column) -> Column:
    """The folders that a storage root holds, by what they are for."""
    base = F.regexp_replace(root, "/+$", "")
    return F.create_map(*(x for use, name in STORAGE_FOLDERS.items() for x in (F.lit(use), F.concat_ws("/", base, F.lit(name)))))


def take_name(position: Column) -> Column:
    return F.format_string("take-%02d", position)


def low_confidence_note(confidence: Column) -> Column:
    return F.when(confidence < LOW_CONFIDENCE, "take confidence is low for a production take")

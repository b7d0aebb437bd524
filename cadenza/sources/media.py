"""Catalogues of media files, probe records, configuration documents and text records."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators import signal
from cadenza.operators.signal import SAMPLE_RATE
from cadenza.schemas import PROBE
from cadenza.sources import sound

# What counts as audio and video, and the names that a master audio goes by.
AUDIO_SUFFIXES = (".wav", ".aiff", ".aif", ".flac")
VIDEO_SUFFIXES = (".mp4", ".mov", ".mxf", ".mts")
MASTER_NAMES = ("audio.wav", "audio.aiff", "audio.aif")
PROBE_FIELDS = PROBE


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, suffix, length, mtime) of a folder's files, hidden ones left out; contents are never read.

    Spark's listing leaves out empty files and names that begin with an underscore; where
    those matter, list_folder names them.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.unix_micros("modificationTime").alias("us"))
    name = S.path_name(F.col("path"))
    return files.where(~name.startswith(".")).select("path", name.alias("name"), S.path_suffix(F.col("path")).alias("suffix"), "length", (F.col("us") / 1e6).alias("mtime"))


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The same columns for one folder of a mounted drive, with empty files: a folder of one session, listed where the driver sees it."""
    rows = [(e.path, e.name, os.path.splitext(e.name)[1].lower(), e.stat().st_size, e.stat().st_mtime) for e in os.scandir(folder) if e.is_file() and not e.name.startswith(".")]
    return spark.createDataFrame(sorted(rows), "path string, name string, suffix string, length long, mtime double")


def audio_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(*AUDIO_SUFFIXES))


def video_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(*VIDEO_SUFFIXES))


def incoming_folder(root: str, given: str | None = None) -> str:
    """The folder given, or exactly ``incoming``; an error where it is not there."""
    path = os.path.join(root, given or "incoming")
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return path


def masters(files: DataFrame) -> DataFrame:
    """(take_id, master_audio) from (take_id, name, suffix, length): a file by a master's name, the first of them, else the largest."""
    preferred = F.lower("name").isin(*MASTER_NAMES)
    order = Window.partitionBy("take_id").orderBy(preferred.desc(), F.when(preferred, F.col("name")), F.desc("length"), "name")
    return audio_files(files).withColumn("i", F.row_number().over(order)).where("i = 1").select("take_id", F.col("name").alias("master_audio"))


def cameras(files: DataFrame) -> DataFrame:
    """(take_id, pos, file, label): a take's videos in the order of their names, labelled by their stems."""
    pos = F.row_number().over(Window.partitionBy("take_id").orderBy("name"))
    return video_files(files).select("take_id", pos.alias("pos"), F.col("name").alias("file"), S.path_stem(F.col("name")).alias("label"))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe documents, one JSON document a file."""
    return spark.read.schema(PROBE).option("multiLine", True).json(path)


def first_stream(kind: str) -> Column:
    return F.get(F.filter("streams", lambda s: s["codec_type"] == kind), F.lit(0))


def video_clips(probed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """VIDEO_CLIP's columns, without take and label, for probes that have a video stream."""
    v, a = first_stream("video"), first_stream("audio")
    rows = probed.select(F.col("format.filename").alias("file"), F.col("format.duration").cast("double").alias("duration_seconds"), v.alias("v"), a.alias("a")).where("v is not null")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    average = F.coalesce(blank("v.avg_frame_rate"), blank("v.r_frame_rate"), F.lit(""))
    rows = rows.withColumn("frame_rate", S.frame_rate(average)).withColumn("nominal_frame_rate", S.frame_rate(F.coalesce(blank("v.r_frame_rate"), average)))
    return rows.select(
        "file", "duration_seconds", F.coalesce("v.width", F.lit(0)).alias("width"), F.coalesce("v.height", F.lit(0)).alias("height"), "frame_rate", "nominal_frame_rate",
        S.variable_rate(F.col("frame_rate"), F.col("nominal_frame_rate"), tolerance).alias("variable_frame_rate"),
        S.bit_depth(F.col("v.bits_per_sample"), F.col("v.bits_per_raw_sample"), F.coalesce("v.pix_fmt", F.lit(""))).alias("bit_depth"), F.col("a").isNotNull().alias("scratch_audio_present"),
        *(F.coalesce(f"v.{c}", F.lit("")).alias(c) for c in ("color_space", "color_transfer", "color_primaries")),
    )


def audio_clips(probed: DataFrame) -> DataFrame:
    """AUDIO_CLIP's columns, without take, for probes that have an audio stream."""
    rows = probed.select(F.col("format.filename").alias("file"), F.col("format.duration").cast("double").alias("duration_seconds"), first_stream("audio").alias("a")).where("a is not null")
    rate = F.coalesce(F.col("a.sample_rate").try_cast("int"), F.lit(0))
    return rows.select(
        "file", "duration_seconds", rate.alias("sample_rate"), F.coalesce("a.channels", F.lit(0)).alias("channels"), F.coalesce("a.codec_name", F.lit("")).alias("codec_name"),
        S.bit_depth(F.col("a.bits_per_sample"), F.col("a.bits_per_raw_sample"), F.lit("")).alias("bits_per_sample"),
        S.sample_count(F.col("a.duration_ts"), F.col("a.time_base"), rate, F.col("duration_seconds")).alias("sample_count"), S.is_pcm(F.col("a.codec_name")).alias("is_pcm"),
    )


def key_values(lines: DataFrame) -> DataFrame:
    """(key, value) of lines ``key = value`` in column value; blank lines, // comments and others are left out."""
    text = F.trim("value")
    parts = F.split(text, "=", 2)
    return lines.where((text != "") & ~text.startswith("//") & text.contains("=")).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def records(lines: DataFrame) -> DataFrame:
    """(name, path, kind) of colon-separated lines of three parts at least; # begins a comment, the last part is the kind."""
    text = F.trim("value")
    parts = F.split(text, ":")
    return lines.where(~text.startswith("#") & (F.size(parts) >= 3)).select(parts[0].alias("name"), parts[1].alias("path"), F.element_at(parts, -1).alias("kind"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, document) of YAML documents, one a file, as structs of a schema; fields that are missing are null."""

    @F.pandas_udf("string")
    def as_json(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json.dumps(yaml.safe_load(t) or {}, default=str))

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), as_json("value").alias("json"))
    return rows.select("path", F.from_json("json", schema).alias("document"))


def pcm_samples(files: DataFrame, raw_rate: int = SAMPLE_RATE) -> DataFrame:
    """(series, idx, v) of the sound in (path, content) at SAMPLE_RATE, a row for each sample: for short files; ``signatures`` needs no such rows."""

    @F.pandas_udf("array<float>")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: sound.resampled(sound.opened(b, raw_rate), SAMPLE_RATE))

    return files.select(F.col("path").alias("series"), F.posexplode(decode("content")).alias("idx", "v"))


def signatures(files: DataFrame, trim: bool = True, raw_rate: int = SAMPLE_RATE) -> DataFrame:
    """(path, sample_rate, channels, seconds, signature) of the sound in (path, content); signature is the z-scored logarithmic envelope, of the trimmed sound or of all.

    A file is decoded, resampled and reduced where it is read; no sample leaves the task. One
    file's samples at SAMPLE_RATE must fit it, 160 MB an hour.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = sound.opened(batch.column(1)[i].as_py() or b"", raw_rate)
                found = signal.signature_array(sound.resampled(own, SAMPLE_RATE), trim)
                columns = [batch.column(0).slice(i, 1), pa.array([own.rate], pa.int32()), pa.array([own.channels], pa.int32()), pa.array([len(own) / own.rate]), pa.array([found.astype(np.float32)], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "sample_rate", "channels", "seconds", "signature"])

    return files.select("path", "content").mapInArrow(run, "path string, sample_rate int, channels int, seconds double, signature array<float>")

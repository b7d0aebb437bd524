"""Sessions and their takes, found in folders and configuration documents; many sessions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.sources import media

PLAN = (
    "piece_root string, incoming_dir string, generated_at string, status string, angles array<string>, "
    "takes array<struct<take_id:string,audio_source:string,audio_target:string,confidence:double,notes:array<string>,"
    "videos:array<struct<source:string,target:string,angle:string,lane_id:string,pair_score:double,waveform_score:double,duration_score:double,duration_delta_seconds:double,estimated_offset_seconds:double,visual_score:double>>>>, "
    "excluded_media array<struct<source:string,media_type:string,reason:string,confidence:double>>, unresolved_media array<struct<source:string,media_type:string,reason:string,confidence:double>>, "
    "issues array<struct<severity:string,code:string,message:string>>"
)
PROJECT_SUFFIX = ".logicx"


def document_path(path: Column, name: str) -> Column:
    """The path of a document: a folder's is the file of that name in it."""
    return F.when(S.path_suffix(path).isin(".yaml", ".yml", ".json"), path).otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit(f"/{name}")))


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """rows with what is null in them set to defaults; names like ``timeline.width`` are fields of structs, which may be null themselves."""
    for name, value in defaults.items():
        head, _, field = name.partition(".")
        if field:
            fields = [f.name for f in rows.schema[head].dataType]
            whole = F.struct(*((F.coalesce(F.col(f"{head}.{f}"), F.lit(value)) if f == field else F.col(f"{head}.{f}")).alias(f) for f in fields))
            rows = rows.withColumn(head, whole)
        else:
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return rows


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    """Grouping plans, one JSON document a file; a document without takes fails the load, as no plan has none."""
    rows = spark.read.schema(PLAN).option("multiLine", True).json(path)
    return rows.withColumn("takes", F.coalesce("takes", F.raise_error(F.lit("no grouping plan: a document without takes"))))


def audio_assets(files: DataFrame, probed: DataFrame) -> DataFrame:
    """audio files (session, path, ..) in the order of their paths, with length and format of their probes (format.filename their path)."""
    return media.audio_files(files).join(media.audio_clips(probed).withColumnRenamed("file", "path"), "path", "left").orderBy("path")


def video_assets(files: DataFrame, probed: DataFrame) -> DataFrame:
    """video files likewise, with whether they have any sound."""
    return media.video_files(files).join(media.video_clips(probed).withColumnRenamed("file", "path"), "path", "left").orderBy("path")


def project_files(entries: DataFrame) -> DataFrame:
    """(session, project_file) from entries (session, folder, name, resolved) of a session's root and its project folder; more than one project is an error."""
    found = entries.where(F.lower("name").endswith(PROJECT_SUFFIX)).groupBy("session").agg(F.countDistinct("resolved").alias("n"), F.min("resolved").alias("project_file"))
    several = F.raise_error(F.concat(F.lit("several projects in "), F.col("session").cast("string")))
    return found.select("session", F.when(F.col("n") > 1, several).otherwise(F.col("project_file")).alias("project_file"))


def discovered_takes(files: DataFrame) -> DataFrame:
    """(session, take_id, master_audio, cameras) from files (session, take_id, name, suffix, length) of take folders.

    Hidden folders are left out. A take without audio or without video is an error.
    """
    key = F.struct("session", "take_id")
    own = files.where(~F.col("take_id").startswith(".")).select(key.alias("take_id"), "name", "suffix", "length")
    shots = media.cameras(own).groupBy("take_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "file", "label"))), lambda c: F.struct(c["file"].alias("file"), c["label"].alias("label"))).alias("cameras"))
    rows = own.select("take_id").distinct().join(media.masters(own), "take_id", "left").join(shots, "take_id", "left")
    lacking = lambda c, what: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"no {what} file in "), F.col("take_id.take_id"))))
    return rows.select("take_id.session", "take_id.take_id", lacking("master_audio", "audio").alias("master_audio"), lacking("cameras", "video").alias("cameras"))


def initialized(sessions: DataFrame, files: DataFrame, known: DataFrame, colors: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(sessions, takes) as a run writes them.

    sessions (session, root, title, project_name, colour spaces; null where unknown), files
    of take folders, known (session, take_id, master_audio, cameras) takes that have a
    document. Titles, dates and project names come from the root's name where they are not
    known; colour spaces are always set to ``colors``. Takes that have a document keep it;
    the others are discovered. A session without takes is an error.
    """
    date, title = S.date_and_title(S.path_name(F.col("root")), S.path_name(F.col("root")))
    own = sessions.withColumn("date", date).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), title))
    own = own.withColumn("project_name", F.coalesce(F.nullif("project_name", F.lit("")), S.project_name(S.path_name(F.col("root")))))
    own = own.withColumns({c: F.lit(v) for c, v in colors.items()})
    fresh = files.join(known, ["session", "take_id"], "left_anti")
    takes = known.select("session", "take_id", "master_audio", "cameras").unionByName(discovered_takes(fresh))
    refs = takes.groupBy("session").agg(F.sort_array(F.collect_list("take_id")).alias("takes"))
    none = F.raise_error(F.concat(F.lit("no takes in "), F.col("root")))
    return own.join(refs, "session", "left").withColumn("takes", F.coalesce("takes", none)), takes.join(own.select("session", "date", "project_name", *colors), "session")


def session_takes(sessions: DataFrame, takes: DataFrame) -> DataFrame:
    """(session, pos, take columns): sessions' takes in the order in which ``takes`` (array of take_id) names them; one without a document is an error."""
    refs = sessions.select("session", F.posexplode("takes").alias("pos", "take_id"))
    rows = refs.join(takes.withColumn("_met", F.lit(True)), ["session", "take_id"], "left")
    checked = F.when(F.col("_met").isNull(), F.raise_error(F.concat(F.lit("no document of take "), F.col("take_id")))).otherwise(F.col("pos"))
    return rows.withColumn("pos", checked).drop("_met")

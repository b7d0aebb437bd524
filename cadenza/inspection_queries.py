"""Catalogue entries of inspections and plans; customers are sessions, orders takes, line items cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators import coverage, inspection, layout, order, rules
from cadenza.plans import grouping
from cadenza.queries import _EVIDENCE_SQL, _INGEST_SQL, _evidence, _ingest, query, table
from cadenza.storage import spread, written

_LABEL = "concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice) AS bigint))"
_TAKES_SQL = "takes AS (SELECT o_custkey AS session, o_orderkey::VARCHAR AS take_id, o_orderkey AS pos, o_orderstatus, o_orderpriority, o_totalprice FROM orders)"
_CAMERAS_SQL = f"""{_TAKES_SQL},
cameras AS (SELECT session, take_id, pos AS num, {_LABEL} AS label, l_linenumber, l_quantity, l_discount, l_tax, l_linestatus, l_returnflag FROM lineitem JOIN takes ON pos = l_orderkey),
tracked AS (SELECT *, row_number() OVER (PARTITION BY session, take_id ORDER BY CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END, label) AS track FROM cameras)"""


def _takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").cast("string").alias("take_id"), F.col("o_orderkey").alias("pos"), "o_orderstatus", "o_orderpriority", "o_totalprice")


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("label", F.expr(_LABEL))
    takes = _takes(spark, sf_dir).select("session", "take_id", F.col("pos").alias("at"), "o_orderstatus", "o_totalprice")
    return items.join(takes, F.col("l_orderkey") == F.col("at")).select("session", "take_id", "at", "label", F.col("label").alias("file"), "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag", "o_orderstatus", "o_totalprice")


@query(f"""WITH {_CAMERAS_SQL},
lines AS (SELECT c_custkey AS session, c_acctbal > -500 AS there, CASE c_nationkey % 5 WHEN 0 THEN '01:00:00:00' WHEN 1 THEN NULL ELSE '00:00:00;00' END AS code FROM customer),
live AS (SELECT session FROM lines WHERE there),
n AS (SELECT live.session, coalesce(max(track), 0) AS n FROM live LEFT JOIN tracked USING (session) GROUP BY 1),
named AS (SELECT session, 'video' AS kind, i AS index, 'compact-v' || i AS name, n FROM n, unnest(range(1, n + 1)) AS t(i)
  UNION ALL SELECT session, 'audio', 1, 'master-audio', n FROM n UNION ALL SELECT session, 'audio', i + 1, 'scratch-compact-v' || i, n FROM n, unnest(range(1, n + 1)) AS t(i)),
seen AS (SELECT session, kind, index, CASE WHEN session % 4 = 1 AND kind = 'audio' AND index = 1 THEN 'A1' WHEN session % 4 = 2 AND index = 2 THEN '' ELSE name END AS name FROM named
  WHERE NOT (session % 4 = 0 AND kind = 'video' AND index = n) AND NOT (session % 8 = 3 AND kind = 'audio' AND index = 1)),
have AS (SELECT session, count(*) FILTER (kind = 'video') AS v, count(*) FILTER (kind = 'audio') AS a FROM seen GROUP BY 1),
counts AS (SELECT session, n, coalesce(v, 0) AS v, coalesce(a, 0) AS a FROM n LEFT JOIN have USING (session)),
video AS (SELECT session, track, CASE WHEN l_discount > 0.095 THEN 'other' ELSE label END AS name, CASE WHEN l_tax > 0.075 THEN NULL ELSE num * 10 END AS start FROM tracked WHERE l_quantity > 3),
scratch AS (SELECT session, track, label AS name, num * 10 + (l_discount > 0.085)::INT AS start FROM tracked WHERE l_quantity > 5),
master AS (SELECT session, pos * 10 + (o_orderpriority = '5-LOW')::INT AS start, row_number() OVER (PARTITION BY session ORDER BY pos * 10 + (o_orderpriority = '5-LOW')::INT) AS i FROM takes WHERE o_orderstatus <> 'P'),
vi AS (SELECT *, row_number() OVER (PARTITION BY session, track ORDER BY coalesce(start, -1), name) AS i FROM video),
si AS (SELECT *, row_number() OVER (PARTITION BY session, track ORDER BY coalesce(start, -1), name) AS i FROM scratch),
links AS (SELECT DISTINCT session, track, label, num * 10 AS vs, num * 10 + (l_discount > 0.085)::INT AS ss FROM tracked WHERE l_linestatus = 'O'),
shots AS (SELECT *, row_number() OVER (PARTITION BY session, track ORDER BY num) AS i FROM tracked JOIN live USING (session)),
placed AS (SELECT s.session, s.take_id, s.label, coalesce(v.name = s.label, false) AS sv, coalesce(c.name = s.label, false) AS sc, v.start AS vs, c.start AS cs, l.label IS NOT NULL AS tied
  FROM shots s LEFT JOIN vi v USING (session, track, i) LEFT JOIN si c USING (session, track, i) LEFT JOIN links l ON l.session = s.session AND l.track = s.track AND l.label = v.name AND l.label = c.name AND l.vs = v.start AND l.ss = c.start),
own AS (SELECT t.session, t.take_id, t.o_totalprice > 50000 AS marked, t.pos * 10 AS marker, row_number() OVER (PARTITION BY t.session ORDER BY t.pos) AS i FROM takes t JOIN live USING (session)),
heard AS (SELECT own.*, m.i IS NOT NULL AS audio, m.start FROM own LEFT JOIN master m USING (session, i))
SELECT session, NULL::VARCHAR AS take_id, 'color_prep_timeline_missing' AS code, 'timeline' AS subject, 'fail' AS severity FROM lines WHERE NOT there
UNION ALL SELECT session, NULL, 'color_prep_start_timecode_mismatch', code, 'fail' FROM lines WHERE there AND code <> '00:00:00;00'
UNION ALL SELECT session, NULL, 'color_prep_video_tracks_missing', n::VARCHAR, 'fail' FROM counts WHERE v < n
UNION ALL SELECT session, NULL, 'color_prep_audio_track_missing', n::VARCHAR, 'fail' FROM counts WHERE a < n + 1
UNION ALL SELECT session, NULL, 'color_prep_track_name_mismatch', kind || '/' || index, 'warn' FROM named JOIN seen s USING (session, kind, index) WHERE s.name <> '' AND s.name <> named.name
UNION ALL SELECT session, take_id, 'color_prep_take_marker_missing', take_id, 'fail' FROM heard WHERE NOT marked
UNION ALL SELECT session, take_id, 'color_prep_audio_item_missing', take_id, 'fail' FROM heard WHERE NOT audio
UNION ALL SELECT session, take_id, 'color_prep_audio_marker_mismatch', take_id, 'fail' FROM heard WHERE audio AND marked AND start <> marker
UNION ALL SELECT session, take_id, 'color_prep_angle_item_missing', label, 'fail' FROM placed WHERE NOT sv
UNION ALL SELECT session, take_id, 'color_prep_scratch_audio_item_missing', label, 'fail' FROM placed WHERE NOT sc
UNION ALL SELECT session, take_id, 'color_prep_scratch_audio_start_mismatch', label, 'fail' FROM placed WHERE sv AND sc AND vs IS DISTINCT FROM cs
UNION ALL SELECT session, take_id, 'color_prep_video_scratch_unlinked', label, 'fail' FROM placed WHERE sv AND sc AND NOT tied""")
def timeline_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = _takes(spark, sf_dir)
    flags = {"shown": "l_quantity > 3", "heard": "l_quantity > 5", "other": "l_discount > 0.095", "late": "l_discount > 0.085", "unknown": "l_tax > 0.075", "linked": "l_linestatus = 'O'"}
    cameras = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        "l_orderkey", F.expr(_LABEL).alias("label"), F.expr("CASE WHEN l_linenumber = 1 THEN 0 END").alias("pos"), *(F.expr(x).alias(c) for c, x in flags.items())
    ).join(takes.select("session", F.col("pos").alias("at")), F.col("l_orderkey") == F.col("at")).withColumn("file", F.col("label"))
    # the take's key in front: its rows have met by it
    cameras = written(inspection.expected_tracks(cameras, keys=("at", "session")).select("session", "at", "label", "track", *flags))  # read six times
    timelines = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("session"), (F.col("c_acctbal") > -500).alias("exists"), F.expr("CASE c_nationkey % 5 WHEN 0 THEN '01:00:00:00' WHEN 1 THEN NULL ELSE '00:00:00;00' END").alias("start_timecode")
    )
    n = timelines.select("session").join(cameras.groupBy("session").agg(F.max("track").alias("n")), "session", "left").fillna(0, ["n"])
    named = layout.track_names(n.where("n > 0").withColumn("tracks", F.col("n").cast("int"))).unionByName(n.where("n = 0").select("session", "n", F.lit("audio").alias("kind"), F.lit(1).alias("index"), F.lit("master-audio").alias("name")))
    tracks = named.where("NOT (session % 4 = 0 AND kind = 'video' AND index = n) AND NOT (session % 8 = 3 AND kind = 'audio' AND index = 1)").select(
        "session", "kind", "index", F.expr("CASE WHEN session % 4 = 1 AND kind = 'audio' AND index = 1 THEN 'A1' WHEN session % 4 = 2 AND index = 2 THEN '' ELSE name END").alias("name")
    )
    late = F.col("late").cast("int")
    item = lambda rows, kind, track, name, start: rows.select("session", F.lit(kind).alias("kind"), track.cast("int").alias("track"), name.alias("name"), start.cast("long").alias("start"))
    video = item(cameras.where("shown"), "video", F.col("track"), F.when(F.col("other"), "other").otherwise(F.col("label")), F.when(~F.col("unknown"), F.col("at") * 10))
    scratch = item(cameras.where("heard"), "audio", F.col("track") + 1, F.col("label"), F.col("at") * 10 + late)
    master = item(takes.where("o_orderstatus <> 'P'"), "audio", F.lit(1), F.lit("audio-master"), F.col("pos") * 10 + (F.col("o_orderpriority") == "5-LOW").cast("int"))
    noise = item(takes.where("o_orderpriority = '1-URGENT'"), "audio", F.lit(1), F.lit("noise"), F.col("pos"))
    links = cameras.where("linked").select(
        "session", F.col("label").alias("name"), (F.col("at") * 10).alias("start"), F.lit("video").alias("kind"), "track", F.col("label").alias("to_name"), (F.col("at") * 10 + late).alias("to_start"),
        F.lit("audio").alias("to_kind"), (F.col("track") + 1).alias("to_track"),
    )
    markers = takes.where("o_totalprice > 50000").select("session", (F.col("pos") * 10.0).alias("frame"), F.concat(F.lit("take:"), "take_id").alias("custom_data"))
    items = video.unionByName(scratch).unionByName(master).unionByName(noise)
    return inspection.timeline_issues(timelines, takes.select("session", "take_id", "pos"), cameras.select("session", F.col("at").alias("take_id"), "label", "track", F.col("at").alias("pos")), tracks, items, links, markers)


_SNAPSHOT_SQL = """
wanted(key, value) AS (VALUES ('timelineFrameRate', '29.97'), ('timelinePlaybackFrameRate', '29.97'), ('colorSpaceTimeline', 'Rec.709')),
live AS (SELECT c_custkey AS session FROM customer WHERE c_nationkey <> 3),
have AS (SELECT c_custkey AS session, 'timelineFrameRate' AS key, CASE WHEN c_nationkey % 3 = 0 THEN '25' ELSE '29.97' END AS value FROM customer
  UNION ALL SELECT c_custkey, 'timelinePlaybackFrameRate', '29.97' FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'colorSpaceTimeline', CASE WHEN c_mktsegment = 'BUILDING' THEN 'Rec.709' ELSE 'HLG' END FROM customer),
differ AS (SELECT c_custkey AS session, w.key FROM customer CROSS JOIN wanted w LEFT JOIN have h ON h.session = c_custkey AND h.key = w.key WHERE w.value IS DISTINCT FROM h.value),
bins AS (SELECT c_custkey AS session, 'Takes' AS name FROM customer WHERE c_custkey % 6 <> 0 UNION ALL SELECT c_custkey, 'Timelines' FROM customer UNION ALL SELECT c_custkey, 'Old' FROM customer WHERE c_acctbal < 0)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame], DataFrame]:
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "session")
    pairs = lambda *kv: F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kv))).alias("x")
    rate = F.lit("29.97")
    want = customers.select("session", pairs(("timelineFrameRate", rate), ("timelinePlaybackFrameRate", rate), ("colorSpaceTimeline", F.lit("Rec.709")))).select("session", "x.*")
    have = customers.select(
        "session", pairs(("timelineFrameRate", F.when(F.col("c_nationkey") % 3 == 0, "25").otherwise(rate)), ("timelinePlaybackFrameRate", F.when(F.col("session") % 5 != 0, rate)), ("colorSpaceTimeline", F.when(F.col("c_mktsegment") == "BUILDING", "Rec.709").otherwise("HLG"))),
    ).select("session", "x.*").where("value is not null")
    names = lambda *cases: F.explode(F.array_compact(F.array(*cases))).alias("name")
    asked = customers.select("session", names(F.lit("Takes"), F.lit("Timelines")))
    seen = customers.select("session", names(F.when(F.col("session") % 6 != 0, "Takes"), F.lit("Timelines"), F.when(F.col("c_acctbal") < 0, "Old")))
    return (want, have), (asked, seen), customers


@query(f"""WITH {_CAMERAS_SQL}, {_SNAPSHOT_SQL},
want AS (SELECT session, take_id, 'audio-master' AS name FROM takes UNION SELECT session, take_id, label FROM cameras),
seen AS (SELECT session, take_id, 'audio-master' AS name FROM takes WHERE o_totalprice > 30000 AND o_orderstatus <> 'P' UNION SELECT session, c.take_id, label FROM cameras c JOIN takes t USING (session, take_id) WHERE l_quantity > 3 AND t.o_orderstatus <> 'P'
  UNION SELECT session, c.take_id, 'x' || l_linenumber FROM cameras c JOIN takes t USING (session, take_id) WHERE l_tax > 0.075 AND t.o_orderstatus <> 'P'),
gone AS (SELECT session, take_id, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT * FROM want EXCEPT SELECT * FROM seen) GROUP BY ALL),
extra AS (SELECT session, take_id, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT * FROM seen EXCEPT SELECT * FROM want) GROUP BY ALL)
SELECT c_custkey AS session, NULL::VARCHAR AS take_id, 'resolve_project_missing' AS code, 'project' AS subject, 'fail' AS severity FROM customer WHERE c_nationkey = 3
UNION ALL SELECT c_custkey, NULL, 'project_snapshot_missing', 'snapshot', 'warn' FROM customer WHERE c_nationkey % 2 <> 0
UNION ALL SELECT session, NULL, CASE key WHEN 'timelineFrameRate' THEN 'timeline_framerate_mismatch' WHEN 'timelinePlaybackFrameRate' THEN 'timeline_playback_framerate_mismatch' ELSE 'resolve_color_management_mismatch' END,
  key, CASE key WHEN 'timelinePlaybackFrameRate' THEN 'warn' ELSE 'fail' END FROM differ JOIN live USING (session)
UNION ALL SELECT session, NULL, 'resolve_bin_missing', 'Takes', 'fail' FROM live WHERE session % 6 = 0
UNION ALL SELECT session, NULL, 'stale_top_level_bin', name, 'warn' FROM bins JOIN live USING (session) WHERE name = 'Old'
UNION ALL SELECT session, take_id, 'take_bin_missing', take_id, 'fail' FROM takes JOIN live USING (session) WHERE o_orderstatus = 'P'
UNION ALL SELECT session, take_id, 'take_clip_missing', names, 'fail' FROM gone JOIN takes USING (session, take_id) JOIN live USING (session) WHERE o_orderstatus <> 'P'
UNION ALL SELECT session, take_id, 'take_extra_clip', names, 'warn' FROM extra JOIN live USING (session)""")
def project_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = _takes(spark, sf_dir)
    cameras = written(_cameras(spark, sf_dir).select("session", "take_id", "label", "l_linenumber", "l_quantity", "l_tax", "o_orderstatus"))
    settings, bins, customers = _snapshots(spark, sf_dir)
    projects = customers.select("session", (F.col("c_nationkey") != 3).alias("exists"), (F.col("c_nationkey") % 2 == 0).alias("snapshot"))
    there = takes.where("o_orderstatus <> 'P'")
    master = lambda rows: rows.select("session", "take_id", F.lit("audio-master").alias("name"))
    want = master(takes).unionByName(cameras.select("session", "take_id", F.col("label").alias("name")))
    shot = cameras.where("o_orderstatus <> 'P'")
    seen = master(there.where("o_totalprice > 30000")).unionByName(shot.where("l_quantity > 3").select("session", "take_id", F.col("label").alias("name")))
    seen = seen.unionByName(shot.where("l_tax > 0.075").select("session", "take_id", F.concat(F.lit("x"), "l_linenumber").alias("name")))
    return inspection.project_issues(projects, settings, bins, there.select("session", "take_id"), (want, seen))


@query(f"""WITH {_SNAPSHOT_SQL}
SELECT session, NULL::VARCHAR AS take_id, CASE key WHEN 'timelinePlaybackFrameRate' THEN 'timeline_playback_framerate_mismatch' ELSE 'resolve_setting_drift' END AS code, key AS subject, 'warn' AS severity FROM differ
UNION ALL SELECT session, NULL, 'stale_top_level_bin', name, 'warn' FROM bins WHERE name = 'Old'
UNION ALL SELECT c_custkey, NULL, 'stale_top_level_item', 'loose-' || c_custkey, 'warn' FROM customer WHERE c_acctbal < -500
UNION ALL SELECT c_custkey, NULL, 'stray_timeline', 'Rough', 'warn' FROM customer WHERE c_nationkey % 4 = 0""")
def bootstrap_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings, bins, customers = _snapshots(spark, sf_dir)
    loose = customers.where("c_acctbal < -500").select("session", F.concat(F.lit("loose-"), "session").alias("name"))
    color = customers.select("session", F.lit("Color").alias("name"))
    return inspection.drift_issues(settings, bins, loose, color.unionByName(customers.where("c_nationkey % 4 = 0").select("session", F.lit("Rough").alias("name"))), color)


@query(f"""WITH {_CAMERAS_SQL} SELECT session, take_id, CASE WHEN l_quantity <= 3 THEN 'still_source_missing' ELSE 'still_render_failed' END AS code, take_id || '/' || label AS subject, 'warn' AS severity
FROM cameras WHERE l_quantity <= 3 OR l_discount >= 0.09""")
def still_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _cameras(spark, sf_dir).withColumn("path", F.concat_ws("/", F.lit("/media"), "take_id", "label"))
    return inspection.still_issues(clips.select("session", "take_id", "label", "path"), clips.where("l_quantity > 3").select("path"), clips.where("l_discount < 0.09").select("session", "take_id", "label"))


@query(f"""WITH {_CAMERAS_SQL}, ids AS (SELECT DISTINCT take_id || '/' || label AS clip_id, take_id, label, l_quantity FROM cameras WHERE l_linenumber = 1)
SELECT clip_id, take_id, label, CASE WHEN l_quantity > 9 THEN label END AS file, l_quantity > 9 AS found FROM ids UNION ALL SELECT 'none', 'none', NULL, NULL, false""")
def clip_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _cameras(spark, sf_dir).where("l_linenumber = 1")
    ids = clips.select(F.concat_ws("/", "take_id", "label").alias("clip_id")).distinct().unionByName(spark.createDataFrame([("none",)], "clip_id string"))
    return inspection.clip_lookup(ids, clips.where("l_quantity > 9"))


_EDIT_SQL = """
src AS (SELECT o_orderkey::VARCHAR AS take_id, CASE o_orderstatus WHEN 'F' THEN 48000 WHEN 'O' THEN 44100 ELSE 0 END AS rate, CASE WHEN o_orderpriority LIKE '1%' THEN 'aac' ELSE 'pcm_s24le' END AS codec,
  CASE WHEN o_orderpriority LIKE '2%' THEN 16 ELSE 24 END AS bits, floor(o_totalprice)::BIGINT * 10 AS samples, o_totalprice / 100 AS seconds, o_orderkey AS key FROM orders),
e AS (SELECT *, round_even(CASE WHEN rate > 0 THEN samples * 48000.0::DOUBLE / rate ELSE seconds * 48000 END, 0)::BIGINT AS expected FROM src),
p AS (SELECT *, key % 3 = 0 AS there, CASE WHEN key % 9 = 0 THEN 44100 ELSE 48000 END AS p_rate, CASE WHEN key % 5 = 0 THEN 16 ELSE 24 END AS p_bits, expected + key % 21 AS p_samples,
  NOT (rate = 48000 AND codec LIKE 'pcm_%' AND bits = 24) AS needed FROM e),
v AS (SELECT *, there AND p_rate = 48000 AND p_bits = 24 AND abs(p_samples - expected) <= 8 AS valid FROM p)
"""


def _edit(spark: SparkSession, sf_dir: str, dry_run: bool) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders")
    sources = rows.select(
        F.col("o_orderkey").cast("string").alias("take_id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 48000 WHEN 'O' THEN 44100 ELSE 0 END").alias("rate"),
        F.when(F.col("o_orderpriority").startswith("1"), "aac").otherwise("pcm_s24le").alias("codec"), F.when(F.col("o_orderpriority").startswith("2"), 16).otherwise(24).alias("bits"),
        (F.floor("o_totalprice") * 10).alias("samples"), (F.col("o_totalprice") / 100).alias("seconds"), F.col("o_orderkey").alias("key"),
    )
    want = rules.S.expected_edit_samples(F.col("samples"), F.col("rate"), F.col("seconds"))
    proxies = sources.where("key % 3 = 0").select(
        "take_id", F.when(F.col("key") % 9 == 0, 44100).otherwise(48000).alias("rate"), F.lit("pcm_s24le").alias("codec"), F.when(F.col("key") % 5 == 0, 16).otherwise(24).alias("bits"), (want + F.col("key") % 21).alias("samples"),
    )
    return rules.edit_plan(sources.drop("key"), proxies, dry_run)


@query(f"""WITH {_EDIT_SQL} SELECT take_id, CASE WHEN NOT needed THEN 'reuse-source' WHEN valid THEN 'reuse-existing' ELSE 'would-generate' END AS action,
CASE WHEN NOT needed THEN rate WHEN valid THEN p_rate ELSE 48000 END AS edit_rate, CASE WHEN NOT needed THEN bits WHEN valid THEN p_bits ELSE 24 END AS edit_bits,
CASE WHEN NOT needed THEN samples WHEN valid THEN p_samples ELSE expected END AS edit_samples FROM v""")
def edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit(spark, sf_dir, True)[0]


@query(f"""WITH {_EDIT_SQL}, c AS (SELECT take_id, CASE WHEN there THEN p_rate ELSE 0 END AS rate, there, CASE WHEN there THEN p_bits ELSE 0 END AS bits, CASE WHEN there THEN p_samples ELSE 0 END AS samples, expected FROM v WHERE needed)
SELECT take_id, 'edit_audio_sample_rate_mismatch' AS code, 'fail' AS severity, take_id AS subject FROM c WHERE rate <> 48000
UNION ALL SELECT take_id, 'edit_audio_codec_mismatch', 'fail', take_id FROM c WHERE NOT there
UNION ALL SELECT take_id, 'edit_audio_bit_depth_mismatch', 'fail', take_id FROM c WHERE bits NOT IN (24, 32)
UNION ALL SELECT take_id, 'edit_audio_sample_count_mismatch', 'fail', take_id FROM c WHERE abs(samples - expected) > 8""")
def edit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit(spark, sf_dir, False)[1]


@query(f"""WITH {_CAMERAS_SQL}, u AS (SELECT session, bool_and(l_quantity <= 49) AS same FROM cameras GROUP BY 1)
SELECT c_custkey AS session, coalesce(same, false) AS adapted, CASE WHEN same THEN 'Rec.709 Gamma 2.4' ELSE 'in' END AS input_color_space, CASE WHEN same THEN 'Rec.709 Gamma 2.4' ELSE c_mktsegment END AS timeline_color_space,
CASE WHEN same THEN 'Rec.709 Gamma 2.4' ELSE 'out' END AS output_color_space FROM customer LEFT JOIN u ON session = c_custkey""")
def color_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = _cameras(spark, sf_dir).select("session", F.when(F.col("l_quantity") > 49, "bt2020").otherwise("bt709").alias("color_space"), F.lit("bt709").alias("color_transfer"), F.lit("bt709").alias("color_primaries"))
    timelines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.lit("in").alias("input_color_space"), F.col("c_mktsegment").alias("timeline_color_space"), F.lit("out").alias("output_color_space"))
    return rules.adapted_colors(videos, timelines)


@query("""SELECT c_custkey AS session, 'logic_project_path_missing' AS code, 'warn' AS severity, '/p/' || c_custkey AS subject FROM customer WHERE c_nationkey % 4 <> 0 AND c_custkey % 3 <> 0""")
def logic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.concat(F.lit("/p/"), "c_custkey").alias("path"), "c_nationkey")
    return rules.logic_issues(rows.select("session", F.when(F.col("c_nationkey") % 4 != 0, F.col("path")).alias("project_file")), rows.where("session % 3 = 0").select("path"))


_STREAM_SQL = (
    _INGEST_SQL.replace("FROM lineitem),\nm AS", "FROM lineitem WHERE l_quantity < 45),\nm AS")
    .replace("FROM orders LEFT JOIN m ON take_id = o_orderkey::VARCHAR),", "FROM orders LEFT JOIN m ON take_id = o_orderkey::VARCHAR WHERE o_orderpriority <> '3-MEDIUM'),")
    .replace("UNION ALL SELECT take_id, 'audio_missing', 'fail', take_id FROM m WHERE take_id NOT IN (SELECT take_id FROM a)", """UNION ALL SELECT l_orderkey::VARCHAR, 'video_stream_missing', 'fail', concat_ws('-', l_linenumber, l_partkey, l_suppkey) FROM lineitem WHERE l_quantity >= 45
UNION ALL SELECT o_orderkey::VARCHAR, 'audio_stream_missing', 'fail', 'audio.wav' FROM orders WHERE o_orderpriority = '3-MEDIUM'
UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, 'audio_missing', 'fail', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
)


@query(f"WITH {_STREAM_SQL} SELECT take_id, code, severity, subject FROM found")
def stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.inspect_takes(*_ingest(spark, sf_dir, streams=True))


@query("""SELECT o_orderkey::VARCHAR AS take_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'take_file_missing' WHEN '2-HIGH' THEN 'take_load_failed' ELSE 'take_project_name_mismatch' END AS code, 'fail' AS severity, o_orderkey::VARCHAR AS subject
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'P'""")
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    loaded = ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    takes = rows.select(
        key.alias("take_id"), F.lit("s").alias("session"), F.concat(F.lit("/takes/"), key).alias("source_dir"), F.when(F.col("o_orderstatus") == "P", "q").otherwise("p").alias("project"),
        loaded.alias("loaded"), (F.col("o_orderpriority") != "1-URGENT").alias("exists"),
    )
    cameras = rows.select(key.alias("take_id"), F.lit("a").alias("label"))
    return rules.inspect_session(takes, cameras, spark.createDataFrame([], "angle string"), spark.createDataFrame([("s", "p")], "session string, project string"))


_FIELDS = ("frame_rate", "width", "height", "input_color_space", "timeline_color_space", "output_color_space")


@query("""WITH t AS (SELECT o_orderkey::VARCHAR AS take_id, unnest(['frame_rate', 'width', 'height', 'input_color_space', 'timeline_color_space', 'output_color_space']) AS subject,
  unnest([o_orderstatus = 'P', o_totalprice < 20000, false, o_orderpriority = '5-LOW', false, o_orderkey % 7 = 0]) AS differs FROM orders)
SELECT take_id, 'take_timeline_setting_mismatch' AS code, 'fail' AS severity, subject FROM t WHERE differs
UNION ALL SELECT NULL, 'mixed_session_frame_rates', 'fail', 'session' FROM lineitem HAVING count(DISTINCT l_discount) > 1""")
def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = (F.col("o_orderstatus") == "P", F.col("o_totalprice") < 20000, F.lit(False), F.col("o_orderpriority") == "5-LOW", F.lit(False), F.col("o_orderkey") % 7 == 0)
    takes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("take_id"), *(F.when(o, "other").otherwise("same").alias(f) for f, o in zip(_FIELDS, other, strict=True)))
    expected = spark.createDataFrame([("same",) * 6], list(_FIELDS))
    return rules.session_settings(takes, expected, table(spark, sf_dir, "lineitem").select((24 + F.col("l_discount")).alias("frame_rate")))


_PLAN_SQL = f"""{_CAMERAS_SQL},
audios AS (SELECT session, 'in/a-' || take_id || '.WAV' AS audio FROM takes WHERE o_orderstatus <> 'P'),
videos AS (SELECT session, 'in/v-' || take_id || '-' || label || '.Mp4' AS video FROM cameras),
planned AS (SELECT c.session, 'take-' || c.take_id AS take_id, 'in/a-' || c.take_id || '.WAV' AS audio, 'in/v-' || c.take_id || '-' || label || '.Mp4' AS video, 'angle-' || l_linenumber AS label, round(o_totalprice / 200000, 4) AS confidence
  FROM cameras c JOIN takes USING (session, take_id) WHERE l_returnflag = 'A'),
buckets AS (SELECT session, 'in/v-' || take_id || '-' || label || '.Mp4' AS source, CASE WHEN l_quantity > 25 THEN 'excluded' ELSE 'unresolved' END AS bucket FROM cameras WHERE l_returnflag IN ('R', 'A') AND l_quantity <> 7)"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    takes = _takes(spark, sf_dir)
    cameras = written(_cameras(spark, sf_dir).select("session", "take_id", "label", "l_linenumber", "l_quantity", "l_returnflag", "o_totalprice"))  # all tables of a plan come from it
    audio, video = F.concat(F.lit("in/a-"), "take_id", F.lit(".WAV")), F.concat(F.lit("in/v-"), "take_id", F.lit("-"), "label", F.lit(".Mp4"))
    rows = cameras.withColumn("video", video).withColumn("audio", audio)
    planned = rows.where("l_returnflag = 'A'").select(
        "session", F.concat(F.lit("take-"), "take_id").alias("take_id"), "audio", "video", F.concat(F.lit("angle-"), "l_linenumber").alias("label"), F.round(F.col("o_totalprice") / 200000, 4).alias("confidence")
    )
    buckets = rows.where("l_returnflag IN ('R', 'A') AND l_quantity <> 7").select("session", F.col("video").alias("source"), F.when(F.col("l_quantity") > 25, "excluded").otherwise("unresolved").alias("bucket"))
    return takes.where("o_orderstatus <> 'P'").select("session", audio.alias("audio")), rows.select("session", "video"), planned, buckets


@query(f"""WITH {_PLAN_SQL}, a AS (SELECT DISTINCT session FROM audios), v AS (SELECT DISTINCT session FROM videos), w AS (SELECT session FROM a INTERSECT SELECT session FROM v),
per AS (SELECT session, take_id, count(*) AS n, max(confidence) AS confidence FROM planned GROUP BY ALL),
rest AS (SELECT * FROM buckets JOIN w USING (session) WHERE source NOT IN (SELECT video FROM planned))
SELECT session, 'incoming_audio_missing' AS code, 'fail' AS severity, 'plan' AS subject FROM (SELECT * FROM v EXCEPT SELECT * FROM a)
UNION ALL SELECT session, 'incoming_video_missing', 'fail', 'plan' FROM (SELECT * FROM a EXCEPT SELECT * FROM v)
UNION ALL SELECT session, 'grouping_failed', 'fail', 'plan' FROM w WHERE session NOT IN (SELECT session FROM planned)
UNION ALL SELECT DISTINCT session, 'unresolved_media_present', 'warn', 'plan' FROM rest WHERE bucket = 'unresolved'
UNION ALL SELECT session, 'excluded_media_detected', 'info', source FROM rest WHERE bucket = 'excluded'
UNION ALL SELECT session, 'take_size_invalid', 'warn', take_id FROM per WHERE n > 8
UNION ALL SELECT session, 'take_confidence_low', 'warn', take_id FROM per WHERE confidence < 0.6""")
def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.plan_issues(*_plan(spark, sf_dir))


@query(f"""WITH {_PLAN_SQL}
SELECT DISTINCT session, take_id, audio AS source, 'takes/' || take_id || '/audio.wav' AS target FROM planned UNION SELECT DISTINCT session, take_id, video, 'takes/' || take_id || '/' || label || '.mp4' FROM planned
UNION ALL SELECT session, NULL, source, 'excluded/' || substr(source, 4) FROM buckets WHERE bucket = 'excluded'""")
def plan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, planned, buckets = _plan(spark, sf_dir)
    return grouping.plan_targets(planned, buckets)


@query(f"""WITH {_PLAN_SQL}, planned_all AS (SELECT DISTINCT session, audio AS source FROM planned UNION SELECT DISTINCT session, video FROM planned UNION ALL SELECT session, source FROM buckets),
targets AS (SELECT DISTINCT take_id, 'takes/' || take_id || '/audio.wav' AS target, audio AS source FROM planned UNION SELECT DISTINCT take_id, 'takes/' || take_id || '/' || label || '.mp4', video FROM planned UNION ALL SELECT NULL, 'excluded/' || substr(source, 4), source FROM buckets WHERE bucket = 'excluded'),
now AS (SELECT audio AS source FROM audios UNION SELECT video FROM videos)
SELECT 'source_missing' AS check, source AS subject FROM (SELECT source FROM planned_all EXCEPT SELECT source FROM now) UNION ALL SELECT 'source_extra', source FROM (SELECT source FROM now EXCEPT SELECT source FROM planned_all)
UNION ALL SELECT 'source_twice', source FROM planned_all GROUP BY source HAVING count(*) > 1
UNION ALL SELECT 'target_twice', target FROM targets GROUP BY target HAVING count(*) > 1
UNION ALL SELECT 'target_exists', target FROM targets WHERE length(target) % 7 = 0
UNION ALL SELECT 'plan_not_passed', 'unresolved_media_present' FROM buckets HAVING count(*) FILTER (bucket = 'unresolved') > 0
UNION ALL SELECT 'other_root', '/b'""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    audios, videos, planned, buckets = _plan(spark, sf_dir)
    sources = grouping.planned_sources(planned, buckets).select("source")
    current = audios.select(F.col("audio").alias("source")).unionByName(videos.select(F.col("video").alias("source")))
    targets = grouping.plan_targets(planned, buckets).withColumn("exists", F.length("target") % 7 == 0)
    found = spark.createDataFrame([("unresolved_media_present", "warn"), ("excluded_media_detected", "info")], "code string, severity string")
    return grouping.preflight(sources, current, targets, found, spark.createDataFrame([("/a", "/b"), ("/a", "/a")], "planned string, given string"))


@query(f"""WITH {_EVIDENCE_SQL}, takes AS (SELECT DISTINCT session, take_id FROM ev UNION SELECT session, 'user-none-' || session FROM ev)
SELECT session, 'take_order_cross_setup_ambiguous' AS code, 'warn' AS severity, 'order' AS subject FROM (SELECT session, grp, list_sort(list(take_id)) AS takes FROM ranks WHERE media_type = 'video' GROUP BY ALL) GROUP BY session HAVING count(DISTINCT takes) > 1
UNION ALL SELECT session, 'take_order_evidence_missing', 'warn', string_agg(take_id, ', ' ORDER BY take_id) FROM takes ANTI JOIN ranks USING (session, take_id) GROUP BY session""")
def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir)
    takes = rows.select("session", "take_id").unionByName(rows.select("session", F.concat(F.lit("user-none-"), "session").alias("take_id"))).distinct()
    return order.order_issues(order.evidence_ranks(rows, ("session",)), takes, ("session",))


@query("""WITH a AS (SELECT o_custkey AS session, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT c_custkey AS session, 1 AS n FROM customer WHERE c_acctbal < 0)
SELECT session, sum(n)::BIGINT AS issues FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def issue_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("session"))
    return inspection.issue_total(late, table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("session")))


@query("""SELECT l_orderkey AS take, bool_and(l_quantity > 2) AS whole FROM lineitem GROUP BY 1""")
def moved_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("take"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("name"), "l_quantity")
    return inspection.moved_whole(rows, rows.where("l_quantity > 2"), "take")


_RELOAD_SQL = """o AS (SELECT o_custkey AS session, o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS take_id, o_orderstatus AS value, l.hi, l.lo FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS hi, min(l_linestatus) AS lo FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
side AS (SELECT session, key, value IS DISTINCT FROM hi AS was, value IS DISTINCT FROM lo AS still FROM o),
changes AS (SELECT session, NULL AS take_id, 'resolve_setting_drift' AS code, key AS subject, 'warn' AS severity, CASE WHEN was AND still THEN 'same' WHEN was THEN 'gone' ELSE 'new' END AS change, 1 AS issues FROM side WHERE was OR still
  UNION ALL SELECT c_custkey, NULL, 'resolve_project_missing', 'project', 'fail', CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 'same' WHEN c_acctbal < 0 THEN 'gone' ELSE 'new' END, 1 FROM customer WHERE c_acctbal < 0 OR (c_custkey % 10 = 0))"""


def _reloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as sessions and their orders as settings, inspected twice: by the greatest and by the least status of their items."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("value"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("hi"), F.min("l_linestatus").alias("lo"))
    rows = orders.join(items, "l_orderkey", "left").withColumn("key", F.col("l_orderkey").cast("string"))
    expected = rows.select("session", "key", "value")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), "c_acctbal")
    late = (F.col("c_acctbal") < 0, ((F.col("c_acctbal") < 0) & (F.col("session") % 2 == 0)) | ((F.col("c_acctbal") >= 0) & (F.col("session") % 10 == 0)))
    none = spark.createDataFrame([], "session long, name string")
    found = []
    for side, gone in zip(("hi", "lo"), late, strict=True):
        observed = rows.where(F.col(side).isNotNull()).select("session", "key", F.col(side).alias("value"))
        drift = inspection.drift_issues((expected, observed), (none, none), none, none, none)
        lost = customers.where(gone).select("session", F.lit(None).cast("string").alias("take_id"), F.lit("resolve_project_missing").alias("code"), F.lit("project").alias("subject"), F.lit("fail").alias("severity"))
        found.append(drift.unionByName(lost))
    return found[0], found[1]


@query(f"WITH {_RELOAD_SQL} SELECT * FROM changes")
def reload_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.reload_changes(*_reloads(spark, sf_dir)).withColumn("issues", F.col("issues").cast("int"))


@query(f"""WITH {_RELOAD_SQL}, per AS (SELECT session, max(CASE severity WHEN 'fail' THEN 2 ELSE 1 END) FILTER (change <> 'gone') AS rank, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'gone') AS gone, count(*) FILTER (change = 'same') AS same FROM changes GROUP BY 1)
SELECT c_custkey AS session, c_nationkey <> 7 AS reloaded, CASE WHEN c_nationkey = 7 OR rank = 2 THEN 'FAIL' WHEN rank = 1 THEN 'WARN' ELSE 'PASS' END AS status, coalesce(new, 0) AS new, coalesce(gone, 0) AS gone, coalesce(same, 0) AS same
FROM customer LEFT JOIN per ON session = c_custkey""")
def reload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), (F.col("c_nationkey") != 7).alias("reloaded"))
    return inspection.reload_status(sessions, inspection.reload_changes(*_reloads(spark, sf_dir)))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity * 30)::BIGINT - 60 AS frames, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / 1000 - 3 END AS seconds, CASE WHEN l_linestatus = 'F' THEN 25.0 WHEN l_returnflag = 'R' THEN 0.0 END AS rate FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN frames > 0 THEN least(frames - 1, greatest(0, CASE WHEN seconds IS NULL THEN frames // 2 ELSE round_even(seconds * coalesce(nullif(rate, 0), 29.97), 0)::BIGINT END)) END AS frame FROM c""")
def still_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("frames", F.floor(F.col("l_quantity") * 30) - 60)
    seconds = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / 1000 - 3)
    rate = F.when(F.col("l_linestatus") == "F", 25.0).when(F.col("l_returnflag") == "R", 0.0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", inspection.still_frame(F.col("frames"), seconds=seconds, rate=rate).alias("frame"))


@query("""WITH cur AS (SELECT n_name AS name, '/media/' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'DISK' ELSE 'NET' END AS kind FROM nation), new AS (SELECT r_name AS name, '/media/' || r_regionkey AS path, 'DISK' AS kind FROM region)
SELECT name || ':' || path || ':*:::' || kind AS record FROM (SELECT * FROM new UNION ALL SELECT * FROM cur WHERE kind <> 'DISK' OR (name NOT IN (SELECT name FROM new) AND path NOT IN (SELECT path FROM new)))""")
def disk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("/media/"), c)
    cur = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), path("n_nationkey").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "DISK").otherwise("NET").alias("kind"))
    new = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), path("r_regionkey").alias("path"), F.lit("DISK").alias("kind"))
    rows = coverage.replace_records(cur, new, ["name", "path"], "kind")
    return rows.select(S.library_record(F.col("name"), F.col("path"), F.col("kind")).alias("record"))

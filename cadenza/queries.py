"""The catalogue: each operator over whole tables, with DuckDB SQL of the same rows where SQL can express it.

Tables stand in for a recording session's: orders for takes, line items for clips, users
and event types for takes and evidence groups, embeddings for view descriptors. Sessions
are customers, days or blocks of ids, so that what meets in one group stays of a session's
size however large the tables are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import color, vectors, views
from cadenza.functions import scalars as S
from cadenza.operators import assign, clusters, coverage, layout, matching, order, rules, signal
from cadenza.plans import grouping
from cadenza.sources import media, sinks
from cadenza.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f"q_{f.__name__}"
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- order of takes

USERS_PER_SESSION = 15


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as takes, event types as groups, purchases as the audio group; fifteen users make a session."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    return rows.select(
        F.floor(F.col("user_id") / USERS_PER_SESSION).alias("session"), F.format_string("user-%06d", "user_id").alias("take_id"), F.col("event_type").alias("grp"),
        F.when(F.col("event_type") == "purchase", "audio").otherwise("video").alias("media_type"), F.col("event_type").alias("source"), F.unix_micros(F.col("first").cast("timestamp")).cast("double").alias("ts"),
    )


_EVIDENCE_SQL = f"""
ev AS (SELECT floor(user_id / {USERS_PER_SESSION}.0)::BIGINT AS session, printf('user-%06d', user_id) AS take_id, event_type AS grp,
              CASE WHEN event_type = 'purchase' THEN 'audio' ELSE 'video' END AS media_type, min(ts) AS ts FROM events GROUP BY ALL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY session, grp) AS members, row_number() OVER w AS position, percent_rank() OVER w AS rank
           FROM ev WINDOW w AS (PARTITION BY session, grp ORDER BY ts, take_id)),
ranks AS (SELECT * FROM ranked WHERE members > 1)
"""


@query(f"""WITH {_EVIDENCE_SQL},
per AS (SELECT session, take_id, count(*) AS evidence_groups, avg(rank) AS average_rank, min(position) FILTER (media_type = 'audio') AS audio_rank FROM ranks GROUP BY ALL),
sets AS (SELECT session, count(DISTINCT takes) AS n FROM (SELECT session, grp, list_sort(list(take_id)) AS takes FROM ranks WHERE media_type = 'video' GROUP BY ALL) GROUP BY session),
rows AS (SELECT t.session, t.take_id, coalesce(evidence_groups, 0) AS evidence_groups, coalesce(average_rank, 999.0) AS average_rank, audio_rank,
                coalesce(n, 0) > 1 AND count(audio_rank) OVER s = count(*) OVER s AS by_audio
         FROM (SELECT DISTINCT session, take_id FROM ev) t LEFT JOIN per USING (session, take_id) LEFT JOIN sets USING (session) WINDOW s AS (PARTITION BY t.session))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN by_audio THEN audio_rank END, round(average_rank, 12), take_id) AS position, take_id,
       CASE WHEN evidence_groups >= 3 THEN 'high' WHEN evidence_groups = 2 THEN 'medium' WHEN evidence_groups = 1 THEN 'low' ELSE 'none' END AS confidence,
       evidence_groups, round(average_rank, 6) AS average_rank FROM rows""")
def take_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir)
    return order.take_order(rows, rows.select("session", "take_id").distinct(), ("session",)).withColumn("average_rank", r6("average_rank"))


@query(f"WITH {_EVIDENCE_SQL} SELECT session, take_id, grp, media_type, position, round(rank, 6) AS rank FROM ranks")
def evidence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.evidence_ranks(_evidence(spark, sf_dir), ("session",)).withColumn("rank", r6("rank"))


@query(f"""WITH {_EVIDENCE_SQL} SELECT session, count(DISTINCT takes) AS take_sets, count(DISTINCT takes) > 1 AS ambiguous
FROM (SELECT session, grp, list_sort(list(take_id)) AS takes FROM ranks WHERE media_type = 'video' GROUP BY ALL) GROUP BY session""")
def setup_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.ambiguous_setups(order.evidence_ranks(_evidence(spark, sf_dir), ("session",)), ("session",))


# ---- layout

_GAP = layout.gap_frames(29.97)


def _clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("take_id"), F.floor(F.col("o_totalprice") / 100).alias("audio_frames"))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("take_id"), F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")), F.floor("l_quantity").cast("string"), F.floor("l_extendedprice").cast("string"), F.floor(F.col("l_discount") * 100 + 0.5).cast("string")).alias("file"),
        (F.col("l_linenumber") - F.floor("l_quantity")).alias("offset"), F.floor(F.col("l_extendedprice") / 100).alias("frames"),
    )
    return orders, items.join(orders.select("session", "take_id"), "take_id")


_LAYOUT_SQL = f"""
takes AS (SELECT o_custkey AS session, o_orderkey AS take_id, floor(o_totalprice / 100)::BIGINT AS audio_frames FROM orders),
clips AS (SELECT session, take_id, l_returnflag || l_linestatus AS label,
                 concat_ws('-', l_linenumber, l_partkey, l_suppkey, floor(l_quantity)::BIGINT, floor(l_extendedprice)::BIGINT, floor(l_discount * 100 + 0.5)::BIGINT) AS file,
                 l_linenumber - floor(l_quantity)::BIGINT AS "offset", floor(l_extendedprice / 100)::BIGINT AS frames FROM lineitem JOIN takes ON take_id = l_orderkey),
per AS (SELECT session, take_id, min("offset") AS least, max("offset" + frames) AS most FROM clips GROUP BY ALL),
shifted AS (SELECT session, take_id, audio_frames, greatest(0, -coalesce(least, 0)) AS shift, most FROM takes LEFT JOIN per USING (session, take_id)),
segments AS (SELECT session, take_id, audio_frames, shift, shift + greatest(audio_frames, coalesce(most, 0)) AS segment FROM shifted),
laid AS (SELECT *, coalesce(sum(segment + {_GAP}) OVER (PARTITION BY session ORDER BY take_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record FROM segments)
"""


@query(f"WITH {_LAYOUT_SQL} SELECT session, take_id, audio_frames, shift, segment, record, record + shift AS marker FROM laid")
def timeline_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes, clips = _clips(spark, sf_dir)
    return layout.timeline(layout.take_segments(takes, clips), _GAP)


@query(f"""WITH {_LAYOUT_SQL},
angles AS (SELECT label, min(take_id) AS pos FROM clips GROUP BY label)
SELECT c.session, c.take_id, c.label, c.file, row_number() OVER (PARTITION BY c.session, c.take_id ORDER BY pos, c.label, c.file) AS track, record + shift + "offset" AS start
FROM clips c JOIN laid USING (session, take_id) JOIN angles a ON a.label = c.label""")
def placed_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes, clips = _clips(spark, sf_dir)
    angles = coverage.first_seen(clips, "label", "take_id").select(F.col("label").alias("angle"), "pos")
    return layout.placed_clips(layout.timeline(layout.take_segments(takes, clips), _GAP), clips, angles)


@query("""WITH n AS (SELECT l_orderkey AS take_id, count(DISTINCT l_linenumber)::INT AS n FROM lineitem GROUP BY 1)
SELECT take_id, 'video' AS kind, i::INT AS index, 'compact-v' || i AS name FROM n, unnest(range(1, n + 1)) AS t(i)
UNION ALL SELECT take_id, 'audio', 1, 'master-audio' FROM n
UNION ALL SELECT take_id, 'audio', (i + 1)::INT, 'scratch-compact-v' || i FROM n, unnest(range(1, n + 1)) AS t(i)""")
def track_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("take_id")).agg(F.countDistinct("l_linenumber").cast("int").alias("tracks"))
    return layout.track_names(counts)


def _track_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clips in the order of shipping on a supplier's track of one month; those of small quantity are not observed."""
    items = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM")).alias("track"), F.format_string("take-%09d", "l_orderkey").alias("take_id"),
        F.format_string("%d-%d-%d", "l_orderkey", "l_partkey", "l_linenumber").alias("name"), F.col("l_orderkey").alias("start"), "l_quantity",
    )
    return items.drop("l_quantity"), items.where("l_quantity > 3").select("track", "name", "start")


_TRACK_SQL = """
items AS (SELECT l_suppkey || '/' || strftime(l_shipdate, '%Y-%m') AS track, printf('take-%09d', l_orderkey) AS take_id, l_orderkey || '-' || l_partkey || '-' || l_linenumber AS name,
                 l_orderkey AS start, l_quantity FROM lineitem),
e AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY start, name) AS i FROM items),
o AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY start, name) AS i FROM items WHERE l_quantity > 3)
"""


@query(f"""WITH {_TRACK_SQL} SELECT * FROM (SELECT e.track, e.take_id,
CASE WHEN o.track IS NULL THEN 'missing' WHEN e.name <> o.name THEN 'name' WHEN e.start <> o.start THEN 'start' END AS difference
FROM e LEFT JOIN o USING (track, i)) WHERE difference IS NOT NULL""")
def layout_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.verify(*_track_items(spark, sf_dir))


# ---- coverage and sets


@query("""WITH have AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT * FROM (SELECT DISTINCT o_custkey FROM have) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM have) EXCEPT SELECT * FROM have""")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing_cells(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("""SELECT event_type FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type
HAVING count(*) = (SELECT count(DISTINCT user_id) FROM events)""")
def coverage_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.common_columns(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""SELECT o_custkey, count(DISTINCT o_orderpriority) AS present, (SELECT count(DISTINCT o_orderpriority) FROM orders) - count(DISTINCT o_orderpriority) AS missing FROM orders GROUP BY 1""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS still, CASE WHEN l.doc_id IS NULL THEN 'still_missing' END AS code FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def manifest_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.manifest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT key, 'missing' AS side FROM (SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT key, 'extra' FROM (SELECT l_orderkey AS key FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""")
def stale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.drift(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) = 1""")
def dedupe_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return coverage.keep_best(rows, ("l_orderkey", "l_linenumber"), "l_extendedprice", ("l_partkey", "l_suppkey"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'skipped' ELSE 'import' END AS action FROM customer""")
def pending_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = coverage.pending(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return new.withColumn("action", F.lit("import")).unionByName(old.withColumn("action", F.lit("skipped")))


@query("""WITH r AS (SELECT DISTINCT user_id, event_type, ts::DATE::VARCHAR AS day, ts < ts::DATE + INTERVAL 12 HOUR AS early FROM events), a AS (SELECT user_id, event_type, day FROM r WHERE early), b AS (SELECT user_id, event_type, day FROM r WHERE NOT early)
SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def bin_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events of a day's first half that its second half lacks, and the other way round."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"), (F.hour("ts") < 12).alias("early"))
    return coverage.drift(rows.where("early"), rows.where("not early"), "user_id", "event_type", "day")


@query("""SELECT o_orderkey AS key, o_orderstatus AS expected, l.status AS observed FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS status FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
WHERE o_orderstatus IS DISTINCT FROM l.status""")
def setting_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    have = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_linestatus").alias("value"))
    return coverage.setting_mismatches(want, have)



@query("""WITH a AS (SELECT c_custkey AS key, unnest(['nation', 'segment']) AS field, unnest([c_nationkey::VARCHAR, c_mktsegment]) AS value FROM customer),
b AS (SELECT s_suppkey AS key, unnest(['nation', 'segment']) AS field, unnest([s_nationkey::VARCHAR, NULL]) AS value FROM supplier)
SELECT a.key, a.field, a.value AS expected, b.value AS observed FROM a JOIN b USING (key, field) WHERE a.value IS DISTINCT FROM b.value""")
def unpivot_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("segment"))
    x, y = (coverage.unpivot(t, ["key"], ["nation", "segment"]) for t in (a, b))
    return x.withColumnRenamed("value", "expected").join(y.withColumnRenamed("value", "observed"), ["key", "field"]).where(~F.col("expected").eqNullSafe(F.col("observed")))


@query("""SELECT coalesce(n_name, r_name) AS key, coalesce('nation-' || n_nationkey, 'region-' || r_regionkey) AS value, n_name IS NOT NULL AS changed
FROM (SELECT * FROM region) FULL JOIN (SELECT * FROM nation) ON r_name = n_name""")
def config_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.concat(F.lit("region-"), "r_regionkey").alias("value"))
    new = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.concat(F.lit("nation-"), "n_nationkey").alias("value"))
    return coverage.upsert(now, new)


@query("""WITH cur AS (SELECT n_name AS name, '/media/' || n_nationkey AS path FROM nation), new AS (SELECT r_name AS name, '/media/' || r_regionkey AS path FROM region)
SELECT * FROM cur WHERE name NOT IN (SELECT name FROM new) AND path NOT IN (SELECT path FROM new) UNION ALL SELECT * FROM new""")
def replace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("/media/"), "n_nationkey").alias("path"))
    new = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("/media/"), "r_regionkey").alias("path"))
    return coverage.replace_records(cur, new, ["name", "path"])


@query("""WITH RECURSIVE nodes AS (SELECT 'root' AS parent, 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
walk AS (SELECT id, 1 AS depth FROM nodes WHERE parent = 'root' UNION ALL SELECT n.id, depth + 1 FROM nodes n JOIN walk w ON n.parent = w.id) SELECT * FROM walk""")
def recursive_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = (
        table(spark, sf_dir, "region").select(F.lit("root").alias("parent"), name("r", "r_regionkey").alias("id"))
        .unionByName(table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("id")))
        .unionByName(table(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("id")))
    )
    return coverage.descendants(nodes, "root")


@query("""SELECT p_partkey, p_name, p_name || '-stale' || CASE WHEN i > 1 THEN '-' || i ELSE '' END AS target FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i FROM part)""")
def stale_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.stale_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("SELECT l_shipdate::DATE::VARCHAR AS label, min(l_orderkey) AS pos FROM lineitem GROUP BY 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.first_seen(table(spark, sf_dir, "lineitem").withColumn("label", F.date_format("l_shipdate", "yyyy-MM-dd")), "label", "l_orderkey")


# ---- pairs and buckets


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as audios, their line items as videos; ten times the discount as waveform score."""
    audio = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lane"), F.col("o_orderkey").alias("audio"), (F.col("o_totalprice") / 1000).alias("audio_s"))
    video = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lane"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity").alias("video"), (F.col("l_extendedprice") / 200).alias("video_s")
    )
    rows = matching.duration_pairs(audio, video)
    return rows.withColumn("pair_score", S.pair_score(F.col("duration_score"), F.col("video.l_discount") * 10))


_PAIRS_SQL = """
gaps AS (SELECT o_orderkey AS audio, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_quantity, o_totalprice / 1000 - l_extendedprice / 200 AS delta FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
durations AS (SELECT *, abs(delta) AS gap, CASE WHEN abs(delta) > 240 THEN 0 WHEN delta BETWEEN -45 AND 75 THEN 1 - least(abs(delta) / 120, 0.35)
                     ELSE greatest(0.0, 0.65 - (CASE WHEN delta > 75 THEN delta - 75 ELSE abs(delta) - 45 END) / 120) END AS duration_score FROM gaps),
pairs AS (SELECT *, greatest(0.0, least(1.0, 0.65 * duration_score + 0.35 * (l_discount * 10))) AS pair_score FROM durations)
"""


@query(f"WITH {_PAIRS_SQL} SELECT audio, l_linenumber, l_partkey, round(duration_score, 9) AS duration_score, round(gap, 9) AS gap FROM pairs")
def duration_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("audio", "video.l_linenumber", "video.l_partkey", F.round("duration_score", 9).alias("duration_score"), F.round("gap", 9).alias("gap"))


@query(f"WITH {_PAIRS_SQL} SELECT audio, l_linenumber, l_partkey, round(pair_score, 9) AS pair_score FROM pairs")
def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("audio", "video.l_linenumber", "video.l_partkey", F.round("pair_score", 9).alias("pair_score"))


@query(f"""WITH {_PAIRS_SQL} SELECT audio, count(*) AS videos, round(avg(pair_score), 6) AS confidence, count(*) BETWEEN 1 AND 8 AND avg(pair_score) >= 0.60 AS production
FROM pairs WHERE pair_score >= 0.56 GROUP BY audio""")
def take_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.take_confidence(_pairs(spark, sf_dir).withColumn("assigned", F.col("pair_score") >= S.MIN_LANE_SCORE))
    return rows.select("audio", "videos", r6("confidence").alias("confidence"), S.is_production_take(F.col("videos"), F.col("confidence")).alias("production"))


@query(f"""WITH {_PAIRS_SQL},
takes AS (SELECT o_orderkey AS audio, coalesce(n, 0) AS n, c, coalesce(n, 0) BETWEEN 1 AND 8 AND c >= 0.60 AS production FROM orders LEFT JOIN (SELECT audio, count(*) AS n, avg(pair_score) AS c FROM pairs WHERE pair_score >= 0.56 GROUP BY 1) ON audio = o_orderkey),
part AS (SELECT *, CASE WHEN n <= 2 AND c < 0.60 THEN 'excluded' ELSE 'unresolved' END AS bucket FROM takes WHERE n > 0 AND NOT production),
vids AS (SELECT audio || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || floor(l_quantity)::BIGINT || '/' || floor(l_discount * 100 + 0.5)::BIGINT AS video, audio, pair_score FROM pairs),
used AS (SELECT * FROM vids WHERE pair_score >= 0.56),
found AS (SELECT audio::VARCHAR AS source, 'audio' AS media_type, 'excluded' AS bucket, 'no lane gave a video' AS reason, 0.95 AS confidence FROM takes WHERE n = 0
UNION ALL SELECT audio::VARCHAR, 'audio', bucket, CASE WHEN bucket = 'excluded' THEN 'too few or weak videos for a take' ELSE 'part of a take only' END, round(c, 4) FROM part
UNION ALL SELECT video, 'video', bucket, CASE WHEN bucket = 'excluded' THEN 'too few or weak videos for a take' ELSE 'part of a take only' END, round(pair_score, 4) FROM used JOIN part USING (audio)
UNION ALL SELECT video, 'video', 'excluded', 'no audio fits this video', round(pair_score, 4) FROM vids WHERE pair_score < 0.56 AND video NOT IN (SELECT video FROM used))
SELECT bucket, media_type, source, reason, confidence FROM found QUALIFY row_number() OVER (PARTITION BY bucket, media_type, source ORDER BY confidence DESC, reason) = 1""")
def bucket_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("video")
    name = F.concat_ws("/", "audio", v["l_linenumber"], v["l_partkey"], v["l_suppkey"], F.floor(v["l_quantity"]), F.floor(v["l_discount"] * 100 + 0.5))
    rows = _pairs(spark, sf_dir).select(name.alias("video"), F.col("audio").cast("string").alias("audio"), "pair_score", (F.col("pair_score") >= S.MIN_LANE_SCORE).alias("assigned"))
    audios = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("audio"))
    return matching.classify(audios, rows).select("bucket", "media_type", "source", "reason", "confidence")


# ---- rules


def _ingest(spark: SparkSession, sf_dir: str, streams: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items as videos and orders as audios, with probe values made of their columns; with streams also whether they have one."""
    has = lambda holds: [holds.alias("has_stream")] if streams else []
    items = table(spark, sf_dir, "lineitem")
    file = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    rate = 29.97 + F.col("l_discount") * 0.9
    videos = items.select(
        F.col("l_orderkey").cast("string").alias("take_id"), file.alias("file"), (F.col("l_extendedprice") / 200).alias("duration_seconds"), rate.alias("frame_rate"),
        F.when(F.col("l_tax") > 0.07, rate + 1).otherwise(rate).alias("nominal_frame_rate"), (F.col("l_quantity") > 2).alias("scratch_audio_present"),
        *(F.when(F.col(c) == v, "bt2020").otherwise("bt709").alias(a) for a, c, v in (("color_space", "l_returnflag", "R"), ("color_transfer", "l_linestatus", "F"), ("color_primaries", "l_returnflag", "A"))), *has(F.col("l_quantity") < 45),
    )
    audios = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("take_id"), F.lit("audio.wav").alias("file"), (F.col("o_totalprice") / 1000).alias("duration_seconds"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(48000).alias("sample_rate"), F.substring("o_orderpriority", 1, 1).cast("int").alias("channels"), *has(F.col("o_orderpriority") != "3-MEDIUM"),
    )
    return videos, audios, items.select(F.col("l_orderkey").cast("string").alias("take_id"), file.alias("file"))


_INGEST_SQL = """
v AS (SELECT l_orderkey::VARCHAR AS take_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS file, l_extendedprice / 200 AS s, 29.97::DOUBLE + l_discount * 0.9 AS rate,
             CASE WHEN l_tax > 0.07 THEN 29.97::DOUBLE + l_discount * 0.9 + 1 ELSE 29.97::DOUBLE + l_discount * 0.9 END AS nominal, l_quantity, l_returnflag, l_linestatus FROM lineitem),
m AS (SELECT take_id, median(s) AS med, count(DISTINCT round(rate, 3)) AS rates FROM v GROUP BY 1),
w AS (SELECT * FROM v JOIN m USING (take_id)),
a AS (SELECT o_orderkey::VARCHAR AS take_id, o_totalprice / 1000 AS s, o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS channels, med FROM orders LEFT JOIN m ON take_id = o_orderkey::VARCHAR),
found AS (
SELECT take_id, 'variable_frame_rate' AS code, 'fail' AS severity, file AS subject FROM w WHERE abs(rate - nominal) > 0.01
UNION ALL SELECT take_id, 'frame_rate_mismatch', 'fail', file FROM w WHERE abs(rate - 29.97::DOUBLE) > 0.05
UNION ALL SELECT take_id, 'frame_rate_nominal_warning', 'warn', file FROM w WHERE abs(rate - 29.97::DOUBLE) > 0.01 AND abs(rate - 29.97::DOUBLE) <= 0.05
UNION ALL SELECT take_id, 'color_space_mismatch', 'fail', file FROM w WHERE l_returnflag = 'R'
UNION ALL SELECT take_id, 'color_transfer_mismatch', 'fail', file FROM w WHERE l_linestatus = 'F'
UNION ALL SELECT take_id, 'color_primaries_mismatch', 'fail', file FROM w WHERE l_returnflag = 'A'
UNION ALL SELECT take_id, 'scratch_audio_missing', 'warn', file FROM w WHERE NOT l_quantity > 2
UNION ALL SELECT take_id, 'video_duration_outlier', 'fail', file FROM w WHERE abs(s - med) > 180
UNION ALL SELECT take_id, 'video_duration_warning', 'warn', file FROM w WHERE abs(s - med) > 60 AND abs(s - med) <= 180
UNION ALL SELECT take_id, 'mixed_take_frame_rates', 'fail', take_id FROM m WHERE rates > 1
UNION ALL SELECT take_id, 'audio_channel_layout_unsupported', 'fail', 'audio.wav' FROM a WHERE channels NOT IN (1, 2)
UNION ALL SELECT take_id, 'audio_sample_rate_missing', 'fail', 'audio.wav' FROM a WHERE o_orderstatus = 'P'
UNION ALL SELECT take_id, 'audio_duration_outlier', 'fail', 'audio.wav' FROM a WHERE abs(s - med) > 180
UNION ALL SELECT take_id, 'audio_duration_warning', 'warn', 'audio.wav' FROM a WHERE abs(s - med) > 60 AND abs(s - med) <= 180
UNION ALL SELECT take_id, 'audio_missing', 'fail', take_id FROM m WHERE take_id NOT IN (SELECT take_id FROM a))
"""


@query(f"WITH {_INGEST_SQL} SELECT take_id, code, severity, subject FROM found")
def rule_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.inspect_takes(*_ingest(spark, sf_dir))


@query(f"WITH {_INGEST_SQL} SELECT take_id, count(*) FILTER (severity = 'fail') AS fail, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info FROM found GROUP BY 1")
def severity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.severity_counts(rules.inspect_takes(*_ingest(spark, sf_dir)), "take_id")


@query(f"""WITH {_INGEST_SQL} SELECT o_orderkey::VARCHAR AS take_id, CASE WHEN bool_or(severity = 'fail') THEN 'FAIL' WHEN bool_or(severity = 'warn') THEN 'WARN' ELSE 'PASS' END AS status
FROM orders LEFT JOIN found ON take_id = o_orderkey::VARCHAR GROUP BY 1""")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos, audios, cameras = _ingest(spark, sf_dir)
    return rules.folded_status(rules.inspect_takes(videos, audios, cameras), audios, "take_id")


@query("""WITH m AS (SELECT o_custkey, median(o_totalprice) AS med FROM orders GROUP BY 1)
SELECT o_orderkey, round(abs(o_totalprice - med), 2) AS off, CASE WHEN abs(o_totalprice - med) > 180000 THEN 'fail' ELSE 'warn' END AS severity FROM orders JOIN m USING (o_custkey) WHERE abs(o_totalprice - med) > 60000""")
def median_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    off = F.abs(F.col("o_totalprice") - F.col("med"))
    joined = rows.join(rows.groupBy("o_custkey").agg(F.median("o_totalprice").alias("med")), "o_custkey").where(off > 60000)
    return joined.select("o_orderkey", F.round(off, 2).alias("off"), F.when(off > 180000, "fail").otherwise("warn").alias("severity"))


@query("SELECT l_orderkey, count(DISTINCT round(l_discount, 3)) AS rates FROM lineitem GROUP BY 1 HAVING count(DISTINCT round(l_discount, 3)) > 1")
def mixed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct(F.round("l_discount", 3)).alias("rates")).where("rates > 1")


@query("SELECT l_orderkey, bool_and(l_returnflag = 'N' AND l_linestatus = 'O') AS uniform FROM lineitem GROUP BY 1")
def uniform_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.uniform(table(spark, sf_dir, "lineitem"), ("l_orderkey",), {"l_returnflag": "N", "l_linestatus": "O"})


@query("""WITH t AS (SELECT o_orderkey::VARCHAR AS take_id, CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE 's' END AS session, '/takes/' || CASE WHEN o_orderpriority = '5-LOW' THEN 'x' ELSE o_orderkey::VARCHAR END AS dir FROM orders),
c AS (SELECT l_orderkey::VARCHAR AS take_id, l_returnflag AS label FROM lineitem)
SELECT take_id, 'take_session_mismatch' AS code, 'fail' AS severity, take_id AS subject FROM t WHERE session <> 's'
UNION ALL SELECT take_id, 'take_source_dir_mismatch', 'fail', take_id FROM t WHERE NOT ends_with(dir, '/' || take_id)
UNION ALL SELECT take_id, 'take_duplicate_camera_labels', 'fail', label FROM c GROUP BY take_id, label HAVING count(*) > 1
UNION ALL SELECT DISTINCT take_id, 'take_camera_label_unknown', 'fail', label FROM c WHERE label NOT IN ('A', 'N')""")
def session_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    takes = table(spark, sf_dir, "orders").select(
        key.alias("take_id"), F.when(F.col("o_orderstatus") == "P", "other").otherwise("s").alias("session"),
        F.concat(F.lit("/takes/"), F.when(F.col("o_orderpriority") == "5-LOW", "x").otherwise(key)).alias("source_dir"), F.lit("p").alias("project"), F.lit(True).alias("loaded"),
    )
    cams = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("take_id"), F.col("l_returnflag").alias("label"))
    return rules.inspect_session(takes, cams, spark.createDataFrame([("A",), ("N",)], "angle string"), spark.createDataFrame([("s", "p")], "session string, project string"))


# ---- signals


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's events, in the order of time, as a series."""
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), index.alias("idx"), (F.col("value") / 100).alias("v"))


_SAMPLES_SQL = """
s AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value / 100 AS v FROM events),
wins AS (SELECT series, idx // 10 AS win, sqrt(avg(v * v)) AS rms, count(*) AS n FROM s GROUP BY 1, 2),
env AS (SELECT series, win, rms FROM wins WHERE n = 10 OR win = 0)
"""


@query(f"WITH {_SAMPLES_SQL} SELECT series, win, round(rms, 6) AS rms FROM env")
def rms_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.rms_envelope(_samples(spark, sf_dir), 10).withColumn("rms", r6("rms"))


@query(f"""WITH {_SAMPLES_SQL}, x AS (SELECT series, win, ln(1 + 20 * rms) AS v FROM env)
SELECT series, win, round(CASE WHEN sd < 1e-6 THEN 0 ELSE (v - mu) / sd END, 6) AS v FROM (SELECT *, avg(v) OVER (PARTITION BY series) AS mu, stddev_pop(v) OVER (PARTITION BY series) AS sd FROM x)""")
def zscore_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.signature(_samples(spark, sf_dir), 10, trim=False).select("series", "win", r6("v").alias("v"))


_TRIM_SQL = f"""
lim AS (SELECT series, greatest(0.005, quantile_cont(rms, 0.70) * 0.15) AS lim FROM env GROUP BY 1),
act AS (SELECT series, min(win) FILTER (rms >= lim) AS lo, max(win) FILTER (rms >= lim) AS hi FROM env JOIN lim USING (series) GROUP BY 1),
bounds AS (SELECT series, coalesce(greatest(0, (lo - 1) * 10), 0)::BIGINT AS first, coalesce(least(size, (hi + 2) * 10), size)::BIGINT AS last FROM (SELECT series, max(idx) + 1 AS size FROM s GROUP BY 1) LEFT JOIN act USING (series))
"""


@query(f"WITH {_SAMPLES_SQL}, {_TRIM_SQL} SELECT * FROM bounds")
def trim_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.trim_bounds(_samples(spark, sf_dir), 10).select("series", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"""WITH {_SAMPLES_SQL}, {_TRIM_SQL},
cut AS (SELECT series, idx - first AS idx, v FROM s JOIN bounds USING (series) WHERE idx >= first AND idx < last),
w2 AS (SELECT series, idx // 10 AS win, ln(1 + 20 * sqrt(avg(v * v))) AS v, count(*) AS n FROM cut GROUP BY 1, 2),
e2 AS (SELECT series, win, v FROM w2 WHERE n = 10 OR win = 0)
SELECT series, win, round(CASE WHEN sd < 1e-6 THEN 0 ELSE (v - mu) / sd END, 6) AS v FROM (SELECT *, avg(v) OVER (PARTITION BY series) AS mu, stddev_pop(v) OVER (PARTITION BY series) AS sd FROM e2)""")
def audio_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.signature(_samples(spark, sf_dir), 10, trim_window=10).select("series", "win", r6("v").alias("v"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts of types by hour, each day a session: (day, series, values)."""
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("series"), F.hour("ts").alias("win")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    filled = rows.select("day", "series").distinct().withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(23)))).join(rows, ["day", "series", "win"], "left")
    return filled.groupBy("day", "series").agg(F.sort_array(F.collect_list(F.struct("win", F.coalesce("n", F.lit(0.0)).alias("n")))).alias("x")).select("day", "series", F.transform("x", lambda r: r["n"]).alias("values"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, win, v): the days of _daily one after the other."""
    rows = _daily(spark, sf_dir).select("series", F.col("day").alias("d"), F.posexplode("values").alias("h", "v"))
    return rows.select("series", (F.row_number().over(Window.partitionBy("series").orderBy("d", "h")) - 1).alias("win"), "v")


def _day_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _daily(spark, sf_dir)
    other = rows.select("day", F.col("series").alias("other"), F.col("values").alias("v"))
    return rows.join(other, "day").where("series < other").withColumn("day", F.col("day").cast("string"))


_DAILY_SQL = """
keys AS (SELECT DISTINCT ts::DATE AS day, event_type AS series FROM events),
n AS (SELECT ts::DATE AS day, event_type AS series, hour(ts) AS h, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
f AS (SELECT k.day, k.series, t.h, coalesce(n.n, 0) AS n FROM keys k CROSS JOIN unnest(range(0, 24)) AS t(h) LEFT JOIN n ON n.day = k.day AND n.series = k.series AND n.h = t.h),
norms AS (SELECT day, series, sqrt(sum(n * n)) AS norm FROM f GROUP BY ALL)
"""


@query(f"""WITH {_DAILY_SQL},
c AS (SELECT a.day, a.series, b.series AS other, a.h - b.h AS lag, sum(a.n * b.n) AS c FROM f a JOIN f b ON a.day = b.day AND a.series < b.series GROUP BY ALL),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY day, series, other ORDER BY c DESC, lag) = 1)
SELECT b.day::VARCHAR AS day, b.series, b.other, lag, round(c / (x.norm * y.norm), 6) AS sync_confidence, round(lag / 20.0, 6) AS offset_seconds
FROM best b JOIN norms x ON x.day = b.day AND x.series = b.series JOIN norms y ON y.day = b.day AND y.series = b.other""")
def sync_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.sync_offsets(_day_pairs(spark, sf_dir), "values", "v", 29.97)
    return found.select("day", "series", "other", "lag", r6("sync_confidence").alias("sync_confidence"), r6("offset_seconds").alias("offset_seconds"))


@query(f"""WITH {_DAILY_SQL},
g AS (SELECT day, series, h - 4 AS h, n FROM f WHERE h BETWEEN 4 AND 15), gn AS (SELECT day, series, sqrt(sum(n * n)) AS norm FROM g GROUP BY ALL),
slid AS (SELECT a.day, a.series, b.series AS other, s.s, sum(a.n * b.n) AS c, sqrt(sum(a.n * a.n)) AS norm FROM f a CROSS JOIN unnest(range(0, 13)) AS s(s) JOIN g b ON a.day = b.day AND a.h = b.h + s.s AND a.series < b.series GROUP BY ALL),
best AS (SELECT slid.*, CASE WHEN slid.norm * gn.norm > 0 THEN c / (slid.norm * gn.norm) ELSE 0 END AS score FROM slid JOIN gn ON gn.day = slid.day AND gn.series = slid.other)
SELECT day::VARCHAR AS day, series, other, round(max(score), 6) AS waveform_score FROM best GROUP BY ALL""")
def ncc_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hours of one series along the day of another."""
    pairs = _day_pairs(spark, sf_dir).withColumn("v", F.slice("v", 5, 12))
    return signal.pair_similarity(pairs, "values", "v").select("day", "series", "other", r6("waveform_score").alias("waveform_score"))


@query(f"""WITH RECURSIVE {_DAILY_SQL},
t AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY day, h) - 1 AS i, n FROM f),
cut AS (SELECT series, 100 AS i0, 150 AS m FROM (SELECT DISTINCT series FROM t)),
w AS (SELECT t.series, t.i - c.i0 AS i, t.n FROM t JOIN cut c ON c.series = t.series AND t.i >= c.i0 AND t.i < c.i0 + c.m),
wn AS (SELECT series, sqrt(sum(n * n)) AS norm, max(i) + 1 AS m FROM w GROUP BY 1),
size AS (SELECT series, max(i) + 1 AS n FROM t GROUP BY 1),
lags AS (SELECT l.series, s.series AS other, unnest(range(0, l.n - s.m + 1)) AS lag FROM size l JOIN wn s ON l.series <> s.series),
slid AS (SELECT g.series, g.other, g.lag, sum(a.n * b.n) AS c, sqrt(sum(a.n * a.n)) AS norm FROM lags g JOIN w b ON b.series = g.other JOIN t a ON a.series = g.series AND a.i = b.i + g.lag GROUP BY ALL),
best AS (SELECT slid.*, CASE WHEN slid.norm > 1e-6 THEN c / (slid.norm * wn.norm) ELSE 0 END AS score FROM slid JOIN wn ON wn.series = slid.other)
SELECT series, other, round(least(1.0, score), 6) AS waveform_score, round(lag / 20.0, 6) AS estimated_offset_seconds FROM best QUALIFY row_number() OVER (PARTITION BY series, other ORDER BY round(score, 9) DESC, lag) = 1""")
def ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 hours of one type's events, from the hundredth on, along all hours of another's."""
    rows = signal.as_arrays(_hourly(spark, sf_dir))
    other = rows.select(F.col("series").alias("other"), F.slice("values", 101, 150).alias("v"))
    found = signal.pair_similarity(rows.join(other, F.col("series") != F.col("other")), "values", "v")
    return found.select("series", "other", r6("waveform_score").alias("waveform_score"), r6("estimated_offset_seconds").alias("estimated_offset_seconds"))


# ---- vectors and lanes

VECTORS_PER_SESSION = 50


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as descriptors; fifty make a session, labels are lanes."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / VECTORS_PER_SESSION).alias("session"), "vec_id", "embedding", "label").withColumn("lane", F.struct("session", "label"))


_VIEWS_SQL = f"""
e AS (SELECT vec_id // {VECTORS_PER_SESSION} AS session, vec_id, embedding::DOUBLE[] AS embedding, label FROM embeddings),
p AS (SELECT a.session, a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, greatest(-1.0, least(1.0, list_dot_product(a.embedding, b.embedding))) AS sim FROM e a JOIN e b ON a.session = b.session AND a.vec_id <> b.vec_id),
d AS (SELECT *, greatest(0.0, least(1.0, 1 - greatest(sim, 0.0))) AS d FROM p)
"""


@query(f"WITH {_VIEWS_SQL} SELECT session, a, b, round(d, 6) AS d FROM d WHERE a < b")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.distances(_views(spark, sf_dir), "session", "vec_id", "embedding").withColumn("d", r6("d"))


@query(f"WITH {_VIEWS_SQL} SELECT session, label, round(coalesce(max(d.d), 0.0), 6) AS spread FROM e LEFT JOIN d ON d.session = e.session AND d.a = e.vec_id AND d.lb = e.label GROUP BY ALL".replace("SELECT session, label", "SELECT e.session, e.label"))
def lane_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.spread(_views(spark, sf_dir), "lane", "vec_id", "embedding").select("lane.session", "lane.label", r6("spread").alias("spread"))


@query(f"""WITH {_VIEWS_SQL}, m AS (SELECT session, label, pos, avg(x) AS mean FROM (SELECT session, label, unnest(range(0, 64)) AS pos, unnest(embedding) AS x FROM e) GROUP BY ALL),
n AS (SELECT session, label, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY ALL)
SELECT session, label, pos::INT AS pos, round(CASE WHEN norm < 1e-6 THEN 0 ELSE mean / norm END, 6) AS x FROM m JOIN n USING (session, label)""")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroids(_views(spark, sf_dir), "lane", "embedding").select("lane.session", "lane.label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", r6("x"))


@query(f"""WITH {_VIEWS_SQL}, g AS (SELECT session, a, la, lb, avg(d) AS d FROM d GROUP BY ALL),
ab AS (SELECT session, a, max(d) FILTER (la = lb) AS x, min(d) FILTER (la <> lb) AS y FROM g GROUP BY ALL)
SELECT session, round(avg(CASE WHEN x IS NULL OR y IS NULL OR greatest(x, y) < 1e-6 THEN 0 ELSE (y - x) / greatest(x, y) END), 6) AS silhouette FROM ab GROUP BY 1""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.silhouette(_views(spark, sf_dir), "vec_id", "label", "embedding", "session").withColumn("silhouette", r6("silhouette"))


@query(f"""WITH RECURSIVE {_VIEWS_SQL},
s AS (SELECT session, count(*) OVER (PARTITION BY session) AS n, vec_id, vec_id AS c FROM e
UNION ALL SELECT s.session, s.n - 1, s.vec_id, CASE WHEN s.c = m.b THEN m.a ELSE s.c END
FROM s JOIN (SELECT * FROM (SELECT x.session, x.c AS a, y.c AS b, avg(d.d) AS mean FROM s x JOIN s y ON y.session = x.session AND x.c < y.c JOIN d ON d.session = x.session AND d.a = x.vec_id AND d.b = y.vec_id
             GROUP BY x.session, x.c, y.c) QUALIFY row_number() OVER (PARTITION BY session ORDER BY mean, a, b) = 1) m ON m.session = s.session)
SELECT session, n::INT AS lane_count, vec_id, dense_rank() OVER (PARTITION BY session, n ORDER BY c)::INT AS lane FROM s WHERE n <= {grouping.MAX_LANES}""")
def linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.lanes(_views(spark, sf_dir), "session", "vec_id", "embedding", list(range(1, grouping.MAX_LANES + 1)))


WAVEFORM = 0.8


def _lane_media(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' orders as audios, their line items as videos, line numbers as lanes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.format_string("a-%09d", "o_orderkey").alias("audio"), (F.col("o_totalprice") / 1000).alias("audio_s"), "o_orderkey")
    items = table(spark, sf_dir, "lineitem").join(orders.select("session", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "session", F.col("l_linenumber").alias("lane"), F.format_string("v-%09d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("video"), (F.col("l_extendedprice") / 200).alias("video_s"),
    )
    return orders.drop("o_orderkey"), items


@query()
def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = _lane_media(spark, sf_dir)
    return assign.assign_near(orders, items, WAVEFORM, "session").withColumn("pair_score", r6("pair_score"))


@query("""WITH RECURSIVE a AS (SELECT o_custkey * 10000 + year(o_orderdate) AS session, o_orderkey AS audio, o_totalprice / 1000 AS audio_s FROM orders),
v AS (SELECT o_custkey * 10000 + year(o_orderdate) AS session, l_linenumber AS lane, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k, l_extendedprice / 200 AS video_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT session, audio, audio_s, row_number() OVER (PARTITION BY session ORDER BY audio) - 1 AS bit FROM a),
gaps AS (SELECT v.session, lane, k, bit, audio_s - video_s AS delta FROM v JOIN w ON w.session = v.session),
costs AS (SELECT session, lane, k, 1 << bit::INT AS used, 1 - (0.65 * CASE WHEN abs(delta) > 240 THEN 0 WHEN delta BETWEEN -45 AND 75 THEN 1 - least(abs(delta) / 120, 0.35)
          ELSE greatest(0.0, 0.65 - (CASE WHEN delta > 75 THEN delta - 75 ELSE abs(delta) - 45 END) / 120) END + 0.35 * 0.8) AS cost FROM gaps),
choices AS (SELECT * FROM costs UNION ALL SELECT session, lane, k, 0, 0.6 FROM v),
best AS (SELECT session, lane, 0::BIGINT AS k, 0 AS used, 0.0::DOUBLE AS cost FROM v GROUP BY session, lane
UNION ALL SELECT b.session, b.lane, c.k, b.used | c.used, min(b.cost + c.cost) FROM best b JOIN choices c ON c.session = b.session AND c.lane = b.lane AND c.k = b.k + 1 AND b.used & c.used = 0 GROUP BY ALL),
n AS (SELECT session, lane, max(k) AS videos FROM v GROUP BY ALL)
SELECT b.session, b.lane, n.videos, round(min(cost) * 48e6)::BIGINT AS cost FROM best b JOIN n ON n.session = b.session AND n.lane = b.lane AND n.videos = b.k GROUP BY ALL""")
def lane_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best assignment of each lane costs in all, a customer's year being a session: the same for all best ones.

    In parts of which each pair's cost is a whole number. The SQL goes through the sets of
    audios that are used so far, video by video.
    """
    year = lambda c: F.col(c) * 10000
    orders = table(spark, sf_dir, "orders").select((year("o_custkey") + F.year("o_orderdate")).alias("session"), F.col("o_orderkey").alias("audio"), (F.col("o_totalprice") / 1000).alias("audio_s"), F.col("o_orderkey").alias("l_orderkey"))
    item = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    items = table(spark, sf_dir, "lineitem").join(orders.select("session", "l_orderkey"), "l_orderkey").select("session", F.col("l_linenumber").alias("lane"), item.alias("item"), (F.col("l_extendedprice") / 200).alias("video_s"))
    number = F.row_number().over(Window.partitionBy("session", "lane").orderBy("item"))
    items = items.withColumn("video", number).drop("item")
    rows = assign.assign_near(orders.drop("l_orderkey"), items, WAVEFORM, "session", costs=True)
    return assign.lane_costs(rows, "session").select("session", "lane", "videos", F.round(F.col("cost") * 48e6).cast("long").alias("cost"))


AUDIOS_PER_SESSION = 5


def _plan_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions of embeddings as videos; five suppliers in turn for each session as audios, as long as their balances say.

    How alike the sound of a pair is comes from the product of its keys, so that no two
    assignments are equally good.
    """
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.count()
    views = _views(spark, sf_dir)
    videos = views.select("session", "vec_id", F.format_string("v-%09d", "vec_id").alias("video"), F.col("embedding").alias("descriptor"), (F.lit(200.0) + F.col("vec_id") % 97).alias("video_s"))
    slots = views.select("session").distinct().withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(AUDIOS_PER_SESSION - 1))))
    slots = slots.select("session", ((F.col("session") * AUDIOS_PER_SESSION + F.col("turn")) % n).cast("long").alias("s_suppkey"))
    audios = slots.join(suppliers, "s_suppkey").select("session", "s_suppkey", F.format_string("a-%09d", "s_suppkey").alias("audio"), (F.lit(200.0) + F.col("s_acctbal") / 50).alias("audio_s"))
    near = matching.near_pairs(audios, videos, "session")
    waveform = (F.col("vec_id") + 17) * (F.col("s_suppkey") + 31) * 7919 % 100_003 / 100_003.0
    pairs = near.select("session", "video", "audio", S.pair_score(F.col("duration_score"), waveform).alias("pair_score"))
    return audios.select("session", "audio"), videos.select("session", "video", "descriptor"), pairs


_PLAN_CHOICE_SQL = f"""{_VIEWS_SQL},
s AS (SELECT session, count(*) OVER (PARTITION BY session) AS n, vec_id, vec_id AS c FROM e
UNION ALL SELECT s.session, s.n - 1, s.vec_id, CASE WHEN s.c = m.b THEN m.a ELSE s.c END
FROM s JOIN (SELECT * FROM (SELECT x.session, x.c AS a, y.c AS b, avg(d.d) AS mean FROM s x JOIN s y ON y.session = x.session AND x.c < y.c JOIN d ON d.session = x.session AND d.a = x.vec_id AND d.b = y.vec_id
             GROUP BY x.session, x.c, y.c) QUALIFY row_number() OVER (PARTITION BY session ORDER BY mean, a, b) = 1) m ON m.session = s.session),
lanes AS (SELECT session, n AS k, vec_id, c AS lane, row_number() OVER (PARTITION BY session, n, c ORDER BY vec_id) AS i FROM s WHERE n <= {grouping.MAX_LANES}),
au AS (SELECT session, s_suppkey AS au, row_number() OVER (PARTITION BY session ORDER BY s_suppkey) - 1 AS bit, 200 + s_acctbal / 50 AS audio_s
  FROM (SELECT DISTINCT session, (session * {AUDIOS_PER_SESSION} + unnest(range(0, {AUDIOS_PER_SESSION}))) % (SELECT count(*) FROM supplier) AS key FROM (SELECT DISTINCT session FROM e)) JOIN supplier ON s_suppkey = key),
gap AS (SELECT e.session, vec_id, au, bit, audio_s - (200.0 + vec_id % 97) AS delta, (vec_id + 17) * (au + 31) * 7919 % 100003 / 100003.0 AS wave FROM e JOIN au ON au.session = e.session),
pr AS (SELECT session, vec_id, au, bit, greatest(0.0, least(1.0, 0.65 * CASE WHEN abs(delta) > 240 THEN 0 WHEN delta BETWEEN -45 AND 75 THEN 1 - least(abs(delta) / 120, 0.35)
  ELSE greatest(0.0, 0.65 - (CASE WHEN delta > 75 THEN delta - 75 ELSE abs(delta) - 45 END) / 120) END + 0.35 * wave)) AS score FROM gap),
choices AS (SELECT l.session, l.k, l.lane, l.i, 1 << bit::INT AS used, bit::INT AS bit, 1 - score AS cost FROM lanes l JOIN pr ON pr.session = l.session AND pr.vec_id = l.vec_id UNION ALL SELECT session, k, lane, i, 0, -1, 0.6 FROM lanes),
best AS (SELECT DISTINCT session, k, lane, 0::BIGINT AS i, 0 AS used, 0.0::DOUBLE AS cost, []::INT[] AS path FROM lanes
UNION ALL SELECT b.session, b.k, b.lane, c.i, b.used | c.used, min(b.cost + c.cost), arg_min(list_append(b.path, c.bit), b.cost + c.cost)
  FROM best b JOIN choices c ON c.session = b.session AND c.k = b.k AND c.lane = b.lane AND c.i = b.i + 1 AND b.used & c.used = 0 GROUP BY b.session, b.k, b.lane, c.i, b.used | c.used),
sizes AS (SELECT session, k, lane, count(*) AS size, min(vec_id) AS first FROM lanes GROUP BY ALL),
solved AS (SELECT z.session, z.k, z.lane, arg_min(path, cost) AS path FROM sizes z JOIN best b ON b.session = z.session AND b.k = z.k AND b.lane = z.lane AND b.i = z.size GROUP BY ALL),
tops AS (SELECT session, vec_id, max(score) AS top FROM pr GROUP BY ALL),
got AS (SELECT l.session, l.k, l.lane, l.vec_id, CASE WHEN pr.score >= 0.56 THEN pr.au END AS au, coalesce(pr.score, top) AS score FROM lanes l JOIN solved v ON v.session = l.session AND v.k = l.k AND v.lane = l.lane
  JOIN tops ON tops.session = l.session AND tops.vec_id = l.vec_id LEFT JOIN pr ON pr.session = l.session AND pr.vec_id = l.vec_id AND pr.bit = v.path[l.i]),
takes AS (SELECT session, k, au, count(*) AS n, avg(score) AS conf, count(*) BETWEEN 1 AND 8 AND avg(score) >= 0.60 AS good FROM got WHERE au IS NOT NULL GROUP BY ALL),
tk AS (SELECT session, k, count(*) FILTER (n BETWEEN 3 AND 4 AND conf >= 0.60) AS production, count(*) FILTER (NOT (n BETWEEN 3 AND 4 AND conf >= 0.60)) AS partial, count(*) FILTER (good) AS takes,
  coalesce(sum(n + 1) FILTER (NOT good AND NOT (n <= 2 AND conf < 0.60)), 0) AS unresolved FROM takes GROUP BY ALL),
gt AS (SELECT session, k, coalesce(avg(score) FILTER (au IS NOT NULL), 0) AS average, count(*) FILTER (au IS NULL) AS unassigned, count(*) FILTER (au IS NULL AND score >= 0.56) AS loose FROM got GROUP BY ALL),
far AS (SELECT x.session, x.k, x.lane, max(d.d) AS spread FROM lanes x JOIN lanes y ON y.session = x.session AND y.k = x.k AND y.lane = x.lane JOIN d ON d.session = x.session AND d.a = x.vec_id AND d.b = y.vec_id GROUP BY ALL),
ln AS (SELECT z.session, z.k, count(*) AS lanes, count(*) FILTER (size = 1) AS single, sum(greatest(0, size - (SELECT count(*) FROM au WHERE au.session = z.session))) AS oversize, sum(greatest(0.0, coalesce(spread, 0) - 0.28)) AS spread FROM sizes z LEFT JOIN far ON far.session = z.session AND far.k = z.k AND far.lane = z.lane GROUP BY ALL),
near AS (SELECT x.session, x.k, x.vec_id, x.lane AS own, y.lane AS other, avg(d.d) AS d FROM lanes x JOIN lanes y ON y.session = x.session AND y.k = x.k JOIN d ON d.session = x.session AND d.a = x.vec_id AND d.b = y.vec_id GROUP BY ALL),
ab AS (SELECT session, k, vec_id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM near GROUP BY ALL),
sil AS (SELECT session, k, avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) < 1e-6 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY ALL),
ms AS (SELECT ln.session, ln.k, 3.0 * coalesce(production, 0) + average + 0.8 * coalesce(silhouette, 0) - 1.8 * coalesce(partial, 0) - 1.6 * (coalesce(unresolved, 0) + loose) - 0.4 * unassigned - 0.35 * single - 0.15 * oversize - 1.2 * spread - 0.06 * lanes AS objective,
  coalesce(takes, 0) AS production, coalesce(unresolved, 0) + loose AS unresolved, coalesce(silhouette, 0) AS silhouette FROM ln JOIN gt ON gt.session = ln.session AND gt.k = ln.k LEFT JOIN tk ON tk.session = ln.session AND tk.k = ln.k LEFT JOIN sil ON sil.session = ln.session AND sil.k = ln.k),
fold AS (SELECT session, k, k AS chosen, objective, production, unresolved FROM ms WHERE k = 1
UNION ALL SELECT m.session, m.k, CASE WHEN better THEN m.k ELSE m.chosen END, CASE WHEN better THEN m.objective ELSE m.o END, CASE WHEN better THEN m.production ELSE m.p END, CASE WHEN better THEN m.unresolved ELSE m.u END
  FROM (SELECT m.*, f.chosen, f.objective AS o, f.production AS p, f.unresolved AS u, m.objective > f.objective + 1e-6 OR (m.objective >= f.objective - 0.15 AND m.unresolved <= f.unresolved AND m.production >= f.production) AS better
        FROM fold f JOIN ms m ON m.session = f.session AND m.k = f.k + 1) m),
picked AS (SELECT session, arg_max(chosen, k) AS k FROM fold GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_PLAN_CHOICE_SQL}
SELECT ms.session, ms.k::INT AS lane_count, round(objective, 6) AS objective, production, unresolved, round(silhouette, 6) AS silhouette, picked.k IS NOT NULL AS chosen FROM ms LEFT JOIN picked ON picked.session = ms.session AND picked.k = ms.k""")
def model_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.candidates(*_plan_inputs(spark, sf_dir)).measures
    chosen = grouping.choose(found).withColumn("chosen", F.lit(True))
    return found.join(chosen, ["session", "lane_count"], "left").select("session", "lane_count", r6("objective").alias("objective"), "production", "unresolved", r6("silhouette").alias("silhouette"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(f"""WITH RECURSIVE {_PLAN_CHOICE_SQL},
own AS (SELECT z.session, z.lane, 'angle-' || chr((96 + row_number() OVER (PARTITION BY z.session ORDER BY first))::INT) AS label FROM sizes z JOIN picked ON picked.session = z.session AND picked.k = z.k),
t AS (SELECT takes.session, au, conf, printf('take-%02d', row_number() OVER (PARTITION BY takes.session ORDER BY au)) AS take_id FROM takes JOIN picked ON picked.session = takes.session AND picked.k = takes.k WHERE good)
SELECT t.session, take_id, printf('a-%09d', t.au) AS audio, printf('v-%09d', vec_id) AS video, label, round(score, 4) AS pair_score, round(conf, 4) AS confidence, CASE WHEN conf < 0.72 THEN 'take confidence is low for a production take' END AS note
FROM t JOIN picked ON picked.session = t.session JOIN got ON got.session = t.session AND got.k = picked.k AND got.au = t.au JOIN own ON own.session = t.session AND own.lane = got.lane""")
def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.plan(*_plan_inputs(spark, sf_dir))[0]


#: A frame takes milliseconds but 64 bytes, so frames are dealt to tasks by their number, not by their bytes.
FRAMES_PER_TASK = 1000


@query()
def view_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as grey frames of 8 x 8, one for each video; their descriptors make the lanes."""
    level = lambda x: F.least(F.lit(127), F.greatest(F.lit(-128), F.floor(x * 400))).cast("tinyint")
    rows = table(spark, sf_dir, "embeddings")
    frames = rows.repartition(rows.count() // FRAMES_PER_TASK + 1).select(F.col("vec_id").alias("video"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", level).alias("grey"))
    found = views.descriptors(frames).withColumn("session", F.floor(F.col("video") / VECTORS_PER_SESSION))
    return clusters.lanes(found, "session", "video", "descriptor", list(range(1, grouping.MAX_LANES + 1)))


# ---- pixels


_PIXEL_SQL = "px AS (SELECT vec_id, least(1.0, greatest(0.0, embedding[1]::DOUBLE * 2 + 0.5)) AS r, least(1.0, greatest(0.0, embedding[2]::DOUBLE * 2 + 0.5)) AS g, least(1.0, greatest(0.0, embedding[3]::DOUBLE * 2 + 0.5)) AS b FROM embeddings)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("embedding")[i].cast("double") * 2 + 0.5))
    return table(spark, sf_dir, "embeddings").select("vec_id", one(0).alias("r"), one(1).alias("g"), one(2).alias("b"))


def _linear_sql(c: str) -> str:
    return f"CASE WHEN {c} <= 0.5 THEN {c} * {c} / 3 ELSE (exp(({c} - {color.HLG_C}) / {color.HLG_A}) + {color.HLG_B}) / 12 END AS {c}"


def _curve_sql(c: str) -> str:
    m = color.TO_709["rgb".index(c)]
    x = f"least(1.0, greatest(0.0, {m[0]} * r + {m[1]} * g + {m[2]} * b))"
    return f"floor(least(1.0, greatest(0.0, CASE WHEN {x} < 0.018 THEN 4.5 * {x} ELSE 1.099 * pow(greatest({x}, 0.018), 0.45) - 0.099 END)) * 255)::INT AS {c}"


@query(f"WITH {_PIXEL_SQL}, lin AS (SELECT vec_id, {', '.join(map(_linear_sql, 'rgb'))} FROM px) SELECT vec_id, {', '.join(map(_curve_sql, 'rgb'))} FROM lin")
def hlg_709(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = color.display_rgb(F.col("r"), F.col("g"), F.col("b"), F.lit("arib-std-b67"), F.lit("bt2020"))
    return _pixels(spark, sf_dir).select("vec_id", *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))


_CDL = {"r": (1.1, 0.0), "g": (0.5, 0.1), "b": (2.0, -0.1)}


@query(f"""WITH {_PIXEL_SQL} SELECT vec_id, {', '.join(f"floor(least(1.0, greatest(0.0, floor({c} * 255) / 255 * {s}::DOUBLE + {o}::DOUBLE)) * 255 + 1e-9)::INT AS {c}" for c, (s, o) in _CDL.items())} FROM px""")
def cdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("vec_id", *(color.cdl(F.floor(F.col(c) * 255), s, o).alias(c) for c, (s, o) in _CDL.items()))


@query("""WITH g AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS col, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS row FROM orders)
SELECT o_custkey, o_orderkey, (42 + col * 80)::BIGINT AS x, (24 + row * 68)::BIGINT AS y FROM g""")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").withColumn("col", F.row_number().over(sheet.orderBy("o_orderkey")) - 1).withColumn("row", F.dense_rank().over(sheet.orderBy("o_orderpriority")) - 1)
    x, y = color.cell_origin(F.col("row"), F.col("col"))
    return rows.select("o_custkey", "o_orderkey", x.cast("long").alias("x"), y.cast("long").alias("y"))


# ---- scalars


@query(r"""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') || ' - ' || o_orderpriority WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderpriority
WHEN 2 THEN o_orderpriority || ' ' || strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN 'take ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'x' || o_orderpriority END AS name FROM orders)
SELECT o_orderkey, name, CASE WHEN o_orderkey % 5 = 4 THEN '2024-01-01' ELSE regexp_replace(regexp_extract(name, '([0-9]{4}-?[0-9]{2}-?[0-9]{2})', 1), '^([0-9]{4})-?([0-9]{2})-?([0-9]{2})$', '\1-\2-\3') END AS date,
CASE WHEN o_orderkey % 5 = 4 THEN name ELSE trim(regexp_replace(name, '[0-9]{4}-?[0-9]{2}-?[0-9]{2}', ''), ' -_') END AS title FROM n""")
def date_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    compact, dashed = F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(k == 0, F.concat(compact, F.lit(" - "), p)).when(k == 1, F.concat(dashed, F.lit("_"), p)).when(k == 2, F.concat(p, F.lit(" "), compact)).when(k == 3, F.concat(F.lit("take "), dashed)).otherwise(F.concat(F.lit("x"), p))
    date, title = S.date_and_title(F.col("name"), F.lit("2024-01-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).select("o_orderkey", "name", date.alias("date"), title.alias("title"))


@query("""SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN p_size * 1000.0 / 1001 WHEN 1 THEN 0 WHEN 2 THEN p_size / 2.0 ELSE p_size + 0.5 END, 6) AS rate FROM part""")
def frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    raw = F.when(n % 4 == 0, F.concat((n * 1000).cast("string"), F.lit("/1001"))).when(n % 4 == 1, "0/0").when(n % 4 == 2, F.concat(n.cast("string"), F.lit("/2"))).otherwise(F.concat(n.cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "part").select("p_partkey", r6(S.frame_rate(raw)).alias("rate"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_size + 1 WHEN 1 THEN 10 WHEN 2 THEN 8 WHEN 3 THEN 24 ELSE 0 END::INT AS bits FROM part""")
def bit_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    bits = F.when(k == 0, (F.col("p_size") + 1).cast("string")).otherwise("0")
    fmt = F.when(k == 1, "yuv420p10le").when(k == 2, "yuv420p").otherwise("bayer")
    return table(spark, sf_dir, "part").select("p_partkey", S.bit_depth(bits, F.when(k == 3, "24"), fmt).alias("bits"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, CASE WHEN l_linenumber % 3 = 0 THEN floor(l_quantity)::BIGINT
WHEN l_linenumber % 3 = 1 THEN (round_even(floor(l_quantity) * 25.0, 0) + l_linenumber)::BIGINT ELSE round_even(l_extendedprice * 25.0, 0)::BIGINT END) AS frames FROM lineitem""")
def timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("l_linenumber") % 3, F.floor("l_quantity").cast("int")
    frames = F.when(k == 0, q.cast("string"))
    text = F.when(k == 1, F.format_string("00:00:%02d;%02d", q, "l_linenumber")).otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.clip_frames(frames, text, F.lit(25.0)).alias("frames"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'reuse-source' WHEN o_orderpriority = '5-LOW' THEN 'generate' WHEN o_totalprice > 200000 THEN 'reuse-existing' ELSE 'regenerate' END AS action FROM orders""")
def edit_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = S.needs_edit_proxy(F.lit(48000), F.lit("pcm_s24le"), F.when(F.col("o_orderstatus") == "F", 24).otherwise(16))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.edit_audio_action(needed, F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 200000, False).alias("action"))


@query("""SELECT p_partkey, 'angle-' || CASE WHEN p_size < 26 THEN chr((97 + p_size)::INT) ELSE chr((96 + p_size // 26)::INT) || chr((97 + p_size % 26)::INT) END AS label FROM part""")
def group_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.group_label(F.col("p_size")).alias("label"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, string_split(path, '/')[-1] AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, lower(regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]+)$', 1)) AS suffix FROM p""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path")).select("page_id", "path", S.path_name(path).alias("name"), S.path_parent(path).alias("parent"), S.path_suffix(path).alias("suffix"))


@query("""SELECT n_nationkey, n_name AS name, '/vol/' || n_regionkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'DISK' ELSE 'NET' END AS kind FROM nation WHERE n_nationkey % 5 <> 0""")
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    line = F.concat_ws(":", F.when(k % 5 == 0, F.concat(F.lit("#"), "n_name")).otherwise(F.col("n_name")), F.concat(F.lit("/vol/"), "n_regionkey"), F.lit("*"), F.when(k % 2 == 0, "DISK").otherwise("NET"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", line.alias("value"))
    parsed = media.records(rows.select("value"))
    return rows.select("n_nationkey", F.substring_index("value", ":", 1).alias("name")).join(parsed, "name").select("n_nationkey", "name", "path", "kind")


@query("""WITH f AS (SELECT o_custkey AS take_id, CASE WHEN o_orderkey % 23 = 0 THEN 'Audio.WAV' ELSE 'o' || o_orderkey || '.wav' END AS name, floor(o_totalprice)::BIGINT AS n FROM orders)
SELECT take_id, name AS master_audio FROM f QUALIFY row_number() OVER (PARTITION BY take_id ORDER BY CASE WHEN name = 'Audio.WAV' THEN 0 ELSE 1 END, n DESC, name) = 1""")
def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("take_id"), F.when(F.col("o_orderkey") % 23 == 0, "Audio.WAV").otherwise(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".wav"))).alias("name"), F.lit(".wav").alias("suffix"), F.floor("o_totalprice").alias("length"))
    return media.masters(files)


@query("""SELECT conv_id AS take_id, 'a' || conv_id AS edit_audio, string_agg(role || '=' || turn, ',' ORDER BY turn, role) AS cameras FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY 1""")
def handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("take_id"), F.col("turn").alias("pos"), F.col("role").alias("label"), F.col("turn").cast("string").alias("file")).distinct()
    takes = rows.select("take_id").distinct().select("take_id", F.concat(F.lit("a"), "take_id").alias("master_audio"), F.lit(None).cast("string").alias("edit_audio"))
    out = sinks.handoff(takes, rows)
    return out.select("take_id", "edit_audio", F.array_join(F.transform("cameras", lambda c: F.concat_ws("=", c["label"], c["file"])), ",").alias("cameras"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))

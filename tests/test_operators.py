"""Goldens, hand values and brute-force versions of the session operators."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from cadenza import storage
from cadenza.functions import color, vectors, views
from cadenza.functions import scalars as S
from cadenza.operators import assign, clusters, coverage, graph, layout, matching, order, rules, signal
from cadenza.plans import grouping
from cadenza.sources import media, sinks
from cadenza.streaming import events as stream
from pyspark.sql import functions as F


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, " + kind)
    return [r[0] for r in rows.orderBy("i").select(f).collect()]


# ---- scalars


def test_parsing(spark):
    lit = F.lit
    assert column(spark, ["30000/1001", "25", "0/0", "", None, "5/0", "x"], "x string", F.round(S.frame_rate(F.col("x")), 6)) == [29.97003, 25.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert one(spark, *(S.bit_depth(lit(a), lit(b), lit(c)) for a, b, c in (("0", "", "yuv420p10le"), ("24", "16", ""), (None, "16", "x"), (None, None, "yuv420p"), (None, None, "")))) == (10, 24, 16, 8, 0)
    assert one(spark, *(S.clip_frames(lit(a), lit(b), lit(25.0)) for a, b in (("7.9", None), (None, "00:00:02:03"), ("", "00:01:00;05"), (None, "1.5"), (None, None), ("0", None)))) == (7, 53, 1505, 38, 1, 1)
    names = ["20240102 A", "2024-01-02_B-", "C-20240102", "D 2024-01-02", "E", "20249999", "x20240102y"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", *(c.alias(a) for c, a in zip(S.date_and_title(F.col("n"), lit("T")), "dt"))).collect()
    assert [(r.d, r.t) for r in got] == [("2024-01-02", "A"), ("2024-01-02", "B"), ("2024-01-02", "C"), ("2024-01-02", "D"), ("T", "E"), ("2024-99-99", "20249999"), ("T", "x20240102y")]
    assert one(spark, *(S.group_label(lit(i)) for i in (0, 25, 26, 27, 52))) == ("angle-a", "angle-z", "angle-aa", "angle-ab", "angle-ba")
    assert one(spark, S.project_name(lit(" a/b::c ")), S.project_name(lit(" ")), S.session_root(lit("/x/takes/t1")), S.session_root(lit("/x/t1"))) == ("a_b_c", "recording-session", "/x", None)
    assert one(spark, S.sample_count(lit(480), lit("1/48000"), lit(48000), lit(9.0)), S.sample_count(lit(None).cast("long"), lit(""), lit(48000), lit(0.5))) == (480, 24000)
    assert one(spark, S.path_stem(lit("/a/b.c.mp4")), S.path_suffix(lit("/a/b.C.MP4")), S.path_parent(lit("/a/b.mp4")), S.path_stem(lit(".hidden")), S.markdown_value(lit("a|b\nc"))) == ("b.c", ".mp4", "/a", ".hidden", "a\\|b c")
    assert one(spark, S.triple(lit("1, 2,3"))) == ([1.0, 2.0, 3.0],)
    with pytest.raises(Exception, match="three values"):
        one(spark, S.triple(lit("1,2")))


def test_scores(spark):
    want = {-240.1: 0.0, -240.0: 0.0, -45.1: 0.65 - 0.1 / 120, -45.0: 0.65, 0.0: 1.0, 36.0: 0.7, 75.0: 0.65, 75.1: 0.65 - 0.1 / 120, 240.0: 0.0, 240.1: 0.0}
    got = column(spark, [(d + 300, 300.0) for d in want], "a double, v double", S.duration_score(F.col("a"), F.col("v"))[0])
    assert all(math.isclose(g, w, abs_tol=1e-9) for g, w in zip(got, want.values()))
    assert one(spark, *(S.is_production_take(F.lit(n), F.lit(c)) for n, c in ((1, 0.7), (0, 0.7), (1, 0.5), (9, 0.9), (0, float("nan")), (0, None)))) == (True, False, False, False, False, False)
    assert one(spark, *(S.order_confidence(F.lit(n)) for n in range(4))) == ("none", "low", "medium", "high")
    assert one(spark, *(S.edit_audio_action(F.lit(a), F.lit(b), F.lit(c), d) for a, b, c, d in ((False, True, True, False), (True, False, False, False), (True, True, True, True), (True, True, False, False), (True, True, False, True)))) == (
        "reuse-source", "generate", "reuse-existing", "regenerate", "would-generate")


def test_pixels(spark):
    px = [(100, 150, 200), (10, 20, 30)]
    slope, offset = (1.1, 0.5, 2.0), (0.0, 0.1, -0.1)
    got = [[column(spark, [p[i] for p in px], "x int", color.cdl(F.col("x"), slope[i], offset[i]))[k] for i in range(3)] for k in range(2)]
    assert got == [[int(np.clip(p[i] / 255 * slope[i] + offset[i], 0, 1) * 255 + 1e-9) for i in range(3)] for p in px]
    assert one(spark, *color.display_rgb(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit("bt709"), F.lit("bt709"))) == (127, 127, 127)
    assert one(spark, *color.cell_origin(F.lit(2), F.lit(3))) == (282, 160)
    assert one(spark, *color.fit(F.lit(1920), F.lit(1080), 80, 50)) == (80, 45)
    assert one(spark, F.round(vectors.cosine(F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(1.0), F.lit(0.0))), 9), vectors.distance(F.array(F.lit(1.0)), F.array(F.lit(-1.0)))) == (0.6, 1.0)


# ---- order


def _evidence(spark, times):
    rows = [(t, g, "audio" if g == "audio-master" else "video", f"{t}/{g}", float(ts)) for (t, g), ts in times.items()]
    return spark.createDataFrame(rows, "take_id string, grp string, media_type string, source string, ts double"), spark.createDataFrame(sorted({(t,) for t, _ in times} | {("t9",)} if any(t == "t8" for t, _ in times) else {(t,) for t, _ in times}), "take_id string")


def test_take_order(spark):
    times = {(t, g): ts for t, ts in (("take-02", 1000), ("take-03", 2000), ("take-01", 3000)) for g in ("audio-master", "angle-a", "angle-b")}
    rows = order.take_order(*_evidence(spark, times)).orderBy("position").collect()
    assert [(r.take_id, r.confidence) for r in rows] == [("take-02", "high"), ("take-03", "high"), ("take-01", "high")]


def test_take_order_by_audio_where_setups_differ(spark):
    times = {("a", "audio-master"): 3, ("b", "audio-master"): 2, ("c", "audio-master"): 1, ("a", "x"): 1, ("b", "x"): 2, ("b", "y"): 1, ("c", "y"): 2, ("c", "alone"): 5}
    rows = order.take_order(*_evidence(spark, times)).orderBy("position").collect()
    assert [r.take_id for r in rows] == ["c", "b", "a"] and [r.evidence_groups for r in rows] == [2, 3, 2]
    del times["a", "audio-master"]
    rows = order.take_order(*_evidence(spark, times)).orderBy("position").collect()
    assert [r.take_id for r in rows] == ["a", "c", "b"]  # 0, (0 + 1) / 2, (1 + 1 + 0) / 3


def test_take_without_evidence(spark):
    rows = order.take_order(*_evidence(spark, {("t1", "x"): 1, ("t2", "x"): 2, ("t8", "y"): 1})).orderBy("position").collect()
    assert [(r.take_id, r.average_rank, r.confidence) for r in rows][2:] == [("t8", 999.0, "none"), ("t9", 999.0, "none")]


# ---- layout


def test_layout_golden(spark):
    takes = spark.createDataFrame([("s", "take-01", 130), ("s", "take-02", 130)], "session string, take_id string, audio_frames long")
    clips = spark.createDataFrame([("s", "take-01", "b", "b.mp4", 0, 100), ("s", "take-01", "c", "c.mp4", 10, 110), ("s", "take-02", "b", "b.mp4", 0, 100), ("s", "take-02", "d", "d.mp4", -5, 110)], "session string, take_id string, label string, file string, offset long, frames long")
    laid = layout.timeline(layout.take_segments(takes, clips), layout.gap_frames(29.97))
    rows = laid.orderBy("take_id").collect()
    assert [(r.record, r.marker, r["shift"]) for r in rows] == [(0, 0, 0), (280, 285, 5)]
    placed = layout.placed_clips(laid, clips, spark.createDataFrame([("b", 0), ("c", 1), ("d", 2)], "angle string, pos int"))
    assert {(r.take_id, r.label, r.track, r.start) for r in placed.collect()} == {("take-01", "b", 1, 0), ("take-01", "c", 2, 10), ("take-02", "b", 1, 285), ("take-02", "d", 2, 280)}
    names = layout.track_names(spark.createDataFrame([("s", 2)], "session string, tracks int")).collect()
    assert [(r.kind, r["index"], r.name) for r in names] == [("video", 1, "compact-v1"), ("video", 2, "compact-v2"), ("audio", 1, "master-audio"), ("audio", 2, "scratch-compact-v1"), ("audio", 3, "scratch-compact-v2")]


def test_layout_check_by_place_and_by_start(spark):
    want = spark.createDataFrame([("1", "t1", "a", 0), ("1", "t2", "b", 10), ("1", "t3", "c", 20)], "track string, take_id string, name string, start long")
    have = want.where("take_id <> 't2'").drop("take_id")
    assert layout.verify(want, want.drop("take_id")).count() == 0
    assert {(r.take_id, r.difference) for r in layout.verify(want, have).collect()} == {("t2", "name"), ("t3", "missing")}
    assert [r.take_id for r in layout.verify(want, have, by_start=True).collect()] == ["t2"]


# ---- signals


def test_sync_offsets(spark):
    impulse = lambda n, at: [1.0 if i == at else 0.0 for i in range(n)]
    pairs = spark.createDataFrame([("x", impulse(30, 10), impulse(20, 7)), ("y", impulse(30, 10), impulse(20, 12)), ("z", impulse(5, 2), [0.0] * 4)], "k string, m array<double>, o array<double>")
    rows = {r.k: r for r in signal.sync_offsets(pairs, "m", "o", 20.0).collect()}
    assert [rows[k].offset_frames for k in "xyz"] == [3, -2, 0] and abs(rows["x"].sync_confidence - 1) < 1e-6


def test_correlations_equal_direct_sums():
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (30, 7), (3, 40), (1, 1)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        full = np.correlate(a, b, "full")
        lag, conf, *_ = signal.sync_lag(a, b, 20.0)
        assert lag == int(np.argmax(full)) - (m - 1) and math.isclose(conf, full.max() / np.sqrt((a @ a) * (b @ b)), abs_tol=1e-9)
        s, l = (a, b) if n <= m else (b, a)
        scores = [s @ l[i : i + len(s)] / (np.linalg.norm(s) * np.linalg.norm(l[i : i + len(s)])) for i in range(len(l) - len(s) + 1)]
        got = signal.sliding_similarity(a, b)
        assert math.isclose(got[0], max(0, max(scores)), abs_tol=1e-9) and got[1] == int(np.argmax(scores)) / 20
    assert signal.sliding_similarity(np.zeros(3), np.ones(5)) == (0.0, 0.0) == signal.sliding_similarity(np.zeros(0), np.ones(2))


def test_envelopes(spark):
    series = {"short": [1.0, 1.0], "const": [0.5] * 25, "silent": [0.0] * 20, "ramp": [i / 100 for i in range(47)], "burst": [0.0] * 30 + [1.0] * 10 + [0.0] * 30}
    rows = spark.createDataFrame([(k, i, v) for k, x in series.items() for i, v in enumerate(x)], "series string, idx long, v double")
    env = {}
    for r in signal.rms_envelope(rows, 10).collect():
        env[r.series, r.win] = r.rms
    for k, x in series.items():
        for w in range(max(1, len(x) // 10)):
            assert math.isclose(env.pop((k, w)), math.sqrt(np.mean(np.square(x[w * 10 : w * 10 + 10]))), abs_tol=1e-12)
    assert not env
    z = signal.zscore(signal.rms_envelope(rows, 10), "rms").groupBy("series").agg(F.avg("rms").alias("m"), F.stddev_pop("rms").alias("s")).collect()
    assert {r.series: round(r.s) for r in z} == {"short": 0, "const": 0, "silent": 0, "ramp": 1, "burst": 1}
    assert {r.series: (r["first"], r["last"]) for r in signal.trim_bounds(rows, 10).collect()} == {"short": (0, 2), "const": (0, 25), "silent": (0, 20), "ramp": (0, 47), "burst": (20, 50)}


# ---- clusters and assignment


def brute_linkage(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: (np.mean([d[a][b] for a in groups[p[0]] for b in groups[p[1]]]), p))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkage_equals_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 6, 14):
        x = rng.normal(size=(n, 3))
        d = np.abs(x[:, None] - x[None]).sum(axis=2)
        got = clusters.average_linkage(d, [1, 2, 3, 20])
        for k in (1, 2, 3):
            if k <= n:
                assert {frozenset(np.flatnonzero(got[k] == c).tolist()) for c in set(got[k].tolist())} == brute_linkage(d, k)
        assert len(set(got[20].tolist())) == n


def test_drift_groups_both_sides_at_once(spark):
    """A key is shipped once; null is a key like others, as in EXCEPT."""
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (3,), (3,), (None,)], "k long")
    got = coverage.drift(a, b, "k")
    assert sorted((r.k, r.side) for r in got.collect()) == [(1, "missing"), (3, "extra")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_frames_of_a_video_are_described_once(spark):
    """Videos of several frames, some of them without pixels; no row for each number of a frame."""
    rng = np.random.default_rng(6)
    frames = [(k % 40, bytearray(rng.integers(0, 256, 64, dtype=np.uint8).tobytes()) if k % 3 or k % 40 == 7 else None) for k in range(120)] + [(99, None)]
    rows = spark.createDataFrame([(v, 8, 8, g) for v, g in frames], "video long, width int, height int, grey binary")
    plan = views.descriptors(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Generate" not in plan
    got = {r.video: r.descriptor for r in views.descriptors(rows).collect()}
    for v in range(40):
        own = [views.frame_descriptor(np.frombuffer(g, np.uint8).reshape(8, 8)) for w, g in frames if w == v and g]
        assert got[v] is None if not own else np.allclose(got[v], np.mean(own, axis=0) / np.linalg.norm(np.mean(own, axis=0)), atol=1e-6)
    assert got[99] is None


def test_lanes_solved_side_by_side_equal_lanes_alone():
    rng = np.random.default_rng(5)
    lanes = []
    for k in range(400):
        n, m = rng.integers(1, 9), rng.integers(1, 11)
        size = rng.integers(1, n * m + 1)
        lanes.append((rng.integers(0, n, size), rng.integers(-1, m, size), rng.random(size) if k % 2 else rng.integers(0, 11, size) / 10.0))
    video, audio, score = (np.concatenate([x[i] for x in lanes]) for i in range(3))
    at, with_, *rest = assign.assign_lanes(np.repeat(np.arange(len(lanes)), [len(x[0]) for x in lanes]), video, audio, score)
    got = [(video[a], audio[w] if w >= 0 else None, *r) for a, w, *r in zip(at, with_, *rest, strict=True)]
    assert got == [row for x in lanes for row in assign.assign_lane(*x)]


def test_few_audios_are_assigned_by_the_least_sum_in_order():
    """Choices that cost the same but for rounding: the least sum, video by video, as SQL adds them up."""
    rng = np.random.default_rng(8)
    lanes = [(np.repeat(np.arange(n), m), np.tile(np.arange(m), n), rng.integers(4, 11, n * m) / 10 + rng.integers(0, 2) / 30) for n, m in rng.integers(1, 5, (60, 2))]
    video, audio, score = (np.concatenate([x[i] for x in lanes]) for i in range(3))
    lane = np.repeat(np.arange(len(lanes)), [len(x[0]) for x in lanes])
    at, _, _, _, cost = assign.assign_lanes(lane, video, audio, score, 4)
    for k, (v, a, s) in enumerate(lanes):
        price = 1 - s.reshape(v.max() + 1, -1)
        sums = [sum(price[i, c] if c >= 0 else 1 - 0.4 for i, c in enumerate(p)) for p in itertools.product(range(-1, a.max() + 1), repeat=v.max() + 1) if len({c for c in p if c >= 0}) == sum(c >= 0 for c in p)]
        assert sum(cost[lane[at] == k]) == min(sums)


def test_assignment_equals_permutations():
    rng = random.Random(7)
    for n, m in ((1, 1), (3, 3), (5, 2), (2, 5), (4, 4)):
        for _ in range(30):
            score = np.array([[rng.choice([0.2, 0.41, 0.56, 0.7, rng.random()]) for _ in range(m)] for _ in range(n)])
            cost = np.concatenate((1 - score, np.where(np.eye(n) > 0, 0.6, 2.0)), axis=1)
            col = assign.best_columns(cost)
            best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m + n), n))
            assert len(set(col.tolist())) == n and math.isclose(cost[np.arange(n), col].sum(), best, abs_tol=1e-9)
            video, audio = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
            out = assign.assign_lane(video, audio, score.ravel())
            assert all(ok == (a is not None) and (not ok or s >= 0.56) for _, a, s, ok, _ in out)
            used = [a for _, a, _, ok, _ in out if ok]
            assert len(used) == len(set(used)) and math.isclose(sum(x[4] for x in out), best, abs_tol=1e-9)


def test_band_join_and_split_lanes(spark):
    """What is assigned does not change by leaving out pairs of unlike lengths, nor by splitting lanes over tables; and few pairs are shipped."""
    rng = random.Random(8)
    audios = [(s, f"a{k}", rng.uniform(0, 9000)) for s in "xy" for k in range(60)]
    videos = [(s, lane, f"{lane}-{k}", rng.uniform(-50, 9000)) for s in "xy" for lane in (1, 2) for k in range(40)] + [("x", 3, "3-0", 9_999.0), ("x", 3, "3-1", 200.0)]
    a, v = spark.createDataFrame(audios, "session string, audio string, audio_s double"), spark.createDataFrame(videos, "session string, lane int, video string, video_s double")
    score = S.pair_score(F.col("duration_score"), F.lit(0.5)).alias("pair_score")
    keys = ["session", "lane", "video", "audio"]
    every = a.join(v, "session").withColumn("duration_score", S.duration_score(F.col("audio_s"), F.col("video_s"))[0]).select(*keys, score)
    near = matching.near_pairs(a, v, "session")
    wanted = {(s, x, y) for s, x, p in audios for t, _, y, q in videos if s == t and abs(p - q) <= 240}
    assert sorted((r.session, r.audio, r.video) for r in near.collect()) == sorted(wanted)
    bucket = lambda x: math.floor(x / 240)
    shipped = sum(s == t and abs(bucket(p) - bucket(q)) <= 1 for s, _, p in audios for t, _, _, q in videos)
    assert shipped < 0.1 * every.count()
    rows = near.select(*keys, score).unionByName(matching.far_scores(a, v, 0.5, "session").select(*keys, "pair_score"))
    told = lambda df: sorted((r.session, r.lane, r.video, r.audio or "", round(r.pair_score, 9), r.assigned) for r in df.collect())
    want = told(assign.assign(every, "session"))
    assert len(want) == len(videos) and sum(r[-1] for r in want) > 60
    assert told(assign.assign(rows, "session")) == want == told(assign.assign(rows, "session", large=True))


def test_pairs_made_in_tasks_equal_shipped_ones(spark, monkeypatch):
    """Clips of like lengths meet in the task that assigns them, and no pair is shipped; a clip of no length and a session without audios give what pairs give."""
    rng = random.Random(18)
    audios = [(s, f"a{k % 55}", rng.uniform(0, 5000)) for s in "xy" for k in range(60)] + [("x", "none", None), ("w", "w1", 100.0)]
    videos = [(s, lane, f"{lane}-{k % 38}", rng.uniform(-50, 5000)) for s in "xyz" for lane in (1, 2) for k in range(40)] + [("x", 3, "3-0", 9_999.0), ("x", 3, "3-1", 200.0), ("x", None, "n", 150.0), ("y", 4, "null", None)]
    a, v = spark.createDataFrame(audios, "session string, audio string, audio_s double"), spark.createDataFrame(videos, "session string, lane int, video string, video_s double")
    keys = ["session", "lane", "video", "audio"]
    score = S.pair_score(F.col("duration_score"), F.lit(0.8)).alias("pair_score")
    pairs = matching.near_pairs(a, v, "session").select(*keys, score).unionByName(matching.far_scores(a, v, 0.8, "session").select(*keys, "pair_score"))
    told = lambda df: sorted((r.session, r.lane or 0, r.video, r.audio or "", r.pair_score, r.assigned) for r in df.select(*keys, "pair_score", "assigned").collect())
    want = told(assign.assign(pairs, "session"))
    assert sum(r[-1] for r in want) > 60
    for rows, most in ((100_000, 1_000_000), (20, 50)):
        monkeypatch.setattr(assign, "ROWS", rows)
        monkeypatch.setattr(assign, "PAIRS", most)
        made = assign.assign_near(a, v, 0.8, "session")
        assert told(made) == want
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    deltas = [-300.0, -240.0, -100.0, -45.0, -44.9, 0.0, 41.9, 42.0, 75.0, 75.1, 130.0, 160.0, 240.0, 241.0]
    told = spark.createDataFrame([(x, 1000.0) for x in deltas], "d double, v double").select(S.pair_score(S.duration_score(F.col("d") + F.col("v"), F.col("v"))[0], F.lit(0.8)).alias("s")).collect()
    assert assign.near_scores(np.array(deltas) + 1000.0, np.full(len(deltas), 1000.0), 0.8).tolist() == [r.s for r in told]


def test_large_tables_are_dealt_into_bounded_tasks(spark, monkeypatch):
    """Tables of more rows than the session's partitions should hold go to more tasks, with the same rows."""
    rng = random.Random(19)
    rows = [(f"v{k // 2}", f"a{rng.randrange(300)}", rng.choice((0.3, 0.5, 0.57, 0.7, 0.9)), rng.random() < 0.6) for k in range(2000)]
    assignments = spark.createDataFrame(rows, "video string, audio string, pair_score double, assigned boolean")
    audios = spark.createDataFrame([(f"a{k}",) for k in range(320)], "audio string")
    takes = spark.createDataFrame([(f"t{k % 990}", "other" if k % 7 else "s", f"/takes/t{k % 990}", "p", True) for k in range(1000)], "take_id string, session string, source_dir string, project string, loaded boolean")
    cameras = spark.createDataFrame([(f"t{rng.randrange(990)}", rng.choice("AANNR") if rng.random() < 0.98 else None) for _ in range(2000)], "take_id string, label string")
    expected = spark.createDataFrame([("s", "p")], "session string, project string")

    def results(angles):
        of = spark.createDataFrame([(x,) for x in angles], "angle string")
        return matching.classify(audios, assignments), rules.inspect_session(takes, cameras, of, expected)

    told = lambda df: sorted(map(str, df.collect()))
    small = [told(df) for angles in ("AAN", "") for df in results(angles)]
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    large = [df for angles in ("AAN", "") for df in results(angles)]
    assert [told(df) for df in large] == small
    assert large[0].rdd.getNumPartitions() >= 20 and large[1].rdd.getNumPartitions() >= 30
    count = Counter((take, label) for take, label in map(tuple, cameras.collect()))
    issues = Counter((r.take_id, r.code, r.subject) for r in large[1].collect() if "camera" in r.code)
    want = Counter((t, "take_duplicate_camera_labels", x) for (t, x), n in count.items() if n > 1) + Counter((t, "take_camera_label_unknown", x) for t, x in count if x not in ("A", "N"))
    assert issues == want and not any("unknown" in row for row in small[3])


def test_written_tables_are_not_broadcast(spark):
    """Names that repeat take few bytes of a file, but not of a driver; what is asked to be broadcast still is."""
    lanes = storage.written(spark.range(1000).selectExpr("id % 10 AS session", "format_string('v-%09d', id % 5) AS video", "id AS lane"))
    own = lanes.groupBy("session", "lane").count()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(lanes.join(lanes.select("session", "video"), ["session", "video"])) + plan(spark.range(5).withColumnRenamed("id", "session").join(own, "session", "left"))
    assert "BroadcastHashJoin" in plan(spark.range(5).withColumnRenamed("id", "session").join(F.broadcast(own), "session"))


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000)]
    low = {x: x for e in edges for x in e}
    for _ in range(400):
        for x, y in edges:
            low[x] = low[y] = min(low[x], low[y])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == low
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_silhouette_and_spread(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = [0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 3]
    rows = spark.createDataFrame([("s", i, label[i], x[i].tolist()) for i in range(12)] + [("one", 50, 1, x[0].tolist())], "session string, i int, l int, v array<double>")
    d = np.clip(1 - np.maximum(x @ x.T, 0), 0, 1)
    scores = []
    for i in range(12):
        own = [j for j in range(12) if j != i and label[j] == label[i]]
        others = [np.mean([d[i, j] for j in range(12) if label[j] == m]) for m in set(label) - {label[i]}]
        a, b = (np.mean(d[i, own]), min(others)) if own else (0, 0)
        scores.append((b - a) / max(a, b) if own and max(a, b) > 1e-6 else 0)
    got = {r.session: r.silhouette for r in clusters.silhouette(rows, "i", "l", "v", "session").collect()}
    assert math.isclose(got["s"], np.mean(scores), abs_tol=1e-9) and got["one"] == 0
    far = {r.l: r.spread for r in clusters.spread(rows.where("session = 's'"), "l", "i", "v").collect()}
    assert math.isclose(far[0], max(d[i, j] for i in range(4) for j in range(i)), abs_tol=1e-9) and far[3] == 0
    (c,) = [r.centroid for r in clusters.centroids(rows.where("l = 2"), "l", "v").collect()]
    m = x[9:11].mean(axis=0)
    assert np.allclose(c, m / np.linalg.norm(m))


def test_classification(spark):
    pairs = [("p", f"p{i}", 0.8) for i in range(3)] + [("weak", "w0", 0.57)] + [("many", f"m{i}", 0.9) for i in range(9)] + [("low3", f"l{i}", 0.58) for i in range(3)]
    rows = [(v, a, s, True) for a, v, s in pairs] + [("loose", None, 0.5, False), ("late", None, 0.58, False), ("p0", None, 0.1, False)]
    out = matching.classify(spark.createDataFrame([("p",), ("weak",), ("many",), ("low3",), ("none",)], "audio string"), spark.createDataFrame(rows, "video string, audio string, pair_score double, assigned boolean")).collect()
    got = {(r.source, r.bucket) for r in out}
    assert got == {("none", "excluded"), ("weak", "excluded"), ("w0", "excluded"), ("many", "unresolved"), ("low3", "unresolved"), ("loose", "excluded"), ("late", "unresolved"), *((f"m{i}", "unresolved") for i in range(9)), *((f"l{i}", "unresolved") for i in range(3))}


def test_plan(spark):
    """Two takes of two angles, and confidences of each take by itself."""
    vec = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    videos = [("s", f"{t}-{k}", vec[k]) for t in "12" for k in "ab"] + [("s", "odd", None)]
    score = {("1", "A1"): 0.9, ("1", "A2"): 0.1, ("2", "A1"): 0.1, ("2", "A2"): 0.7}
    pairs = [("s", v, a, score.get((v[0], a), 0.2)) for _, v, _ in videos for a in ("A1", "A2")]
    takes, buckets, found = grouping.plan(
        spark.createDataFrame([("s", "A1"), ("s", "A2")], "session string, audio string"), spark.createDataFrame(videos, "session string, video string, descriptor array<double>"),
        spark.createDataFrame(pairs, "session string, video string, audio string, pair_score double"), 3,
    )
    assert {(r.take_id, r.video, r.label, r.confidence) for r in takes.collect()} == {("take-01", "1-a", "angle-a", 0.9), ("take-01", "1-b", "angle-b", 0.9), ("take-02", "2-a", "angle-a", 0.7), ("take-02", "2-b", "angle-b", 0.7)}
    assert [(r.source, r.bucket) for r in buckets.collect()] == [("odd", "excluded")]
    # a take below the note's limit is still well above that of the issue
    assert [(r.code, r.severity, r.subject) for r in found.collect()] == [("excluded_media_detected", "info", "odd")]
    assert {(r.take_id, r.note) for r in takes.collect()} == {("take-01", None), ("take-02", "take confidence is low for a production take")}
    found = found.withColumn("severity", F.lit("warn")).withColumn("code", F.lit("take_confidence_low"))
    kind = "source string"
    checks = grouping.preflight(spark.createDataFrame([("a",), ("a",), ("b",)], kind), spark.createDataFrame([("a",), ("c",)], kind), spark.createDataFrame([("t", True), ("t", False)], "target string, exists boolean"), found)
    assert {(r.check, r.subject) for r in checks.collect()} == {("source_missing", "b"), ("source_extra", "c"), ("source_twice", "a"), ("target_twice", "t"), ("target_exists", "t"), ("plan_not_passed", "take_confidence_low")}


# ---- coverage and rules


def test_coverage(spark):
    cells = spark.createDataFrame([("take-01", "b"), ("take-01", "c"), ("take-02", "b"), ("take-02", "d")], "take string, angle string")
    assert {tuple(r) for r in coverage.missing_cells(cells, "take", "angle").collect()} == {("take-01", "d"), ("take-02", "c")}
    assert [r.angle for r in coverage.common_columns(cells, "take", "angle").collect()] == ["b"]
    new, old = coverage.pending(cells, cells.where("angle = 'b'"), "angle")
    assert (new.count(), old.count()) == (2, 2)
    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    assert {tuple(r) for r in coverage.upsert(kv([("a", "1"), ("b", "2")]), kv([("b", "2"), ("c", "3")])).collect()} == {("a", "1", False), ("b", "2", False), ("c", "3", True)}
    assert {tuple(r) for r in coverage.setting_mismatches(kv([("a", "1"), ("b", None), ("c", "3")]), kv([("a", "1"), ("b", "2")])).collect()} == {("b", None, "2"), ("c", "3", None)}
    assert coverage.missing_cells(cells.limit(0), "take", "angle").count() == 0


def test_rules_and_status(spark):
    good = dict(take_id="t", file="a", duration_seconds=100.0, frame_rate=29.97, nominal_frame_rate=29.97, scratch_audio_present=True, color_space="bt709", color_transfer="bt709", color_primaries="bt709", median_seconds=100.0)
    bad = {
        "variable_frame_rate": dict(nominal_frame_rate=30.0), "frame_rate_nominal_warning": dict(frame_rate=30.0, nominal_frame_rate=30.0), "frame_rate_mismatch": dict(frame_rate=25.0, nominal_frame_rate=25.0),
        "color_space_mismatch": dict(color_space=None), "color_transfer_mismatch": dict(color_transfer="x"), "color_primaries_mismatch": dict(color_primaries=""),
        "scratch_audio_missing": dict(scratch_audio_present=False), "video_duration_outlier": dict(duration_seconds=281.0), "video_duration_warning": dict(duration_seconds=161.0),
    }
    rows = spark.createDataFrame([{**good, "file": "none"}, *({**good, **v, "file": k} for k, v in bad.items())], "take_id string, file string, duration_seconds double, frame_rate double, nominal_frame_rate double, scratch_audio_present boolean, color_space string, color_transfer string, color_primaries string, median_seconds double")
    found = rules.issues(rows, F.col("file"), rules.video_rules(), "take_id")
    assert {(r.code, r.subject) for r in found.collect()} == {(k, k) for k in bad}
    assert [r.status for r in rules.folded_status(found, spark.createDataFrame([("t",), ("u",)], "take_id string"), "take_id").orderBy("take_id").collect()] == ["FAIL", "PASS"]
    (n,) = rules.severity_counts(found, "take_id").collect()
    assert (n.fail, n.warn, n.info) == (6, 3, 0)
    stills = rules.manifest(spark.createDataFrame([("1/b",), ("1/c",)], "clip string"), spark.createDataFrame([("1/b",)], "clip string"), "clip")
    assert {(r.clip, r.code) for r in stills.collect()} == {("1/b", None), ("1/c", "still_missing")}
    assert one(spark, rules.tagged(F.create_map(F.lit("take_id"), F.lit("own")), "take_id", F.lit("x")), rules.tagged(F.create_map(F.lit("a"), F.lit("b")), "take_id", F.lit("x"))) == ({"take_id": "own"}, {"take_id": "x", "a": "b"})


# ---- sources, sinks, streams


def test_media_sources(spark, tmp_path):
    for name, size in (("audio.wav", 1), ("big.wav", 9), ("_b.MP4", 2), ("a.mov", 0), (".x.wav", 3), ("n.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = media.list_folder(spark, str(tmp_path)).withColumn("take_id", F.lit("t"))
    assert [tuple(r) for r in media.masters(files).collect()] == [("t", "audio.wav")]
    assert [tuple(r) for r in media.masters(files.where("name <> 'audio.wav'")).collect()] == [("t", "big.wav")]
    assert {(r.pos, r.file, r.label) for r in media.cameras(files).collect()} == {(1, "_b.MP4", "_b"), (2, "a.mov", "a")}
    assert {r.name for r in media.audio_files(media.catalog(spark, str(tmp_path))).collect()} == {"audio.wav", "big.wav"}
    with pytest.raises(FileNotFoundError):
        media.incoming_folder(str(tmp_path))


def test_probe_and_text_sources(spark, tmp_path):
    probe = {"format": {"filename": "v.mp4", "duration": "10.5"}, "streams": [{"codec_type": "audio", "codec_name": "pcm_s24le", "sample_rate": "48000", "channels": 2, "bits_per_raw_sample": "24", "duration_ts": 504000, "time_base": "1/48000"}, {"codec_type": "video", "avg_frame_rate": "30000/1001", "r_frame_rate": "30/1", "pix_fmt": "yuv420p10le", "color_space": "bt709"}]}
    (tmp_path / "p.json").write_text(json.dumps(probe, indent=1))
    rows = media.probes(spark, str(tmp_path / "p.json"))
    (v,), (a,) = media.video_clips(rows).collect(), media.audio_clips(rows).collect()
    assert (round(v.frame_rate, 3), v.variable_frame_rate, v.bit_depth, v.scratch_audio_present, v.color_transfer) == (29.97, True, 10, True, "")
    assert (a.sample_rate, a.bits_per_sample, a.sample_count, a.is_pcm) == (48000, 24, 504000, True)
    lines = spark.createDataFrame([(x,) for x in ("a = 1 = 2", "// c = 3", "", "nothing", "n:/p:*:::DISK", "# n:/q:x", "a:b")], "value string")
    assert {tuple(r) for r in media.key_values(lines).collect()} == {("a", "1 = 2")}
    assert {tuple(r) for r in media.records(lines).collect()} == {("n", "/p", "DISK")}
    (tmp_path / "t.yaml").write_text("session: s\ncamera_files:\n- {file: a.mp4, label: a}\n")
    (doc,) = media.documents(spark, str(tmp_path / "t.yaml"), "session string, camera_files array<struct<file:string,label:string>>, edit_audio string").collect()
    assert doc.document.session == "s" and doc.document.camera_files[0].label == "a" and doc.document.edit_audio is None
    pcm = np.array([0, 16384, -32768], "<i2").tobytes()
    assert [r.v for r in media.pcm_samples(spark.createDataFrame([("f", bytearray(pcm))], "path string, content binary")).orderBy("idx").collect()] == [0.0, 0.5, -1.0]


def test_sinks(spark, tmp_path):
    sinks.write_json(str(tmp_path / "r.json"), {"b": 1, "a": "é"})
    assert (tmp_path / "r.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    assert sinks.markdown_table(spark.createDataFrame([(2, "x|y"), (1, None)], "i int, s string"), ["i", "s"], ["i"]) == "| i | s |\n| --- | --- |\n| 1 |  |\n| 2 | x\\|y |"
    with pytest.raises(ValueError):
        sinks.report_rows(spark.range(5), 4)
    (tmp_path / "a").write_text("1")

    def fail():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.staged([(str(tmp_path / "a"), str(tmp_path / "d" / "b"))], fail)
    assert (tmp_path / "a").exists()


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "u", "x"), ("2024-01-01 00:50:00", "v", "x"), ("2024-01-01 01:10:00", "u", "y")], "ts string, user string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    live = stream.read_events(spark, str(tmp_path / "in"), "ts timestamp, user string, kind string", 1)
    q = stream.first_evidence(live, "user", "kind", "ts").writeStream.outputMode("complete").format("memory").queryName("first_evidence").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert spark.table("first_evidence").count() == 3
    assert {(r.kind, r.n) for r in stream.windowed_counts(rows, "ts", "kind").collect()} == {("x", 2), ("y", 1)}


def test_session_settings(spark):
    from cadenza.operators import rules

    kind = "take_id string, frame_rate double, width int, height int, input_color_space string, timeline_color_space string, output_color_space string"
    takes = spark.createDataFrame([("a", 29.97, 1920, 1080, "x", "y", "z"), ("b", 25.0, 1920, 1080, None, "y", "z")], kind)
    want = spark.createDataFrame([("s", 29.97, 1920, 1080, "x", "y", "z")], kind)
    found = lambda rates: sorted(tuple(r) for r in rules.session_settings(takes, want, spark.createDataFrame([(r,) for r in rates], "frame_rate double")).select(F.coalesce("take_id", F.lit("-")), "code", "severity", "subject").collect())
    own = [("b", "take_timeline_setting_mismatch", "fail", "frame_rate"), ("b", "take_timeline_setting_mismatch", "fail", "input_color_space")]
    assert found([29.97, 29.9701, 0.0]) == own
    assert found([29.97, 25.0]) == [("-", "mixed_session_frame_rates", "fail", "session"), *own]

"""Sessions found in folders, reports of them, and the inspections that SQL does not cover."""

from __future__ import annotations

import json
import struct

import pytest
import yaml
from cadenza.operators import coverage, inspection, rules
from cadenza.plans import grouping
from cadenza.sources import media, reports, sessions, sinks
from pyspark.sql import functions as F

FILES = "session string, take_id string, name string, suffix string, length long"


def test_documents_and_defaults(spark, tmp_path):
    paths = spark.createDataFrame([("/a/take.yaml",), ("/a/t1/",), ("/a/t1",)], "p string")
    assert [r[0] for r in paths.select(sessions.document_path(F.col("p"), "take.yaml")).collect()] == ["/a/take.yaml", "/a/t1/take.yaml", "/a/t1/take.yaml"]
    rows = spark.createDataFrame([(1, None, None), (2, (5, None), "x")], "id int, timeline struct<width:int,height:int>, name string")
    got = sessions.with_defaults(rows, {"timeline.width": 1920, "timeline.height": 1080, "name": "n"}).orderBy("id").collect()
    assert [(tuple(r.timeline), r.name) for r in got] == [((1920, 1080), "n"), ((5, 1080), "x")]
    (tmp_path / "plan.json").write_text(json.dumps({"status": "PASS", "takes": [{"take_id": "take-01", "videos": [{"source": "a", "pair_score": 0.5}]}]}, indent=1))
    (row,) = sessions.load_plan(spark, str(tmp_path / "plan.json")).collect()
    assert row.takes[0].videos[0].pair_score == 0.5
    (tmp_path / "other.json").write_text("{}")
    with pytest.raises(Exception, match="without takes"):
        sessions.load_plan(spark, str(tmp_path / "other.json")).collect()


def test_sessions_are_initialized(spark):
    files = spark.createDataFrame([
        ("s", "t2", "b.mp4", ".mp4", 5), ("s", "t2", "x.wav", ".wav", 1), ("s", "t2", "y.wav", ".wav", 9), ("s", "t1", "audio.wav", ".wav", 1), ("s", "t1", "z.wav", ".wav", 9), ("s", "t1", "c.mov", ".mov", 5),
        ("s", "t1", "a.mov", ".mov", 5), ("s", ".t", "a.mov", ".mov", 5),
    ], FILES)
    known = spark.createDataFrame([("s", "t2", "kept.wav", [("k.mp4", "k")])], "session string, take_id string, master_audio string, cameras array<struct<file:string,label:string>>")
    own = spark.createDataFrame([("s", "/m/20240102 Evening", None, "", "old")], "session string, root string, title string, project_name string, input_color_space string")
    found, takes = sessions.initialized(own, files, known, {"input_color_space": "new"})
    (row,) = found.collect()
    assert (row.date, row.title, row.input_color_space, row.takes) == ("2024-01-02", "Evening", "new", ["t1", "t2"])
    got = sessions.session_takes(found, takes).orderBy("pos").collect()
    assert [(r.take_id, r.master_audio, [tuple(c) for c in r.cameras]) for r in got] == [("t1", "audio.wav", [("a.mov", "a"), ("c.mov", "c")]), ("t2", "kept.wav", [("k.mp4", "k")])]
    for lost, what in (("suffix <> '.wav'", "no audio"), ("suffix = '.wav'", "no video")):
        with pytest.raises(Exception, match=what):
            sessions.discovered_takes(files.where(lost)).collect()
    with pytest.raises(Exception, match="no takes"):
        sessions.initialized(own, files.limit(0), known.limit(0), {})[0].collect()
    with pytest.raises(Exception, match="no document"):
        sessions.session_takes(found, takes.where("take_id = 't1'")).collect()


def test_one_project_a_session(spark):
    entries = [("s", "/s", "A.logicx", "/s/A.logicx"), ("s", "/s/logic", "link.logicx", "/s/A.logicx"), ("s", "/s", "b.txt", "/s/b.txt"), ("t", "/t", "x", "/t/x")]
    rows = spark.createDataFrame(entries, "session string, folder string, name string, resolved string")
    assert [tuple(r) for r in sessions.project_files(rows).collect()] == [("s", "/s/A.logicx")]
    with pytest.raises(Exception, match="several projects"):
        sessions.project_files(rows.unionByName(spark.createDataFrame([("s", "/s", "C.logicx", "/s/C.logicx")], rows.schema))).collect()


def test_assets_join_their_probes(spark):
    stream = "index int, codec_type string, codec_name string, width int, height int, avg_frame_rate string, r_frame_rate string, pix_fmt string, bits_per_sample string, bits_per_raw_sample string, sample_rate string, channels int, channel_layout string, duration_ts long, time_base string, color_space string, color_transfer string, color_primaries string"
    names = [x.split(" ")[0] for x in stream.split(", ")]
    one = lambda **kw: tuple(kw.get(n) for n in names)
    probed = spark.createDataFrame([(("/a.mp4", "4.5"), [one(codec_type="video", avg_frame_rate="25/1", r_frame_rate="25/1"), one(codec_type="audio")]), (("/b.wav", "9"), [one(codec_type="audio", sample_rate="48000", codec_name="pcm_s16le", channels=2)])], media.PROBE_FIELDS)
    files = spark.createDataFrame([("/b.wav", ".wav"), ("/a.mp4", ".mp4"), ("/c.mp4", ".mp4")], "path string, suffix string")
    assert [(r.path, r.duration_seconds, r.scratch_audio_present) for r in sessions.video_assets(files, probed).collect()] == [("/a.mp4", 4.5, True), ("/c.mp4", None, None)]
    assert [(r.path, r.sample_rate, r.is_pcm) for r in sessions.audio_assets(files, probed).collect()] == [("/b.wav", 48000, True)]


def test_reports(spark, tmp_path):
    takes = spark.createDataFrame([("take-01", "in/a.WAV", "in/v.mp4", "angle-a", 0.9, 0.8), ("take-01", "in/a.WAV", "in/w|.mp4", "angle-b", 0.7, 0.8)], "take_id string, audio string, video string, label string, pair_score double, confidence double")
    buckets = spark.createDataFrame([("in/x.mp4", "video", "excluded", "short", 0.25)], "source string, media_type string, bucket string, reason string, confidence double")
    found = spark.createDataFrame([("excluded_media_detected", "info", "in/x.mp4")], "code string, severity string, subject string")
    text = reports.plan_markdown(takes, buckets, found, "2024-01-02T03:04:05+00:00")
    for line in ("- Status: PASS", "- Angles: angle-a, angle-b", "| take-01 | a.WAV | 2 | 0.800 | angle-a, angle-b |", "| take-01 | angle-b | w\\|.mp4 | angle-b.mp4 | 0.700 |", "- video: `in/x.mp4` (short, confidence 0.250)", "## Unresolved media\n\n- none"):
        assert line in text, line
    order = spark.createDataFrame([(1, "t2", "low", 1, 0.5), (2, "t1", "none", 0, 999.0)], "position int, take_id string, confidence string, evidence_groups int, average_rank double")
    ranks = spark.createDataFrame([("g", "video", 2, "t1"), ("g", "video", 1, "t2")], "grp string, media_type string, position int, take_id string")
    text = reports.order_markdown(order, ranks, found.withColumn("severity", F.lit("warn")), "now")
    assert "- Status: WARN" in text and "| 1 | t2 | low | 1 | 0.500 |" in text and "| g | video | t2 -> t1 |" in text
    assert "| fail | x | y |" in reports.issues_markdown("Prepare", spark.createDataFrame([("x", "fail", "y")], found.schema), {"Takes": (order, ["position", "take_id"])}, "now")
    handed = spark.createDataFrame([("t1", "e.wav", [("a", "f.mp4")])], "take_id string, edit_audio string, cameras array<struct<label:string,file:string>>")
    reports.handoff_documents(handed, str(tmp_path), "s")
    assert json.loads((tmp_path / "handoff.json").read_text())["takes"][0]["cameras"] == [{"label": "a", "file": "f.mp4"}] and "  - a: f.mp4" in (tmp_path / "handoff.md").read_text()
    (path,) = reports.write_yaml(handed, lambda r: f"{tmp_path}/{r['take_id']}/take.yaml", ("cameras",))
    assert yaml.safe_load(open(path)) == {"take_id": "t1", "edit_audio": "e.wav"}
    assert reports.summary_line("PASS") == "PASS" and reports.summary_line("FAIL", "two") == "FAIL: two" and json.loads(reports.summary_line("x", payload={"a": "é"})) == {"a": "é"}
    times = spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS a, timestamp'2024-01-02 03:04:05.000120' AS b").select(reports.iso_time(F.col("a")), reports.iso_time(F.col("b")))
    assert tuple(times.first()) == ("2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000120+00:00")
    sinks.append_log(spark, str(tmp_path / "log"), found)
    sinks.append_log(spark, str(tmp_path / "log"), found)
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.markdown_report(str(tmp_path / "r.md"), "T", "PASS", {"n": 1}, {"S": "body"})
    assert (tmp_path / "r.md").read_text() == "# T\n\n- status: PASS\n- n: 1\n\n## S\n\nbody\n"


def test_paths_clips_and_stills(spark):
    clips = spark.createDataFrame([("s", "t1", "a", "/x"), ("s", "t1", "b", "/y"), ("s", "t1", "c", "/z")], "session string, take_id string, label string, path string")
    files = spark.createDataFrame([("/x", 1), ("/y", 2)], "path string, n int")
    assert {(r.path, r.n) for r in inspection.matched_files(clips.where("label <> 'c'"), files).collect()} == {("/x", 1), ("/y", 2)}
    with pytest.raises(Exception, match="no file for clip /z"):
        inspection.matched_files(clips, files).collect()
    got = inspection.still_issues(clips, files, clips.where("label = 'a'")).collect()
    assert {(r.code, r.subject, r.severity) for r in got} == {("still_source_missing", "t1/c", "warn"), ("still_render_failed", "t1/b", "warn")}
    frames = spark.createDataFrame([(0,), (1,), (2,), (101,), (None,)], "n int")
    assert [r[0] for r in frames.select(inspection.still_frame(F.col("n"))).collect()] == [None, 0, 1, 50, None]
    offsets = spark.createDataFrame([("s", "t1", "a", 0.69), ("s", "t1", "b", 0.7)], "session string, take_id string, label string, confidence double")
    assert [(r.code, r.subject) for r in inspection.sync_issues(offsets).collect()] == [("color_prep_sync_confidence_low", "a")]
    first = inspection.first_named(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "name string, i int"), "name", "i")
    assert {tuple(r) for r in first.collect()} == {("a", 1), ("b", 3)}


def test_names_in_use_cycles_and_samples(spark):
    rows = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3), ("g", 4)], "name string, n int")
    used = spark.createDataFrame([("f-stale",), ("f-stale-3",), ("g-stale-x",)], "target string")
    assert {(r.n, r.target) for r in coverage.stale_names(rows, "name", "n", used).collect()} == {(1, "f-stale-2"), (2, "f-stale-4"), (3, "f-stale-5"), (4, "g-stale")}
    tree = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 2), (5, 9)], "id int, parent int")
    assert {tuple(r) for r in coverage.descendants(tree, 1).collect()} == {(2, 1), (3, 2), (4, 2)}
    chain = spark.createDataFrame([(k + 1, k) for k in range(500)] + [(9_000, 9_001), (9_001, 9_000), (400, 398)], "id int, parent int")
    want = {(k, k if k < 400 else k - 1) for k in range(1, 501)}
    assert {tuple(r) for r in coverage.descendants(chain, 0).collect()} == want


def test_reload_changes(spark):
    kind = "session string, take_id string, code string, subject string, severity string"
    before = spark.createDataFrame([("s", None, "a", "x", "warn"), ("s", "t", "b", "y", "fail"), ("u", None, "c", "z", "fail")], kind)
    after = spark.createDataFrame([("s", None, "a", "x", "fail"), ("s", None, "a", "x", "warn"), ("s", "t", "d", "y", "info"), ("v", None, "c", "z", "warn")], kind)
    changes = inspection.reload_changes(before, after)
    assert {tuple(r) for r in changes.collect()} == {("s", None, "a", "x", "fail", "same", 2), ("s", "t", "b", "y", "fail", "gone", 1), ("u", None, "c", "z", "fail", "gone", 1), ("s", "t", "d", "y", "info", "new", 1), ("v", None, "c", "z", "warn", "new", 1)}
    sessions = spark.createDataFrame([("s", True), ("u", True), ("v", True), ("w", False)], "session string, reloaded boolean")
    assert {tuple(r) for r in inspection.reload_status(sessions, changes).collect()} == {("s", True, "FAIL", 1, 1, 2), ("u", True, "PASS", 0, 1, 0), ("v", True, "WARN", 1, 0, 0), ("w", False, "FAIL", 0, 0, 0)}


def test_damaged_log_is_begun_afresh(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.createDataFrame([(1, "x")], "n int, s string")
    assert sinks.append_log(spark, path, rows) is None and sinks.append_log(spark, path, rows) is None
    assert spark.read.json(path).count() == 2
    for name in (tmp_path / "log").glob("part-*.json"):
        data = name.read_bytes()
        if data:
            name.write_bytes(data[:-5])  # cut off
            (tmp_path / "log" / f".{name.name}.crc").unlink(missing_ok=True)
    moved = sinks.append_log(spark, path, rows)
    assert moved == f"{path}.damaged-1" and spark.read.json(path).count() == 1
    assert sum(1 for p in (tmp_path / "log.damaged-1").glob("part-*.json") if p.stat().st_size) == 2


def test_rules_of_single_rows(spark):
    sources = spark.createDataFrame([("a", 48000, "pcm_s24le", 24, 480, 1.0), ("b", 44100, "pcm_s16le", 16, 441, 1.0), ("c", 44100, "aac", 24, 441, 1.0), ("d", 44100, "aac", 24, 441, 1.0)], "take_id string, rate int, codec string, bits int, samples long, seconds double")
    proxies = spark.createDataFrame([("b", 48000, "pcm_s24le", 24, 484), ("c", 44100, "aac", 16, 500)], "take_id string, rate int, codec string, bits int, samples long")
    plan, found = rules.edit_plan(sources, proxies)
    assert {r.take_id: r.action for r in plan.collect()} == {"a": "reuse-source", "b": "reuse-existing", "c": "regenerate", "d": "generate"}
    assert {(r.take_id, r.code[11:]) for r in found.collect()} == {(t, c) for t in "cd" for c in ("sample_rate_mismatch", "codec_mismatch", "bit_depth_mismatch", "sample_count_mismatch")}
    plan, found = rules.edit_plan(sources, proxies, dry_run=True)
    assert {r.take_id: (r.action, r.edit_samples) for r in plan.collect()} == {"a": ("reuse-source", 480), "b": ("reuse-existing", 484), "c": ("would-generate", 480), "d": ("would-generate", 480)} and found.count() == 0
    roots = spark.createDataFrame([("/a", "/b")], "planned string, given string")
    targets = spark.createDataFrame([("t1", None, False), ("t1", "x", False)], "take_id string, target string, exists boolean")
    none = spark.createDataFrame([], "source string")
    got = grouping.preflight(none, none, targets, spark.createDataFrame([], "code string, severity string"), roots).collect()
    assert {tuple(r) for r in got} == {("target_missing", "t1"), ("other_root", "/b")}

import hashlib
import io

import pytest
from cadenza.llm import warc


def pages():
    big = "é" * 600
    return [(1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (5, "http://a b/\n3", "x" * 1000), (3, None, "x" * 999), (4, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", big), (9, "u", big), (9, "u", big), (10, "u", "a\r\n\r\nb" * 400), (11, "u", "z" * 3_000_000)]


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        first = max(same, default=None)
        revisit = len(data) >= 1000 and len(same) > 1 and page_id != first
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archive_equals_brute_force(spark):
    rows = spark.createDataFrame([(*r, 1, "q") for r in pages()], "page_id long, url string, html string, offset int, file string").repartition(3)
    got = [tuple(r) for r in warc.archive(rows).collect()]
    assert sorted(got, key=str) == brute(pages())


def test_small_files_null_ids_and_empty_table(spark, monkeypatch):
    rows = [(None, "u", "y" * 2000), (None, "u", "y" * 2000), (3, "u", "y" * 2000), (4, None, None)]
    got = [tuple(r) for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    digest = hashlib.sha1(b"y" * 2000).hexdigest()
    assert sorted(got, key=str) == sorted([(None, 2000, digest, "revisit", 3)] * 2 + [(3, 2000, digest, "response", None), (4, 0, hashlib.sha1(b"").hexdigest(), "response", None)], key=str)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nbody\n\nwith lines\n", b"", b"x" * 3_000_000]
    data = warc._member(warc.arc_head("f.arc.gz", version)) + b"".join(warc._member(warc.arc_record(f"http://x/{i} y", b, version, "202401020304", "text/html; charset=utf-8")) for i, b in enumerate(blocks))
    got = list(warc.read_arc(io.BytesIO(data)))
    assert [(r.offset, r.url, r.date, r.kind, r.block) for r in got] == [(i + 1, f"http://x/{i}%20y", "202401020304", "text/html; charset=utf-8", b) for i, b in enumerate(blocks)]
    assert warc.iso_date("202401020304") == "2024-01-02T03:04:00Z"
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-100])))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_of_any_compression(version):
    """Plain, one gzip member, one for each record, and members that end anywhere: lengths say where records begin."""
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nbody\n\nhttp://x/9 0.0.0.0 20240102030405 text/html 5\n", b"", b"\n\n", b"x" * 2_500_000]
    middle = "a/b c" if version == 1 else "a/b c 200 sum - 0 f"
    records = [f"http://x/{i} y?q=1.2.3.4 20240101000000 z 1.2.3.4 20240102030405 {middle} {len(b)}\n".encode() + b + b"\n" for i, b in enumerate(blocks)]
    head = warc.arc_head("f", version)
    plain = head + b"".join(records)
    forms = [plain, warc._member(plain), b"".join(map(warc._member, [head, *records])), b"".join(warc._member(plain[i : i + 777_777]) for i in range(0, len(plain), 777_777)), warc._member(plain) + b"\0" * 512]
    for data in forms:
        got = list(warc.read_arc(io.BytesIO(data)))
        assert [(r.url, r.date, r.kind, r.block) for r in got] == [(f"http://x/{i} y?q=1.2.3.4 20240101000000 z", "20240102030405", "a/b c", b) for i, b in enumerate(blocks)]
    for data in (plain + b"left over", plain[:-100], warc._member(plain)[:-9], plain + b"http://x 1.2.3.4 x text/html 3\nabc\n", b"WARC/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(data)))
    assert list(warc.read_arc(io.BytesIO(b""))) == []


def test_foreign_archives_are_converted(spark, tmp_path):
    """Plain and one-member files: types, digests, targets and what revisits refer to."""
    same = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" + b"p" * 1500
    for name, pack in (("a.arc", lambda x: x), ("b.arc.gz", warc._member)):
        data = warc.arc_head(name, 1) + warc.arc_record("http://x/1", same % (1 if name[0] == "a" else 2), 1) + warc.arc_record("dns:x", b"20240101 1.2.3.4", 1, kind="text/dns")
        (tmp_path / name).write_bytes(pack(data))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.arc", "b.arc.gz")], "file string")
    out = warc.convert(files, f"file://{tmp_path}/out").collect()
    got = []
    for (file,) in out:
        with warc._open(file) as stream:
            got += [(h["warc-type"], h.get("warc-target-uri"), len(b)) for h, b in warc.read_warc(stream) if h["warc-type"] != "warcinfo"]
    head = len(same % 1) - 1500
    assert sorted(got) == [("resource", "dns:x", 16)] * 2 + [("response", "http://x/1", head + 1500), ("revisit", "http://x/1", head)]


def test_warc_records_round_trip():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    data = warc._member(warc.warc_head("f")) + warc._member(warc.warc_record("response", {"WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": None}, block))
    (info, _), (head, got) = warc.read_warc(io.BytesIO(data))
    assert info["warc-type"] == "warcinfo" and head["warc-type"] == "response" and got == block and "warc-target-uri" not in head
    assert head["warc-block-digest"] == warc._digest(block)


def test_ids_of_any_type(spark):
    import datetime
    from decimal import Decimal

    big = "x" * 1500
    told = {
        "string": ["a", "b c", "é%20\r\nX-Page-Id: z", "10", "9"], "decimal(20,2)": [Decimal("1.50"), Decimal("2.25"), Decimal("10.00"), Decimal("9.10"), Decimal("-1.00")],
        "date": [datetime.date(2024, 1, d) for d in (1, 2, 30, 4, 5)], "int": [1, 2, 3, 4, 5], "binary": [b"\x00", b"\xff\r\n", b"a", b"b", b""],
    }
    for kind, ids in told.items():
        rows = spark.createDataFrame([(i, "u", big if k < 4 else "short") for k, i in enumerate(ids)], f"page_id {kind}, url string, html string")
        out = warc.archive(rows)
        assert out.schema["page_id"].dataType == out.schema["refers_to"].dataType == rows.schema["page_id"].dataType
        first = max(ids[:4])
        assert sorted(((str(r.page_id), r.record_type, str(r.refers_to)) for r in out.collect())) == sorted((str(i), "response" if k == 4 or i == first else "revisit", "None" if k == 4 or i == first else str(first)) for k, i in enumerate(ids)), kind


def test_one_digest_in_half_of_all_rows(spark):
    rows = [(i, "u", "error, not found. " * 80 if i % 2 else f"page {i} " * 200) for i in range(400)]
    got = [tuple(r) for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()]
    assert sorted(got, key=str) == brute(rows)

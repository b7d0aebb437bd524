"""Legacy ARC archives to WARC, and both formats' writers and readers.

ARC files of version 1 or 2 hold records of one header line, whose fields depend on the
version, and as many bytes as its last field declares; that length alone says where the
next record begins, whether the file is plain, one gzip member or one for each record.
The converter reads them, tells equal payloads apart from new ones over all files, and
writes WARC files in which each
record has an identifier, an ISO timestamp, a type and digests. Files are bounded in
size and named anew by every attempt; the tables of file names that are kept hold those
of successful tasks only, so lost executors and repeated tasks do no harm. Files are
opened by URI where tasks run; only small rows, without payloads, are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import IO, NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.store import keep, shared_folder

# The field names of an ARC header line, by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Files are closed after so many bytes of records.
FILE_BYTES = 32 << 20
#: Equal payloads shorter than this are each kept whole.
REVISIT_BYTES = 1000
LEVEL = 1
#: Bytes read at a time: what follows a gzip member in them is copied.
READ = 1 << 16
#: Tasks that files are dealt to at most.
TASKS = 20_000
#: Places in which the records of one digest, or those that revisit one record, meet it.
SALTS = 16
ARCHIVE_DATE = "20240101000000"


class Record(NamedTuple):
    offset: int
    url: str
    date: str
    kind: str
    block: bytes


def _open(uri: str, write: bool = False) -> IO[bytes]:
    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_stream(path)


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class _Bytes:
    """The bytes of a file, plain or unzipped over all its gzip members, read line by line or by length."""

    def __init__(self, stream: IO[bytes]):
        self.stream, self.held, self.at = stream, b"", 0
        self.raw = stream.read(READ)
        self.unpack = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None
        self.fresh = True  # at the start of a member

    def _more(self) -> bytes:
        """The next bytes; none at the end."""
        while True:
            raw, self.raw = self.raw or self.stream.read(READ), b""
            if self.unpack is None or not raw:
                if not raw and self.unpack is not None and not self.fresh:
                    raise ValueError("the archive ends inside a gzip member")
                return raw
            if self.fresh and not raw.strip(b"\0"):  # padding after the last member
                continue
            data = self.unpack.decompress(raw)
            self.fresh = self.unpack.eof
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            if data:
                return data

    def read(self, size: int) -> bytes:
        """Exactly size bytes."""
        parts, have = [self.held[self.at : self.at + size]], min(size, len(self.held) - self.at)
        self.at += have
        while have < size:
            self.held, self.at = self._more(), 0
            if not self.held:
                raise ValueError(f"the record declares {size} bytes and has {have}")
            parts.append(self.held[: size - have])
            self.at = len(parts[-1])
            have += self.at
        return b"".join(parts)

    def line(self) -> bytes | None:
        """Up to and without the next newline; None at the end. Bytes without one are an error."""
        parts = []
        while True:
            end = self.held.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.held[self.at : end])
                self.at = end + 1
                return b"".join(parts)
            parts.append(self.held[self.at :])
            self.held, self.at = self._more(), 0
            if not self.held:
                if any(parts):
                    raise ValueError("bytes are left over after the last record")
                return None


class _Files:
    """Writes records into files of bounded size, and tells their names."""

    def __init__(self, folder: str, suffix: str, head):
        self.folder, self.suffix, self.head = folder, suffix, head
        self.stream, self.size, self.names = None, 0, []

    def write(self, data: bytes) -> None:
        if self.stream is None:
            name = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            self.names.append(name)
            self.stream, self.size = _open(name, True), 0
            self.stream.write(_member(self.head(name)))
        self.stream.write(_member(data))
        self.size += len(data)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def _field(text: str | None) -> str:
    """A URL as a field of a header line: white space and control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", text) if text else "-"


def arc_head(name: str, version: int) -> bytes:
    body = f"{version} 0 cadenza\n{' '.join(ARC_FIELDS[version])}\n".encode()
    base = name.rpartition("/")[2]
    middle = "text/plain" if version == 1 else "text/plain 200 - - 0 " + base
    return f"filedesc://{base} 0.0.0.0 {ARCHIVE_DATE} {middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str | None, block: bytes, version: int, date: str = ARCHIVE_DATE, kind: str = "text/html") -> bytes:
    middle = kind if version == 1 else f"{kind} 200 {hashlib.md5(block).hexdigest()} - 0 -"
    return f"{_field(url)} 0.0.0.0 {date} {middle} {len(block)}\n".encode() + block + b"\n"


def http_message(page_id: object, payload: bytes) -> bytes:
    """A response with the page's id, as text, in a header of its own; what a header line can't hold is percent-encoded."""
    own = b"" if page_id is None else f"X-Page-Id: {quote(str(page_id))}\r\n".encode()
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def _header(line: str, version: int) -> tuple[str, str, str, int]:
    """(url, date, type, length) of a header line; URLs and types may hold spaces, the fields beside them don't."""
    after = len(ARC_FIELDS[version]) - 5
    found = re.fullmatch(r"(.*) (\S+) (\d{8,14}) (.*?)" + r" (\S+)" * after + r" (\d+)", line)
    if found is None:
        raise ValueError(f"no header line of version {version}: {line[:200]}")
    return found[1], found[3], found[4], int(found[found.re.groups])


def read_arc(stream: IO[bytes]) -> Iterator[Record]:
    """Records after the file's own, which says the version; header fields by that version, blocks by the declared lengths."""
    data, version = _Bytes(stream), 0
    number = 0
    while (line := data.line()) is not None:
        text = line.decode("utf-8", "surrogateescape").rstrip("\r")
        if not text:  # between records
            continue
        if not version:
            if not text.startswith("filedesc://"):
                raise ValueError("no ARC file")
            block = data.read(int(text.rpartition(" ")[2]))
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"no version {version} of ARC")
            continue
        url, date, kind, size = _header(text, version)
        number += 1
        yield Record(number, url, date, kind, data.read(size))


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, head, payload) of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + b"\r\n\r\n", payload


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def iso_date(date: str) -> str:
    """An ARC date of 12 or 14 digits."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"


def warc_record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_head(name: str) -> bytes:
    base = name.rpartition("/")[2]
    block = b"software: cadenza\r\nformat: WARC File Format 1.1\r\n"
    return warc_record("warcinfo", {"WARC-Record-ID": record_id(name, 0), "WARC-Date": iso_date(ARCHIVE_DATE), "WARC-Filename": base, "Content-Type": "application/warc-fields"}, block)


def read_warc(stream: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; header names lower-cased, blocks by the declared lengths."""
    data = _Bytes(stream)
    while (line := data.line()) is not None:
        if not line.strip():  # between records
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        headers = {}
        while line := (data.line() or b"").rstrip(b"\r"):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            headers[k.lower()] = v.strip()
        yield headers, data.read(int(headers["content-length"]))


def _as_text(page_id: Column, kind: str) -> Column:
    return F.hex(page_id) if kind == "binary" else page_id.cast("string")


def _from_text(page_id: Column, kind: str) -> Column:
    return F.unhex(page_id) if kind == "binary" else page_id.cast(kind)


def _spread(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with groups, which have one row for each key; the rows of a key meet it in SALTS places."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("file", "offset"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(file): ARC files of HTTP messages, of version 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + uuid.uuid4().int % 2
        files = _Files(folder, ".arc.gz", lambda name: arc_head(name, version))
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files.write(arc_record(url, http_message(page_id, (html or "").encode()), version))
        files.close()
        yield _rows([(name,) for name in files.names], pa.schema([("file", pa.string())]))

    told = _as_text(F.col(id_col), pages.schema[id_col].dataType.simpleString()).alias("page_id")
    return pages.select(told, url_col, html_col).mapInArrow(run, "file string")


def _apart(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows, each file's together, in a task for each file up to TASKS: names are too small for Spark to tell the work by, and ranges deal them evenly."""
    return (files if rows is None else rows).repartitionByRange(max(1, min(files.count(), TASKS)), "file")


def scan_arc(files: DataFrame) -> DataFrame:
    """(file, offset, page_id, bytes, digest) of the records of ARC files; ids as text."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.string()), ("bytes", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with _open(file) as stream:
                    for r in read_arc(stream):
                        headers, _, payload = split_http(r.block) if r.block.startswith(b"HTTP/") else ({}, b"", r.block)
                        page_id = headers.get("x-page-id")
                        rows.append((file, r.offset, None if page_id is None else unquote(page_id), len(payload), _digest(payload)))
                yield _rows(rows, schema)

    return _apart(files).mapInArrow(run, "file string, offset long, page_id string, bytes long, digest string")


def convert(files: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """(file): the WARC files made of ARC files; page ids are of a kind.

    Of the records with one payload digest and at least REVISIT_BYTES the one with the
    largest page id stays a response (rows that repeat that id do too); the others become
    revisits of it.
    """
    records = scan_arc(files)
    records = keep(records.withColumn("page_id", _from_text(F.col("page_id"), kind)), folder)
    large = records.where(F.col("bytes") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.max(F.struct("page_id", "file", "offset")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = _spread(large, first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select("file", "offset", F.col("first.file").alias("to_file"), F.col("first.offset").alias("to_offset"))
    # every file has a row, whether it has revisits or none
    todo = files.select("file", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("string").alias("to_file"), F.lit(None).cast("long").alias("to_offset")).unionByName(marked)

    def one(file: str, revisits: dict[int, tuple[str, int]]) -> list[str]:
        out = _Files(folder, ".warc.gz", warc_head)
        with _open(file) as stream:
            for r in read_arc(stream):
                http = r.block.startswith(b"HTTP/")
                _, head, payload = split_http(r.block) if http else ({}, b"", r.block)
                headers = {
                    "WARC-Record-ID": record_id(file, r.offset), "WARC-Date": iso_date(r.date), "WARC-Target-URI": None if r.url == "-" else _field(r.url),
                    "Content-Type": "application/http; msgtype=response" if http else r.kind, "WARC-Payload-Digest": _digest(payload),
                }
                if r.offset in revisits:
                    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(*revisits[r.offset])}
                    out.write(warc_record("revisit", headers, head))
                else:
                    out.write(warc_record("response" if http else "resource", headers, r.block))
        out.close()
        return out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, revisits, names = None, {}, []
        for batch in batches:
            for file, offset, to_file, to_offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    if now is not None:
                        names += one(now, revisits)
                    now, revisits = file, {}
                if offset is not None:
                    revisits[offset] = (to_file, to_offset)
        if now is not None:
            names += one(now, revisits)
        yield _rows([(n,) for n in names], pa.schema([("file", pa.string())]))

    return keep(_apart(files, todo).sortWithinPartitions("file", "offset").mapInArrow(run, "file string"), folder)


def scan_warc(files: DataFrame) -> DataFrame:
    """(file, offset, page_id, payload_bytes, payload_digest, record_type, record_id, refers) of the records of WARC files, without warcinfo; ids as text."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with _open(file) as stream:
                    for warc, block in read_warc(stream):
                        kind = warc["warc-type"]
                        if kind == "warcinfo":
                            continue
                        headers, _, payload = split_http(block) if block.startswith(b"HTTP/") else ({}, b"", block)
                        size = int(headers["content-length"]) if kind == "revisit" else len(payload)
                        digest = _hex(warc["warc-payload-digest"])
                        if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{file}: a payload does not fit its digest")
                        page_id = headers.get("x-page-id")
                        rows.append((file, len(rows), None if page_id is None else unquote(page_id), size, digest, kind, warc["warc-record-id"], warc.get("warc-refers-to")))
                yield _rows(rows, schema)

    return _apart(files).mapInArrow(run, "file string, offset long, page_id string, payload_bytes long, payload_digest string, record_type string, record_id string, refers string")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the WARC files.

    The pages go to ARC files, those through the converter, and the WARC files are read.
    A null html is an empty payload; a null url leaves its record without target, a null
    page id without one, below all others; ids may be of any type that text can spell, and
    come back as that type. Rows that repeat a page are records each.
    Pages of any length are written and read whole, one record at a time. Other columns
    are ignored; an empty table makes no files and gives no rows.
    """
    folder, kind = shared_folder(pages.sparkSession), pages.schema[id_col].dataType.simpleString()
    arcs = keep(write_arc(pages, f"{folder}/arc", id_col, url_col, html_col), folder)
    rows = scan_warc(convert(arcs, f"{folder}/warc", kind))
    rows = keep(rows.withColumn("page_id", _from_text(F.col("page_id"), kind)), folder)
    wanted = rows.where("refers is not null").select("refers").distinct()
    targets = rows.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")).join(wanted, "refers", "left_semi")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    whole = rows.where("refers is null").select(*columns, F.lit(None).cast(kind).alias("refers_to"))
    return whole.unionByName(_spread(rows.where("refers is not null"), targets, "refers").select(*columns, "refers_to"))

"""Reports: small documents for people, written on the driver; data go through DataFrame writers."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.scalars import markdown_value


def write_text(path: str, text: str) -> None:
    """All or nothing: a file beside it takes its place when it is whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)


def write_json(path: str, payload: object) -> None:
    write_text(path, json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def report_rows(rows: DataFrame, limit: int = 10_000) -> list[dict]:
    """The rows of a report; one that is too long for a report is an error, not cut."""
    out = [r.asDict(recursive=True) for r in rows.limit(limit + 1).collect()]
    if len(out) > limit:
        raise ValueError(f"a report of more than {limit} rows; write the table instead")
    return out


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> str:
    """A Markdown table, its cells escaped by Spark."""
    cells = rows.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_value(F.col(c)) for c in columns)), F.lit(" |")).alias("line"))
    return "\n".join([f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}", *(r["line"] for r in report_rows(cells))])


def markdown_report(path: str, title: str, status: str, counts: dict[str, int], sections: dict[str, str]) -> None:
    head = [f"# {title}", "", f"- status: {status}", *(f"- {k}: {v}" for k, v in counts.items())]
    write_text(path, "\n".join(head) + "".join(f"\n\n## {name}\n\n{text}" for name, text in sections.items()) + "\n")


def handoff(takes: DataFrame, cameras: DataFrame) -> DataFrame:
    """(take_id, edit_audio, cameras): what an operator is handed, cameras in their order."""
    own = cameras.groupBy("take_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label", "file"))), lambda c: F.struct(c["label"], c["file"])).alias("cameras"))
    return takes.select("take_id", F.coalesce("edit_audio", "master_audio").alias("edit_audio")).join(own, "take_id", "left")


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> str | None:
    """Add rows to a log of JSON lines; a log with a line that is none is begun afresh, and lies beside it under the name that is given back."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    moved = None
    if system.exists(files):
        told = F.from_json("value", f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _damaged string", {"columnNameOfCorruptRecord": "_damaged"})
        lines = spark.read.text(path).where("trim(value) <> ''")
        if not lines.where(told["_damaged"].isNotNull()).isEmpty():
            n = 1
            while system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.damaged-{n}")):
                n += 1
            moved = f"{path}.damaged-{n}"
            if not system.rename(files, spark._jvm.org.apache.hadoop.fs.Path(moved)):
                raise OSError(f"{path} is damaged and cannot be moved to {moved}")
    rows.write.mode("append").json(path)
    return moved


def staged(moves: list[tuple[str, str]], then: Callable[[], None]) -> None:
    """Rename files, then call; if anything fails, every rename is undone."""
    done: list[tuple[str, str]] = []
    try:
        for a, b in moves:
            if os.path.exists(b):
                raise FileExistsError(b)
            os.makedirs(os.path.dirname(b), exist_ok=True)
            os.rename(a, b)
            done.append((a, b))
        then()
    except BaseException:
        for a, b in reversed(done):
            os.rename(b, a)
        raise

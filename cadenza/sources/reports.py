"""Documents for people and for the next run: Markdown, YAML and JSON of a session's tables.

Tables stay tables until they are reports: cells are formatted and escaped by Spark, and a
report that is too long for one is an error (``sinks.report_rows``).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.sources.sinks import markdown_table, report_rows, write_json, write_text


def three(c: Column | str) -> Column:
    """A number with three decimals; empty for null."""
    return F.coalesce(F.format_string("%.3f", F.col(c) if isinstance(c, str) else c), F.lit(""))


def iso_time(c: Column) -> Column:
    """A UTC timestamp as ISO 8601 text, with microseconds where there are any."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(c, "SSSSSS") != "000000", F.date_format(c, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def overall(found: DataFrame) -> str:
    """PASS, WARN or FAIL of issues."""
    return found.agg(S.status(F.max(S.severity_rank(F.col("severity"))))).first()[0]


def summary_line(status: str, summary: str | None = None, payload: dict | None = None) -> str:
    """What a command prints: its payload as JSON, or its status and summary."""
    if payload is not None:
        return json.dumps(payload, indent=2, ensure_ascii=False)
    return f"{status}: {summary}" if summary else status


def _section(title: str, body: str) -> str:
    return f"## {title}\n\n{body}"


def _listed(rows: DataFrame, line: Column, *order: str) -> str:
    return "\n".join(r["line"] for r in report_rows(rows.orderBy(*order).select(line.alias("line")))) or "- none"


def plan_markdown(takes: DataFrame, buckets: DataFrame, found: DataFrame, generated_at: str) -> str:
    """The grouping plan of one session: takes, labels, issues, and what is left out or open.

    takes (take_id, audio, video, label, pair_score, confidence), buckets (source,
    media_type, bucket, reason, confidence), found (code, severity, subject).
    """
    per = takes.groupBy("take_id").agg(
        F.min(S.path_name(F.col("audio"))).alias("Audio"), F.count(F.lit(1)).alias("Videos"), three(F.max("confidence")).alias("Confidence"), F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("Labels")
    ).withColumnRenamed("take_id", "Take")
    angles = takes.select(F.col("take_id").alias("Take"), F.col("label").alias("Angle"), S.path_name(F.col("video")).alias("Source"), F.concat("label", S.path_suffix(F.col("video"))).alias("Target"), three("pair_score").alias("Pair"))
    issues = found.select(F.col("severity").alias("Severity"), F.col("code").alias("Code"), F.col("subject").alias("Subject"))
    named = [r["label"] for r in report_rows(takes.select("label").distinct().orderBy("label"))]
    head = f"# Grouping plan\n\n- Status: {overall(found)}\n- Generated at: {generated_at}\n- Angles: {', '.join(named) or 'not available'}\n- Takes: {per.count()}"
    line = F.concat(F.lit("- "), "media_type", F.lit(": `"), "source", F.lit("` ("), "reason", F.lit(", confidence "), three("confidence"), F.lit(")"))
    parts = [
        head, _section("Take summary", markdown_table(per, ["Take", "Audio", "Videos", "Confidence", "Labels"], ["Take"])), _section("Angles", markdown_table(angles, ["Take", "Angle", "Source", "Target", "Pair"], ["Take", "Angle", "Source"])),
        *([] if issues.isEmpty() else [_section("Issues", markdown_table(issues, ["Severity", "Code", "Subject"], ["Severity", "Code", "Subject"]))]),
        *(_section(f"{kind.capitalize()} media", _listed(buckets.where(F.col("bucket") == kind), line, "media_type", "source")) for kind in ("excluded", "unresolved")),
    ]
    return "\n\n".join(parts) + "\n"


def order_markdown(order: DataFrame, ranks: DataFrame, found: DataFrame, generated_at: str) -> str:
    """The inferred order of one session's takes with its evidence: order (position, take_id, confidence, evidence_groups, average_rank), ranks (grp, media_type, position, take_id)."""
    rows = order.select(F.col("position").alias("Position"), F.col("take_id").alias("Take"), F.col("confidence").alias("Confidence"), F.col("evidence_groups").alias("Evidence"), three("average_rank").alias("Rank"))
    groups = ranks.groupBy(F.col("grp").alias("Group"), F.col("media_type").alias("Media")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "take_id"))), lambda x: x["take_id"]), " -> ").alias("Order"))
    issues = _listed(found, F.concat(F.lit("- "), "severity", F.lit(": "), "code", F.lit(" ("), "subject", F.lit(")")), "code", "subject")
    return "\n\n".join([
        f"# Take order\n\n- Status: {overall(found)}\n- Generated at: {generated_at}", _section("Inferred order", markdown_table(rows, ["Position", "Take", "Confidence", "Evidence", "Rank"], ["Position"])),
        _section("Evidence", markdown_table(groups, ["Group", "Media", "Order"], ["Group"])), _section("Issues", issues),
    ]) + "\n"


def issues_markdown(title: str, found: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], generated_at: str) -> str:
    """A report of a stage: its status, tables (rows, columns; ordered by all columns) and issues."""
    parts = [f"# {title}\n\n- Status: {overall(found)}\n- Generated at: {generated_at}\n- Issues: {found.count()}"]
    parts += [_section(name, markdown_table(rows, columns, columns)) for name, (rows, columns) in tables.items()]
    columns = [c for c in ("session", "take_id", "severity", "code", "subject") if c in found.columns]
    return "\n\n".join([*parts, _section("Issues", markdown_table(found, columns, columns))]) + "\n"


def handoff_documents(handed: DataFrame, folder: str, session: str) -> None:
    """``handoff`` rows (take_id, edit_audio, cameras) of one session as JSON and as Markdown."""
    rows = report_rows(handed.orderBy("take_id"))
    write_json(f"{folder}/handoff.json", {"session": session, "takes": rows})
    lines = [f"# Handoff {session}", ""]
    for row in rows:
        lines += [f"- {row['take_id']}: {row['edit_audio']}", *(f"  - {c['label']}: {c['file']}" for c in row["cameras"] or [])]
    write_text(f"{folder}/handoff.md", "\n".join(lines) + "\n")


def write_yaml(rows: DataFrame, path_of: Callable[[dict], str], leave_out: tuple[str, ...] = ()) -> list[str]:
    """One YAML document for each row, at the path that path_of names, fields in their order; the paths."""
    paths = []
    for row in report_rows(rows):
        paths.append(path_of(row))
        write_text(paths[-1], yaml.safe_dump({k: v for k, v in row.items() if k not in leave_out}, allow_unicode=True, sort_keys=False))
    return paths

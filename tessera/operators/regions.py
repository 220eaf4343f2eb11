"""Regions of a document that its own lines give away, and sources that are numbered paragraphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import stream_groups
from .intervals import place, segments
from .lines import islands

#: A numbered paragraph, such as "(12) Whereas ...".
NUMBERED = r"^\s*\((\d{1,6})\)\s"


@dataclass(frozen=True)
class Run:
    """A stretch of at least ``least`` neighbouring lines that all match, such as a table of contents."""

    reason: str
    priority: int
    pattern: str
    least: int = 2


@dataclass(frozen=True)
class From:
    """From a matching line up to the next one that matches ``stop``, or to the document's end, such as references."""

    reason: str
    priority: int
    start: str
    stop: str | None = None


Rule = Run | From


def _runs(lines: DataFrame, rule: Run) -> DataFrame:
    found = islands(lines.where(F.col("text").rlike(rule.pattern)).select("document_id", "line_pos"), "document_id").where(F.col("line_count") >= rule.least)
    return found.select("document_id", "start_pos", (F.col("end_pos") + 1).alias("stop_pos"))


def _from(lines: DataFrame, ends: DataFrame, rule: From) -> DataFrame:
    start = F.col("text").rlike(rule.start)
    stop = F.col("text").rlike(rule.stop) if rule.stop else F.lit(False)
    # only lines that start or stop something are put in order
    marks = lines.where(start | stop).select("document_id", "line_pos", start.alias("s"), stop.alias("e"))
    after = Window.partitionBy("document_id").orderBy("line_pos").rowsBetween(1, Window.unboundedFollowing)
    rows = marks.withColumn("stop_pos", F.min(F.when(F.col("e"), F.col("line_pos"))).over(after)).where("s").join(ends, "document_id")
    return rows.select("document_id", F.col("line_pos").alias("start_pos"), F.coalesce("stop_pos", "line_count").alias("stop_pos"))


def find(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """document_id, start_pos, stop_pos, priority, reason of every region of ``lines``; regions may overlap."""
    ends = lines.groupBy("document_id").agg((F.max("line_pos") + 1).alias("line_count"))
    out = None
    for rule in rules:
        rows = _runs(lines, rule) if isinstance(rule, Run) else _from(lines, ends, rule)
        rows = rows.select("document_id", F.col("start_pos").cast("long").alias("start_pos"), F.col("stop_pos").cast("long").alias("stop_pos"), F.lit(rule.priority).alias("priority"), F.lit(rule.reason).alias("reason"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no rules")
    return out


def exclusions(lines: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, line_pos, reason of each line in a region: of several, the one with the least priority, then the least name."""
    stretches = segments(found.select("document_id", "start_pos", "stop_pos", F.col("reason").alias("owner"), F.col("priority").alias("rank")))
    rows = place(lines.select("document_id", "line_pos"), stretches)
    return rows.where("owner IS NOT NULL").select("document_id", "line_pos", F.col("owner").alias("reason"))


def longest_chain(numbers: list[int]) -> list[int]:
    """Places of the longest run n, n + 1, ... in order, whatever stands between; of equally long ones the first.

    For a number the first place from which it goes on is never worse than a
    later one, so one pass from the end with a place for each number finds it.
    """
    best: dict[int, tuple[int, int, int | None]] = {}  # number: length, place, next place
    links: dict[int, int | None] = {}
    top = (0, 0)
    for i in range(len(numbers) - 1, -1, -1):
        length, after = 1, None
        if (follows := best.get(numbers[i] + 1)) is not None:
            length, after = follows[0] + 1, follows[1]
        best[numbers[i]], links[i] = (length, i, after), after
        top = max(top, (length, -i))
    out, at = [], -top[1] if numbers else None
    while at is not None:
        out.append(at)
        at = links[at]
    return out


def numbered_sources(lines: DataFrame, bounds: DataFrame, key: str = "recital", pattern: str = NUMBERED, reference: Column | None = None) -> DataFrame:
    """Spans of a region's numbered paragraphs and of what stands before the first: document_id, source_key, unit_kind, number, start_pos, stop_pos.

    ``bounds`` has a region (start_pos, stop_pos) for a document. Lines whose
    number starts a reference (``reference``) are no candidates; of the others
    the longest chain of consecutive numbers counts, so that cross-references,
    repeated numbers and interrupting lists start no source. Each source ends
    where the next begins, so every line of the region is in exactly one.
    """
    inside = lines.join(bounds.select("document_id", "start_pos", "stop_pos"), "document_id").where("line_pos >= start_pos AND line_pos < stop_pos")
    number = F.regexp_extract("text", pattern, 1)
    rows = inside.where(number != "") if reference is None else inside.where((number != "") & ~reference)
    rows = rows.select("document_id", F.col("line_pos").cast("long").alias("line_pos"), number.cast("long").alias("number"))

    def chain(document: object, group: dict[str, list]) -> list[tuple]:
        return [(document, group["line_pos"][i], group["number"][i]) for i in longest_chain(group["number"])]

    found = stream_groups(rows, "document_id", "line_pos", chain, rows.schema).join(bounds, "document_id")
    following = F.lead("line_pos").over(Window.partitionBy("document_id").orderBy("line_pos"))
    paragraphs = found.select("document_id", F.format_string(f"{key}-%03d", "number").alias("source_key"), F.lit(key).alias("unit_kind"), "number", F.col("line_pos").alias("start_pos"), F.coalesce(following, F.col("stop_pos").cast("long")).alias("stop_pos"))
    first = found.groupBy("document_id").agg(F.min("line_pos").alias("first"))
    front = bounds.join(first, "document_id", "left").select("document_id", F.lit("frontmatter").alias("source_key"), F.lit("frontmatter").alias("unit_kind"), F.lit(None).cast("long").alias("number"), F.col("start_pos").cast("long").alias("start_pos"), F.coalesce("first", "stop_pos").cast("long").alias("stop_pos"))
    return paragraphs.unionByName(front).where("start_pos < stop_pos")


def source_lines(lines: DataFrame, sources: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``lines`` that stand in one of ``sources``, with source_key; lines in ``excluded`` are left out."""
    stretches = segments(sources.select("document_id", "start_pos", "stop_pos", F.col("source_key").alias("owner"), F.lit(0).alias("rank")))
    rows = place(lines, stretches).where("owner IS NOT NULL").withColumnRenamed("owner", "source_key").drop("rank", "claims")
    return rows if excluded is None else rows.join(excluded.select("document_id", "line_pos"), ["document_id", "line_pos"], "left_anti")


def extra_sources(sources: DataFrame, kept: DataFrame, label: str) -> DataFrame:
    """``sources`` as :func:`units.logical_sources` takes them as ``extra``: document_id, source_key, unit_kind, label, lines; sources without kept lines are left out."""
    counted = kept.groupBy("document_id", "source_key").agg(F.count("*").alias("lines"))
    name = F.when(F.col("number").isNotNull(), F.concat(F.lit(f"{label} "), F.col("number").cast("string"))).otherwise(F.col("source_key"))
    return sources.join(counted, ["document_id", "source_key"]).select("document_id", "source_key", "unit_kind", name.alias("label"), "lines")

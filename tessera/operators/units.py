"""Packing lines into bounded pieces at safe boundaries, and texts of pieces.

Choosing cuts is sequential within a source, so each source's lines pass whole
through one function; sources are documents' sections, whose size is bounded by
the document, and different sources run apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.groups import stream_groups
from .atoms import best_partition, partition_passages  # noqa: F401

TARGET_WORDS, HARD_WORDS = 384, 512

_PIECES = "source_id string, part_number int, first_order long, last_order long, content_words long, boundary_after string, failure string"
#: Fixed value: what ids of units start with.
UNIT_PREFIX = "candidate-v2"


def greedy_cuts(words: list[int], reasons: list[str | None], context: int = 0, hard: int = HARD_WORDS, target: int = TARGET_WORDS) -> tuple[list[tuple[int, int, int, str]], str | None]:
    """Pieces (first, last, words, reason) and why it failed, if it did.

    The rest is one piece once it fits. Else a piece ends at the first safe
    boundary at or after the target that fits, or else at the last safe one.
    """
    room, want = hard - context, max(1, target - context)
    if not words:
        return [], "no_coordinates"
    if room < 1:
        return [], "context_exhausts_hard_budget"
    left, at, out = sum(words), 0, []
    while at < len(words):
        if left <= room:
            out.append((at, len(words) - 1, left, "end_of_source_unit"))
            return out, None
        total, end, reached = 0, at, None
        last_safe = first_good = None
        while end < len(words) and total + words[end] <= room:
            total += words[end]
            if reached is None and total >= want:
                reached = end
            if reasons[end] is not None:
                last_safe = end
                if first_good is None and reached is not None:
                    first_good = end
            end += 1
        if end == at:
            return out, "single_line_over_budget"
        if reached is None and reasons[end - 1] is not None:
            first_good = end - 1
        cut = first_good if first_good is not None else last_safe
        if cut is None:
            return out, "no_corrected_safe_boundary"
        size = sum(words[at : cut + 1])
        out.append((at, cut, size, reasons[cut]))
        left, at = left - size, cut + 1
    return out, None


def greedy_pack(lines: DataFrame, context_words: int = 0, hard_words: int = HARD_WORDS, target_words: int = TARGET_WORDS) -> DataFrame:
    """Pieces of every source. ``lines`` has source_id, line_order, words, reason (null: no safe boundary)."""
    if context_words < 0 or hard_words < 1:
        raise ValueError("context_words must be 0 or more, hard_words positive")

    def run(key: str, group: dict[str, list]) -> list[tuple]:
        order = group["line_order"]
        pieces, failure = greedy_cuts(group["words"], group["reason"], context_words, hard_words, target_words)
        rows = [(key, i + 1, order[a], order[b], n, r, None) for i, (a, b, n, r) in enumerate(pieces)]
        return [*rows, (key, 0, None, None, None, None, failure)] if failure else rows

    return stream_groups(lines.select(F.col("source_id").cast("string").alias("source_id"), F.col("line_order").cast("long"), F.col("words").cast("long"), "reason"), "source_id", "line_order", run, _PIECES)


def reference_entries(lines: DataFrame, start: Column) -> DataFrame:
    """``lines`` with ``entry``: how many entries have started up to each; 0 is before the first."""
    w = Window.partitionBy("source_id").orderBy("line_order").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("entry", F.sum(start.cast("int")).over(w))


def pack_entries(lines: DataFrame, hard_words: int = HARD_WORDS, target_words: int = TARGET_WORDS) -> DataFrame:
    """source_id, entry, words, pack: whole entries in packs that stay within ``hard_words``.

    A pack ends before an entry that would overflow it and once it has
    ``target_words``. An entry above the bound is a pack of its own.
    """
    entries = lines.groupBy("source_id", "entry").agg(F.sum("words").alias("words"))
    entries = entries.select("source_id", F.col("entry").cast("long").alias("entry"), F.col("words").cast("long").alias("words"))

    def run(source: object, group: dict[str, list]) -> list[tuple]:
        out, size, pack = [], 0, 1
        for entry, words in zip(group["entry"], group["words"], strict=True):
            if size > 0 and (size + words > hard_words or size >= target_words):
                size, pack = 0, pack + 1
            size += words
            out.append((source, entry, words, pack))
        return out

    return stream_groups(entries, "source_id", "entry", run, f"source_id {dict(entries.dtypes)['source_id']}, entry long, words long, pack int")


def passage_texts(pieces: DataFrame, lines: DataFrame, label: Column | None = None) -> DataFrame:
    """source_id, passage_number, citation_text, retrieval_text.

    Lines are stripped and joined; where a position is left out within a page
    a blank line stands, elsewhere a line break. The label leads the retrieval
    text only. ``lines`` has source_id, line_order, page_number, line_pos, text.
    """
    keys = ["source_id", "passage_number"]
    wide = pieces.select(*keys, F.explode(F.sequence("first_order", "last_order")).alias("line_order"))
    rows = wide.join(lines, ["source_id", "line_order"])
    part = F.struct("line_order", "page_number", "line_pos", T.strip(F.col("text")).alias("text"))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("l"))
    before = F.concat(F.array(F.lit(None).cast(listed.schema["l"].dataType.elementType)), "l")

    def piece(x: Column, last: Column) -> Column:
        gap = F.when(last.isNull(), "").when((x["line_pos"] != last["line_pos"] + 1) & (x["page_number"] == last["page_number"]), "\n\n").otherwise("\n")
        return F.when(x.isNull(), "").otherwise(F.concat(gap, x["text"]))

    out = listed.select(*keys, F.array_join(F.zip_with("l", before, piece), "").alias("citation_text"))
    lead = F.concat(label, F.lit("\n\n")) if label is not None else F.lit("")
    return out.withColumn("retrieval_text", F.concat(lead, F.col("citation_text")))


def part_violations(units: DataFrame) -> DataFrame:
    """logical_source_key and rule of sources whose parts don't run from 1 or mix kinds and documents."""
    found = units.groupBy("logical_source_key").agg(
        F.count("*").alias("n"), F.min("part_number").alias("lo"), F.max("part_number").alias("hi"), F.count_distinct("part_number").alias("d"),
        F.count_distinct("unit_kind").alias("kinds"), F.count_distinct("document_id").alias("documents"),
    )
    rule = F.when((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")), "parts with a gap").when((F.col("kinds") > 1) | (F.col("documents") > 1), "mixed source")
    return found.select("logical_source_key", rule.alias("rule")).where("rule IS NOT NULL")


def boundary_pairs(units: DataFrame) -> DataFrame:
    """Neighbouring parts of a source with the first one's boundary."""
    w = Window.partitionBy("logical_source_key").orderBy("part_number")
    rows = units.withColumn("next_unit_id", F.lead("unit_id").over(w))
    return rows.where("next_unit_id IS NOT NULL").select("logical_source_key", "unit_id", "next_unit_id", "boundary_after")


def logical_sources(nodes: DataFrame, content: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """document_id, source_key, unit_kind, label, lines of everything that is to be packed.

    A heading with content is a ``heading_body``, a leaf without any a
    ``heading_only``; containers without content are left out. ``nodes`` has
    node_id, document_id, ancestor_ids and full_heading, ``content`` node_id
    and line_pos of lines that no rule excludes. ``extra`` are sources found
    by other rules, in the same columns.
    """
    lines = content.groupBy("node_id").agg(F.count("*").alias("lines"))
    inner = nodes.select(F.explode("ancestor_ids").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    rows = nodes.join(lines, "node_id", "left").join(inner, "node_id", "left")
    kind = F.when(F.col("lines") > 0, "heading_body").when(F.col("inner").isNull(), "heading_only")
    out = rows.select("document_id", F.col("node_id").alias("source_key"), kind.alias("unit_kind"), label(F.col("full_heading"), F.col("node_id")).alias("label"), F.coalesce("lines", F.lit(0).cast("long")).alias("lines"))
    out = out.where("unit_kind IS NOT NULL")
    return out.unionByName(extra) if extra is not None else out


def label(*choices: Column) -> Column:
    """The first choice that isn't blank."""
    return F.coalesce(*[F.when(T.strip(c) != "", T.collapse_spaces(c)) for c in choices])


def materialize_units(pieces: DataFrame, sources: DataFrame) -> DataFrame:
    """Pieces of a packing as units with ids, part counts and their source's kind and label."""
    good = pieces.where("failure IS NULL").withColumn("part_count", F.count("*").over(Window.partitionBy("source_id")).cast("int"))
    known = sources.withColumnRenamed("source_key", "source_id")
    key = F.concat_ws(":", F.lit(UNIT_PREFIX), F.col("document_id").cast("string"), "source_id")
    return good.join(known, "source_id").select(
        F.format_string("%s:part-%03d", key, F.col("part_number")).alias("unit_id"), key.alias("logical_source_key"), "document_id", "source_id", "unit_kind", "label", "part_number", "part_count",
        "first_order", "last_order", "content_words", "boundary_after",
    )


def coverage_violations(pieces: DataFrame, lines: DataFrame) -> DataFrame:
    """source_id and rule of sources whose pieces don't hold every line and word exactly once."""
    want = lines.groupBy(F.col("source_id").cast("string").alias("source_id")).agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    wide = pieces.where("failure IS NULL").select("source_id", F.explode(F.sequence("first_order", "last_order")).alias("line_order"))
    held = wide.join(lines.select(F.col("source_id").cast("string").alias("source_id"), "line_order"), ["source_id", "line_order"], "left_semi").groupBy("source_id").agg(F.count("*").alias("held"), F.count_distinct("line_order").alias("d"))
    words = pieces.where("failure IS NULL").groupBy("source_id").agg(F.sum("content_words").alias("packed"))
    rows = want.join(held, "source_id", "left").join(words, "source_id", "left")
    rule = F.when(F.coalesce("held", F.lit(0)) != F.col("n"), "lines").when(F.col("held") != F.col("d"), "line twice").when(F.col("packed") != F.col("w"), "words")
    return rows.select("source_id", rule.alias("rule")).where("rule IS NOT NULL")


def structural_context(document_id: Column, line_pos: Column, contexts: dict[str, list[tuple[int, str]]]) -> Column:
    """Ids of the reviewed part that a source's first line stands in, as an array; empty before the first part.

    ``contexts`` has each document's parts as (first line, id).
    """
    none = F.array().cast("array<string>")
    out = none
    for document, parts in contexts.items():
        within = none
        for start, ident in sorted(parts):
            within = F.when(line_pos >= start, F.array(F.lit(ident))).otherwise(within)
        out = F.when(document_id == document, within).otherwise(out)
    return out

"""The line table of a corpus, and windows over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import place, segments


def in_document() -> WindowSpec:
    return Window.partitionBy("document_id").orderBy("line_pos")


def in_page() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("line_number")


def line_table(pages: DataFrame, split: Callable[[Column], Column] = T.split_lines) -> DataFrame:
    """document_id, page_id, page_number, line_number, line_pos, text, page_line_count.

    Lines are numbered from 1 in their page, positions from 0 in their
    document. A document's positions need no window over its lines: the lines
    of earlier pages are summed, one number a page.
    """
    pages = pages.select("document_id", "page_id", "page_number", split(F.col("text")).alias("lines"))
    pages = pages.withColumn("page_line_count", F.size("lines").cast("long"))
    before = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("base", F.coalesce(F.sum("page_line_count").over(before), F.lit(0)))
    out = pages.select("document_id", "page_id", "page_number", "page_line_count", "base", F.posexplode("lines").alias("at", "text"))
    return out.select("document_id", "page_id", "page_number", (F.col("at") + 1).alias("line_number"), (F.col("base") + F.col("at")).alias("line_pos"), "text", "page_line_count")


def page_violations(pages: DataFrame) -> DataFrame:
    """document_id and rule of documents whose pages don't run from 1 without a gap, or repeat."""
    found = pages.groupBy("document_id").agg(F.min("page_number").alias("lo"), F.max("page_number").alias("hi"), F.count("*").alias("n"), F.count_distinct("page_number").alias("d"))
    rule = F.when(F.col("n") != F.col("d"), "page repeated").when((F.col("lo") != 1) | (F.col("hi") != F.col("n")), "pages with a gap")
    ids = pages.where(F.col("page_id") != T.page_id(F.col("document_id").cast("string"), F.col("page_number"))).select("document_id", F.lit("page id").alias("rule")).distinct()
    return found.select("document_id", rule.alias("rule")).where("rule IS NOT NULL").unionByName(ids)


def neighbours(lines: DataFrame, scope: WindowSpec | None = None) -> DataFrame:
    """``lines`` with the nearest lines that aren't blank before and after; empty at the ends."""
    scope = scope or in_page()
    clean = T.collapse_spaces(F.col("text"))
    filled = F.when(clean != "", clean)
    previous = F.last(filled, True).over(scope.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(filled, True).over(scope.rowsBetween(1, Window.unboundedFollowing))
    return lines.withColumn("previous_line", F.coalesce(previous, F.lit(""))).withColumn("next_line", F.coalesce(following, F.lit("")))


def previous_filled(lines: DataFrame) -> DataFrame:
    """``lines`` with position and text of the line before that isn't blank, in the document."""
    filled = F.when(T.strip(F.col("text")) != "", F.struct("page_number", "line_number", "text"))
    return lines.withColumn("previous_filled", F.last(filled, True).over(in_document().rowsBetween(Window.unboundedPreceding, -1)))


def islands(lines: DataFrame, *by: str) -> DataFrame:
    """Runs of consecutive positions within ``by``: first, last and number of lines."""
    run = F.col("line_pos") - F.row_number().over(Window.partitionBy(*by).orderBy("line_pos"))
    found = lines.withColumn("run", run).groupBy(*by, "run").agg(F.min("line_pos").alias("start_pos"), F.max("line_pos").alias("end_pos"), F.count("*").alias("line_count"))
    return found.drop("run")


def order_violations(rows: DataFrame, by: str, *order: str, given: str) -> DataFrame:
    """Rows that don't come after the row before them, in the order that they are given in."""
    at = F.struct(*order)
    before = F.lag(at).over(Window.partitionBy(by).orderBy(given))
    return rows.withColumn("_before", before).where(F.col("_before").isNotNull() & ~(F.col("_before") < at)).drop("_before")


def furniture_reason(text: Column, line_number: Column, page_line_count: Column, rules: list[tuple[str, str, int | None, int | None]], collapse: Callable[[Column], Column] = T.collapse_spaces) -> Column:
    """The first matching rule's reason; null for content.

    A rule is (reason, pattern, last line from the top or null, last line from
    the bottom or null). Patterns see the text as ``collapse`` gives it, and
    only a line feed ends a line for them.
    """
    clean, out = collapse(text), F.lit(None).cast("string")
    for reason, pattern, top, bottom in reversed(rules):
        hit = clean.rlike(f"(?d){pattern}")
        if top is not None or bottom is not None:
            place = F.lit(False)
            if top is not None:
                place = place | (line_number <= top)
            if bottom is not None:
                place = place | (line_number > page_line_count - bottom)
            hit = hit & place
        out = F.when(hit, reason).otherwise(out)
    return out


def blank(text: Column) -> Column:
    return T.strip(text) == ""


#: What owns a line, the first before the others; an exclusion stands between heading and front matter.
KINDS = {"content": 1, "heading": 2, "frontmatter": 4}


def ledger(lines: DataFrame, owned: DataFrame, reasons: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One class and owner for every line: content, then heading, then exclusion, then front matter, then blank.

    ``owned`` are spans: document_id, start_pos, stop_pos (exclusive), or
    line_pos for a single line, owner_id and kind (content, heading or
    frontmatter). ``reasons`` has
    document_id, line_pos, priority and reason, ``regions`` spans with priority
    and reason; of several reasons the one with the least priority counts.
    Spans meet lines by a sweep over their ends, not by unrolling them.
    ``lines`` may have a boolean ``blank`` instead of their text, which then
    doesn't travel and is no column of the result.
    """
    if "text" in lines.columns:
        held_by, is_blank = ["text"], blank(F.col("text"))
    else:
        held_by, is_blank = ["blank"], F.col("blank")
    if "line_pos" in owned.columns:
        owned = owned.withColumns({"start_pos": F.col("line_pos"), "stop_pos": F.col("line_pos") + 1})
    rank = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("kind"))
    held = segments(owned.select("document_id", "start_pos", "stop_pos", F.col("owner_id").alias("owner"), rank.alias("rank")))
    first = reasons.groupBy("document_id", "line_pos").agg(F.min(F.struct(F.col("priority").cast("int").alias("priority"), "reason")).alias("_line"))
    first = first.withColumnsRenamed({"document_id": "_document", "line_pos": "_pos"})  # a null document is one too
    rows = place(lines.select("document_id", "line_pos", *held_by), held).withColumnsRenamed({"owner": "_owner", "rank": "_rank", "claims": "_claims"})
    if regions is not None:
        rows = place(rows, segments(regions.select("document_id", "start_pos", "stop_pos", F.col("reason").alias("owner"), F.col("priority").alias("rank"))))
        rows = rows.withColumn("_region", F.when(F.col("owner").isNotNull(), F.struct(F.col("rank").alias("priority"), F.col("owner").alias("reason")))).drop("owner", "rank", "claims")
    rows = rows.join(first, F.col("document_id").eqNullSafe(F.col("_document")) & (F.col("line_pos") == F.col("_pos")), "left")
    reason = F.least("_line", "_region")["reason"] if regions is not None else F.col("_line.reason")
    kind_of = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (v, k)]), F.col("_rank"))
    kind = F.when(F.col("_rank") <= 2, kind_of).when(reason.isNotNull(), "excluded").when(F.col("_rank") == 4, "frontmatter").when(is_blank, "blank").otherwise("unassigned")
    owned_kind = kind.isin(*KINDS)
    contents = F.when(F.col("_rank") == 1, F.col("_claims")).otherwise(0).cast("long")
    return rows.select("document_id", "line_pos", *[c for c in held_by if c == "text"], kind.alias("classification"), F.when(kind == "excluded", reason).alias("reason"), F.when(owned_kind, F.col("_owner")).alias("owner_id"), contents.alias("contents"))


def ledger_violations(rows: DataFrame) -> DataFrame:
    """Lines without a class and lines that two owners claim as content."""
    rule = F.when(F.col("classification") == "unassigned", "no owner").when(F.col("contents") > 1, "two owners")
    return rows.select("document_id", "line_pos", rule.alias("rule")).where("rule IS NOT NULL")


def gap_is_blank(lines: DataFrame) -> DataFrame:
    """Filled lines with ``next_text`` and whether only blank lines, and at least one, lie between."""
    filled = lines.where(T.strip(F.col("text")) != "")
    return filled.withColumn("next_text", F.lead("text").over(in_document())).withColumn("blank_gap", F.coalesce(F.lead("line_pos").over(in_document()) - F.col("line_pos") > 1, F.lit(False)))


#: How sentences end and what starts an item of a list.
STRONG_END = r"[.!?][”’\"')\]]*$"
LOWER_START, URL_START = r"^[a-zà-öø-ÿ]", r"(?i)^(?:https?://|www\.)"
ITEM_START = r"^(?:\[\d+\]\s|(?i:\([a-z0-9]+\)\s)|\d+(?:\.\d+)*[.)]?\s|[-–—•▪◦*]\s)"
INITIALS = r"^[A-Z]\.\s+\S"
#: Footnotes, and starts of bibliography entries by author and year or by number.
FOOTNOTE = r"^(\d{1,2})\s+\S"
AUTHOR_YEAR = r"^[A-ZÀ-ÖØ-Þ0-9][^\n]{0,240}\((?:19|20)\d{2}[a-z]?\)"
NUMBERED_ENTRY = r"^\[(\d+)\]\s+"


def footnotes(lines: DataFrame) -> DataFrame:
    """Lines that start like footnotes: number, and whether the filled line before ends with it as a marker."""
    rows = previous_filled(lines).withColumn("number", F.regexp_extract(T.strip(F.col("text")), FOOTNOTE, 1)).where("number <> ''")
    before = F.regexp_replace("previous_filled.text", r"[”’\"')\]]*\s*$", "")
    return rows.select("document_id", "line_pos", F.col("number").cast("int").alias("number"), "text", F.coalesce(F.endswith(before, F.col("number")), F.lit(False)).alias("linked"))


def reference_start(text: Column, prefixes: list[str]) -> Column:
    """Whether a numbered line is a reference, by what follows its number, rather than a recital."""
    rest = F.lower(F.regexp_extract(T.strip(text), r"^\(\d+\)\s*(.*)$", 1))
    out = F.lit(False)
    for p in prefixes:
        out = out | rest.startswith(p.lower())
    return (rest != "") & out


def boundary_reason(text: Column, next_text: Column, blank_gap: Column) -> Column:
    """Why a source may be cut after a line; null if it may not.

    After its last line, after a sentence, before an item of a list, or at
    blank lines; never after a colon or before a lower-case start or a URL,
    save that a list may follow a line without a colon.
    """
    right, left = F.regexp_replace(text, r"\s+$", ""), F.regexp_replace(next_text, r"^\s+", "")
    runs_on = left.rlike(LOWER_START) | left.rlike(URL_START)
    item = left.rlike(ITEM_START) & ~left.rlike(INITIALS)
    colon = right.endswith(":")
    return (
        F.when(next_text.isNull(), "end_of_source_unit").when(right.rlike(STRONG_END) & ~runs_on, "after_strong_terminal")
        .when(item & ~colon, "before_structured_start").when(blank_gap & ~runs_on & ~colon, "at_blank_paragraph_gap")
    )

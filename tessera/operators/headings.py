"""Headings: candidates by pattern, vetoes, and texts of several lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import in_page, neighbours

MAX_LENGTH = 180
#: Lines that are never headings.
NOISE = r"^(?:\d+|(?i:Page\s+\d+)|EN|OJ\s+L,\s*\d{1,2}\.\d{1,2}\.\d{4})$"
_ROMAN = "[IVXLCDM]+"


@dataclass(frozen=True)
class Family:
    """Heading patterns of one kind of document; the first that matches counts."""

    patterns: tuple[tuple[str, str], ...]
    title_lines: dict[str, int] = field(default_factory=dict)
    stop: str = r"^$"
    wrapped: str | None = None
    max_wrapped: int = 12


#: Headings of legal acts, of numbered standards, and of compactly numbered reports.
ACT = Family(
    (
        ("chapter", rf"(?i)^CHAPTER\s+{_ROMAN}$"),
        ("section", r"(?i)^SECTION\s+\d+[A-Z]?$"),
        ("article", r"(?i)^Article\s+\d+[A-Z]?$"),
        ("annex", rf"(?i)^ANNEX\s+{_ROMAN}$"),
    ),
    title_lines={"chapter": 1, "section": 1, "article": 1, "annex": 3},
    stop=r"(?i)^(?:\d+\.\s|\([a-z0-9ivxlcdm]+\)\s|(?:Section|Part)\s+[A-Z]\s+[—-]\s|for the purposes? |the following |this annex )",
)
STANDARD = Family(
    (
        ("numbered_heading", r"^\d+\.\s+[A-Z][^\n]{2,}$"),
        ("numbered_subheading", r"^\d+\.\d+(?:\.\d+)*\s+[A-Z][^\n]{2,}$"),
        ("rmf_function_heading", r"^(?:GOVERN|MAP|MEASURE|MANAGE)\s+\d+(?:\.\d+)?:\s+\S.*$"),
        ("appendix", r"(?i)^Appendix\s+[A-Z](?:[.:]?|[.:]?\s+.+)$"),
        ("named_heading", r"(?i)^(?:References|Glossary|Acknowledgments)$"),
    ),
    title_lines={"appendix": 1},
    stop=r"(?i)^(?:\d+$|Page\s+\d+$|Action ID\b|AI Actor Tasks:|Table\s+\d+|(?:GV|MP|MS|MG)-\d|(?:Categories|Subcategories)$)",
    wrapped="rmf_function_heading",
)
REPORT = Family(
    (
        ("numbered_heading", r"^\d+\s+[A-Z][^\n]{2,}$"),
        ("numbered_subheading", r"^\d+\.\d+(?:\.\d+)*\s+[A-Z][^\n]{2,}$"),
        ("appendix", r"(?i)^Appendix\s+[A-Z](?:[.:]\s*|\s+).+$"),
        ("named_heading", r"(?i)^(?:References|Acknowledgments)$"),
    )
)


def is_noise(line: Column) -> Column:
    return (line == "") | line.rlike(NOISE)


def classify(text: Column, family: Family) -> Column:
    """The heading type of a line; null for none, noise and lines over 180 characters."""
    line, out = T.collapse_spaces(text), F.lit(None).cast("string")
    for name, pattern in reversed(family.patterns):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return F.when(~is_noise(line) & (F.length(line) <= MAX_LENGTH), out)


def is_list_item(kind: Column, heading: Column, next_line: Column) -> Column:
    """Whether a numbered line is prose rather than a heading."""
    body, n = F.regexp_replace(heading, r"^\d+(?:\.\d+)*\.?\s+", ""), F.length(heading)
    long = (n > 120) | (body.contains(":") & (n > 85)) | ((n > 75) & next_line.rlike(r"^\p{Ll}"))
    return kind.isin("numbered_heading", "numbered_subheading") & long


def candidates(lines: DataFrame, family: Family, attribute_page: tuple[str, str] | None = None) -> DataFrame:
    """Heading candidates of a line table: page_id, line_number, candidate_type, text, previous_line, next_line.

    Lines of contents pages, numbered prose and articles after an annex on
    their page are vetoed, and numbered lines on pages that hold both lines of
    ``attribute_page``.
    """
    lower = F.lower(T.collapse_spaces(F.col("text")))
    page = Window.partitionBy("page_id")
    rows = neighbours(lines).withColumn("clean", T.collapse_spaces(F.col("text"))).withColumn("candidate_type", classify(F.col("text"), family))
    rows = rows.withColumn("_contents", F.bool_or(lower.isin("contents", "table of contents")).over(page))
    annex = F.coalesce(F.bool_or(F.coalesce(F.col("candidate_type") == "annex", F.lit(False))).over(in_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_annex", annex)
    vetoed = F.col("_contents") | is_list_item(F.col("candidate_type"), F.col("clean"), F.col("next_line")) | ((F.col("candidate_type") == "article") & F.col("_annex"))
    if attribute_page:
        marker, title = attribute_page
        rows = rows.withColumn("_attributes", F.bool_or(lower.isin(marker, f"{marker}:")).over(page) & F.bool_or(lower == title).over(page))
        vetoed = vetoed | (F.col("_attributes") & F.col("candidate_type").isin("numbered_heading", "numbered_subheading"))
    rows = rows.where(F.col("candidate_type").isNotNull() & ~vetoed)
    return rows.select("document_id", "page_id", "page_number", "line_number", "line_pos", "candidate_type", F.col("clean").alias("text"), "previous_line", "next_line")


def reconstruct(lines: DataFrame, found: DataFrame, family: Family, kept_hyphens: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with the lines that continue them: heading_id, full_heading, source_line_numbers.

    Titles take up to their type's number of lines, wrapped headings go on to
    the end of their sentence; both end before another candidate and before a
    line that starts a body. The page's lines come along once as an array.
    """
    line = F.struct("line_number", T.collapse_spaces(F.col("text")).alias("text"))
    page = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(line)).alias("page_lines"))
    others = found.groupBy("page_id").agg(F.collect_set("line_number").alias("starts"))
    rows = found.join(page, "page_id").join(others, "page_id")
    after = F.filter("page_lines", lambda x: (x["line_number"] > F.col("line_number")) & (x["text"] != ""))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in (family.title_lines or {"": 0}).items() for v in p]), F.col("candidate_type")), F.lit(0))
    annex, wraps = F.col("candidate_type") == "annex", F.col("candidate_type") == F.lit(family.wrapped or "")
    if "appendix" in family.title_lines:
        most = F.when((F.col("candidate_type") == "appendix") & ~F.col("text").rlike(r"(?i)^Appendix\s+[A-Z][.:]?$"), 0).otherwise(most)
    most = F.when(wraps & ~F.col("text").rlike(r"[.?!]$"), family.max_wrapped).otherwise(most)
    # the state is (collected lines, done)
    start = F.struct(F.array().cast("array<struct<line_number:int,text:string>>").alias("got"), (most == 0).alias("done"))

    def step(s: Column, x: Column) -> Column:
        stop = F.array_contains("starts", x["line_number"]) | x["text"].rlike(family.stop) | (annex & (F.size(s["got"]) > 0) & (x["text"].endswith(":") | x["text"].startswith("—")))
        full = (F.size(s["got"]) + 1 >= most) | (wraps & x["text"].rlike(r"[.?!]$"))
        return F.when(s["done"], s).when(stop, F.struct(s["got"].alias("got"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(s["got"], F.array(x)).alias("got"), full.alias("done")))

    more = F.aggregate(after, start, step)["got"]
    rows = rows.withColumn("more", more)
    texts = F.concat(F.array("text"), F.col("more.text"))
    whole = F.when(wraps, T.join_dehyphenated(texts, kept_hyphens)).otherwise(T.join_wrapped(texts))
    numbers = F.concat(F.array("line_number"), F.col("more.line_number"))
    return rows.select(
        "document_id", "page_id", "page_number", "line_number", "line_pos", "candidate_type", T.heading_id(F.col("page_id"), F.col("line_number")).alias("heading_id"),
        F.col("text").alias("marker_text"), whole.alias("full_heading"), numbers.alias("source_line_numbers"), F.array_max(numbers).alias("end_line_number"),
    )

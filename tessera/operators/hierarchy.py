"""Trees of headings, spans of lines under them, and checks of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.checkpoints import cut
from ..functions.groups import stream_groups
from .intervals import span_sums


def act_parents(headings: DataFrame) -> DataFrame:
    """``headings`` of legal acts with ``parent_id``.

    A chapter or an annex starts anew; a section stands under the chapter or
    else the annex that is open, an article under the section that its chapter
    has opened or else the chapter.
    """
    w = Window.partitionBy("document_id").orderBy("line_pos").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("candidate_type")
    top = F.last(F.when(kind.isin("chapter", "annex"), F.struct("line_pos", "heading_id", "candidate_type")), True).over(w)
    section = F.last(F.when(kind == "section", F.struct("line_pos", "heading_id")), True).over(w)
    rows = headings.withColumn("_top", top).withColumn("_section", section)
    chapter = F.when(F.col("_top.candidate_type") == "chapter", F.col("_top.heading_id"))
    open_section = F.when(F.col("_section.line_pos") > F.col("_top.line_pos"), F.col("_section.heading_id"))
    parent = F.when(kind == "section", F.col("_top.heading_id")).when(kind == "article", F.when(chapter.isNotNull(), F.coalesce(open_section, chapter)))
    return rows.withColumn("parent_id", parent).drop("_top", "_section")


def act_violations(rows: DataFrame) -> DataFrame:
    """Sections without chapter or annex, articles without chapter."""
    return rows.where(F.col("parent_id").isNull() & F.col("candidate_type").isin("section", "article")).select("heading_id", F.lit("no open parent").alias("rule"))


def depth_parents(headings: DataFrame, order_col: str = "line_pos", depth_col: str = "depth", id_col: str = "heading_id", group: str = "document_id") -> DataFrame:
    """``headings`` with ``parent_id``: the last earlier one of depth one less, if nothing shallower came between.

    A stack over each document's headings holds the last shallower one,
    whatever the depth.
    """
    schema = StructType([*headings.schema, StructField("parent_id", headings.schema[id_col].dataType)])
    columns = headings.columns

    def run(_, rows: dict[str, list]) -> list[tuple]:
        out, open_ = [], []
        for values in zip(*(rows[c] for c in columns), strict=True):
            depth = values[columns.index(depth_col)]
            while open_ and open_[-1][0] >= depth:
                open_.pop()
            out.append((*values, open_[-1][1] if open_ and open_[-1][0] == depth - 1 else None))
            open_.append((depth, values[columns.index(id_col)]))
        return out

    return stream_groups(headings, group, order_col, run, schema)


def paths(nodes: DataFrame, id_col: str = "node_id", parent_col: str = "parent_id", name_col: str = "name") -> DataFrame:
    """``nodes`` with depth, ancestor_ids and path from the root, by joining one level a time until one is empty.

    Nodes that no root leads to (a cycle, a parent that isn't there) have no
    row; :func:`unreached` lists them.
    """
    level = nodes.where(F.col(parent_col).isNull()).select(id_col, F.lit(0).alias("depth"), F.array().cast("array<string>").alias("ancestor_ids"), F.array(F.col(name_col).cast("string")).alias("path"))
    level = cut(level)
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        up = level.select(F.col(id_col).alias("_up"), F.col("ancestor_ids").alias("_ancestors"), F.col("path").alias("_path"))
        rows = nodes.join(up, nodes[parent_col] == up["_up"])
        own = F.concat("_ancestors", F.array(F.col("_up").cast("string")))
        # an id that stands twice must not be its own ancestor
        rows = rows.where(~F.array_contains(own, F.col(id_col).cast("string")))
        level = cut(rows.select(id_col, F.lit(depth).alias("depth"), own.alias("ancestor_ids"), F.concat("_path", F.array(F.col(name_col).cast("string"))).alias("path")))
        out = out.unionByName(level)
    return out


def unreached(nodes: DataFrame, found: DataFrame, id_col: str = "node_id") -> DataFrame:
    """id and rule of nodes that no root leads to."""
    return nodes.join(found.select(id_col), id_col, "left_anti").select(id_col, F.lit("no root").alias("rule"))


def violations(nodes: DataFrame) -> DataFrame:
    """node_id and rule of nodes (node_id, parent_id, depth, ancestor_ids) that make no tree."""
    twice = nodes.groupBy("node_id").count().where("count > 1").select("node_id", F.lit("repeated").alias("rule"))
    up = nodes.select(F.col("node_id").alias("_id"), F.col("depth").alias("_depth"), F.col("ancestor_ids").alias("_ancestors"))
    rows = nodes.join(up, nodes["parent_id"] == up["_id"], "left")
    rule = (
        F.when(F.col("parent_id").isNull() & (F.col("depth") != 0), "root below depth 0").when(F.col("parent_id").isNotNull() & F.col("_id").isNull(), "no such parent")
        .when(F.col("parent_id").isNotNull() & (F.col("depth") != F.col("_depth") + 1), "depth").when(F.col("parent_id").isNotNull() & (F.col("ancestor_ids") != F.concat("_ancestors", F.array(F.col("_id").cast("string")))), "ancestors")
    )
    return twice.union(rows.select("node_id", rule.alias("rule")).where("rule IS NOT NULL"))


def synthetic_parents(headings: DataFrame, function: str = r"^(GOVERN|MAP|MEASURE|MANAGE)\s+\d", category: str = r"^(?:GOVERN|MAP|MEASURE|MANAGE)\s+(\d+)(?:\.\d+)?:") -> DataFrame:
    """Nodes for functions and categories that only their children's markers name.

    node_id, document_id, parent_id, synthetic_type, and the position of the
    first child, which anchors the node.
    """
    text = F.col("full_heading")
    rows = headings.withColumn("f", F.lower(F.regexp_extract(text, function, 1))).withColumn("c", F.regexp_extract(text, category, 1)).where("f <> ''")
    doc = F.col("document_id").cast("string")
    of_function = F.concat(F.lit("synthetic:"), doc, F.lit(":rmf-function:"), F.col("f"))
    functions = rows.groupBy("document_id", "f").agg(F.min("line_pos").alias("line_pos")).select(of_function.alias("node_id"), "document_id", F.lit(None).cast("string").alias("parent_id"), F.lit("function").alias("synthetic_type"), "line_pos")
    explicit = rows.where(text.rlike(r"^[A-Z]+\s+\d+:")).select("document_id", "f", "c").distinct()
    missing = rows.where("c <> ''").join(explicit, ["document_id", "f", "c"], "left_anti").groupBy("document_id", "f", "c").agg(F.min("line_pos").alias("line_pos"))
    of_category = F.concat(F.lit("synthetic:"), doc, F.lit(":rmf-category:"), F.col("f"), F.lit(":"), F.col("c"))
    return functions.unionByName(missing.select(of_category.alias("node_id"), "document_id", of_function.alias("parent_id"), F.lit("category").alias("synthetic_type"), "line_pos"))


def spans(headings: DataFrame, lengths: DataFrame) -> DataFrame:
    """heading_id with direct_start, direct_stop and subtree_stop as line positions, stops exclusive.

    ``headings`` has document_id, heading_id, start_pos, end_pos and depth,
    ``lengths`` document_id and line_count. The direct body ends at the next
    heading; the subtree at the next one that isn't deeper, found with a stack
    over the document's headings, which come sorted to one task each.
    """
    following = F.lead("start_pos").over(Window.partitionBy("document_id").orderBy("start_pos"))
    rows = headings.join(lengths, "document_id").withColumn("direct_stop", F.coalesce(following, F.col("line_count")))
    rows = rows.select("document_id", "heading_id", "depth", F.col("start_pos").cast("long"), (F.col("end_pos") + 1).cast("long").alias("direct_start"), F.col("direct_stop").cast("long"), F.col("line_count").cast("long"))

    names = ["document_id", "heading_id", "depth", "start_pos", "direct_start", "direct_stop"]

    def close(_, group: dict[str, list]) -> list[tuple]:
        starts, depths = group["start_pos"], group["depth"]
        stops, open_ = list(group["line_count"]), []
        for i, d in enumerate(depths):
            while open_ and depths[open_[-1]] >= d:
                stops[open_.pop()] = starts[i]
            open_.append(i)
        return list(zip(*(group[c] for c in names), stops, strict=True))

    schema = rows.select(*names, F.col("line_count").alias("subtree_stop")).schema
    return stream_groups(rows, "document_id", "start_pos", close, schema)


def span_lines(found: DataFrame, lines: DataFrame, start: str = "direct_start", stop: str = "direct_stop") -> DataFrame:
    """heading_id with each of its span's lines.

    Positions are dense in a document, so a span is unrolled and met by an
    equi-join, not by comparing it with every line.
    """
    on = F.explode(F.sequence(F.col(start), F.col(stop) - 1)).alias("line_pos")
    wide = found.where(F.col(start) < F.col(stop)).select("document_id", "heading_id", on)
    return wide.join(lines, ["document_id", "line_pos"])


def span_metrics(found: DataFrame, lines: DataFrame, start: str = "direct_start", stop: str = "direct_stop") -> DataFrame:
    """Per heading: raw and filled lines, and whether the span is empty, blank or on several pages.

    Counts are differences of running sums; pages never fall along a
    document's lines, so the first and the last line's tell of all.
    """
    filled = (F.regexp_replace("text", r"\s", "") != "").cast("long")
    rows = span_sums(found.select("document_id", "heading_id", start, stop), lines, {"_raw": F.lit(1), "_filled": filled}, start, stop, edges=("page_number",))
    raw, f = F.col("_raw"), F.col("_filled")
    return rows.select("document_id", "heading_id", raw.alias("raw_line_count"), f.alias("nonblank_line_count"), (raw == 0).alias("is_empty"), ((raw > 0) & (f == 0)).alias("is_blank_only"), F.coalesce(F.col("first_page_number") != F.col("last_page_number"), F.lit(False)).alias("is_multi_page"))


def containment_violations(found: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Pairs (heading_id, ancestor_id) in which the heading or its subtree leaves the ancestor's."""
    up = found.select(F.col("heading_id").alias("ancestor_id"), F.col("start_pos").alias("a_start"), F.col("subtree_stop").alias("a_stop"))
    rows = ancestors.join(found, "heading_id").join(up, "ancestor_id")
    outside = (F.col("start_pos") < F.col("a_start")) | (F.col("direct_start") > F.col("a_stop")) | (F.col("subtree_stop") > F.col("a_stop"))
    return rows.where(outside).select("heading_id", "ancestor_id")


def envelopes(leaves: DataFrame, ancestors_col: str = "ancestor_ids", start: str = "start_pos", stop: str = "stop_pos") -> DataFrame:
    """Per ancestor: descendants, first start, last stop, and whether they lie side by side."""
    rows = leaves.select(F.explode(ancestors_col).alias("ancestor_id"), F.col(start).alias("s"), F.col(stop).alias("e"))
    out = rows.groupBy("ancestor_id").agg(F.count("*").alias("descendants"), F.min("s").alias("start_pos"), F.max("e").alias("stop_pos"), F.sum(F.col("e") - F.col("s")).alias("covered"))
    return out.withColumn("contiguous", F.col("covered") == F.col("stop_pos") - F.col("start_pos")).drop("covered")


def source_spans(spans: DataFrame, document_id: object = None) -> DataFrame:
    """Spans that a heading of the source stands for, of one document or of all."""
    rows = spans.where(F.col("node_kind") == "source")
    return rows if document_id is None else rows.where(F.col("document_id") == document_id)

"""The driver's tables in the shapes that the operators take; always whole tables."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.checkpoints import cut
from ..functions.order import dense_order
from ..operators import lexical_index
from ..operators import lines as L

#: Strings that one pass over the texts looks for.
NEEDLES = 200_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), F.col("source").alias("document_id"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index_in_segments(spark: SparkSession, sf: str) -> tuple[lexical_index.Index, lexical_index.State]:
    """A stored index of all passages: one in three comes later, as an increment."""
    rows = passages(spark, sf).where("text IS NOT NULL")
    index = lexical_index.build(rows.where("passage_id % 3 <> 1"))
    return index, index.add(rows.where("passage_id % 3 = 1"))


_indexes: dict[tuple[str, str], lexical_index.Index] = {}


def corpus_index(spark: SparkSession, sf: str) -> lexical_index.Index:
    """The stored index of all passages, built once in an application and probed by every query after."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes or not _indexes[key].exists():
        _indexes[key] = lexical_index.build(passages(spark, sf).where("text IS NOT NULL"))
    return _indexes[key]


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Grade 2 where a passage holds the whole item, 1 where it holds its first sentence of over 20 characters."""
    first = F.split_part("q", F.lit("."), F.lit(1))
    items = questions(spark, sf).where("text IS NOT NULL").select("query_id", F.col("text").alias("q")).withColumn("first", first)
    needles = items.select("query_id", F.col("q").alias("needle"), F.lit(2).alias("grade")).union(items.where(F.length("first") > 20).select("query_id", "first", F.lit(1)))
    return contained(passages(spark, sf), needles).groupBy("query_id", "passage_id").agg(F.max("grade").alias("grade"))


def contained(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """query_id, passage_id, grade of each needle (query_id, needle, grade) that a passage's text holds.

    Every text is read once, however many needles there are: they go together
    into one automaton, at most ``NEEDLES`` a pass.
    """
    listed = dense_order(needles, "query_id", "needle", "grade", name="n")
    listed, parts = cut(listed), []
    for lo in range(0, max(1, listed.count()), NEEDLES):
        some = [tuple(r) for r in listed.where(F.col("n").between(lo, lo + NEEDLES - 1)).select("needle", "query_id", "grade").collect()]
        shared = rows.sparkSession.sparkContext.broadcast(some)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            search, always, by_needle = ahocorasick.Automaton(), [], {}
            for needle, query, grade in shared.value:
                by_needle.setdefault(needle, []).append((query, grade))
            always = by_needle.pop("", [])
            for needle, who in by_needle.items():
                search.add_word(needle, who)
            search.make_automaton()
            for batch in batches:
                out = []
                for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text is not None:
                        hits = {x for _, who in search.iter(text) for x in who} if by_needle else set()
                        out += [(q, ident, g) for q, g in hits.union(always)]
                columns = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["query_id", "passage_id", "grade"])

        parts.append(rows.select("passage_id", "text").mapInArrow(find, "query_id long, passage_id long, grade int"))
    return functools.reduce(DataFrame.union, parts)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding")


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vector with a question's number stands for the question."""
    return questions(spark, sf).join(table(spark, sf, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one page each; as in the SQL only line feeds end lines, and an empty text is one line."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), T.page_id(F.col("doc_id").cast("string"), F.lit(1)).alias("page_id"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))
    return L.line_table(pages, T.split_newlines)


def turn_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as headings of depth 1 (system), 2 (user) and 3 (assistant), one line each."""
    kind = F.when(F.col("role") == "system", "chapter").when(F.col("role") == "user", "section").otherwise("article")
    depth = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    ident = F.format_string("%d:%d", F.col("conv_id"), F.col("turn"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("line_pos"), ident.alias("heading_id"), kind.alias("candidate_type"), depth.alias("depth"), "text")


def raters(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as two raters' records, joined with their documents."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    status = lambda c: F.when(c, "sufficient").otherwise("insufficient")
    codes = lambda a, b: F.array_compact(F.array(F.when(a, "noise"), F.when(b, "harm")))
    return rows.select(
        F.col("doc_id").alias("case_id"), "lang", "source", status(F.col("quality") == 1).alias("first_status"), status(F.col("toxic") == 1).alias("second_status"),
        codes(F.col("quality") == 0, F.col("toxic") == 1).alias("first_codes"), codes(F.col("n_chars") < 500, F.col("toxic") == 1).alias("second_codes"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a probability from their length, the target being their quality."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    p = F.round(T.sigmoid(F.log(F.col("n_chars") + 1.0) - 6), 3)
    return rows.select(F.col("doc_id").alias("case_id"), F.col("quality").alias("target"), p.alias("probability"))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A case per gold row: the item as question, the passage as its only evidence."""
    rows = gold(spark, sf).join(passages(spark, sf), "passage_id").join(questions(spark, sf).withColumnRenamed("text", "question"), "query_id")
    return rows.select("query_id", "passage_id", "grade", "question", F.array("text").alias("texts"), F.array("document_id").alias("labels"))

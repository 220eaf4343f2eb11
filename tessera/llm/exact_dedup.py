"""Operator 4: exact dedup by progressive refinement.

Rows are told apart by their text's length, then by a hash of its first
characters, and only rows that still share both are told apart by a SHA-256 of
the whole text. The first two levels need one narrow pass; whole texts are
hashed for surviving groups only, unless the caller wants every digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX_CHARS = 256


def _levels(text: Column, prefix_chars: int) -> tuple[Column, Column]:
    return F.octet_length(text).cast("long"), F.xxhash64(F.substring(text, 1, prefix_chars))


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, all_digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest id
    stays. A null id is below all others. Of rows that repeat an id and a text
    each says it is kept; callers that need one of them take one.
    ``text_sha256`` is null for rows that the first two levels tell apart,
    unless ``all_digests``. An empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, prefix = _levels(text, prefix_chars)
    # one number for both levels; if two groups shared it, their digests would part them
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.xxhash64(size, prefix).alias("level"), text.alias("text"))
    keys = common.materialize(rows.select("size", "level"), "dedup-keys")
    by_size = common.materialize(keys.groupBy("size").agg(F.count("*").alias("n")).where("n > 1"), "dedup-sizes")
    by_level = common.join_groups(keys, by_size, "size", "n").groupBy("level").agg(F.count("*").alias("n")).where("n > 1")
    survivors = common.materialize(by_level, "dedup-survivors")
    digest = F.sha2(F.col("text"), 256)
    marked = common.mark_groups(rows, survivors, "level", "n")
    hashed = common.materialize(marked.select("doc_id", "hit", (digest if all_digests else F.when(F.col("hit"), digest)).alias("text_sha256")), "dedup-digests")
    groups = hashed.where("hit").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = common.materialize(groups, "dedup-groups")
    # only rows that may have copies look for them
    found = common.join_groups(hashed.where("hit").select("doc_id", "text_sha256"), groups, "text_sha256", "group_size")
    alone = hashed.where("NOT hit").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = found.unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts.

    Rows with an id of their own keep all their columns as they are. Rows
    that repeat both id and text are reduced to one.
    """
    marks = refine(docs, id_col, text_col)
    gone = marks.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha")).distinct()
    gone = common.maybe_broadcast(common.materialize(gone, "dedup-gone"))
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].eqNullSafe(gone["_gone_id"]) & ~(F.sha2(text, 256) != gone["_gone_sha"])
    kept = docs.join(gone, same, "left_anti")
    again = common.materialize(docs.groupBy(F.col(id_col).alias("_again_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again_id"), "dedup-again")
    if again.isEmpty():
        return kept
    twice = common.maybe_broadcast(again)
    single = kept.join(twice, kept[id_col].eqNullSafe(twice["_again_id"]), "left_anti")
    several = kept.join(twice, kept[id_col].eqNullSafe(twice["_again_id"]), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = several.groupBy(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_same")).agg(F.first(whole).alias("_row"))
    return single.unionByName(once.select("_row.*"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stands for its text."""
    return refine(common.table(spark, sf_dir, "documents"), all_digests=True)

"""Operator 8: mixing sources to target weights by capped water-filling.

DataFrame functions only. A source's target is its weight times one common
level, stopped at a maximum number of epochs; the level is where the targets
use the whole budget. A target is reached by whole repetitions of every
document and one more of the documents whose seeded hash is at most the
source's threshold. The threshold is found by descending through hash digits
on sums per digit, so no task ever orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 17
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Hex digits of the hash, and how many of them one level of the descent reads.
HASH_DIGITS = 13
LEVEL_BITS = 10
LEVELS = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Sources are broadcast up to this many; beyond that the join is shuffled.
MAX_BROADCAST_SOURCES = 50_000


def seeded_hash(id_col: str, seed: int = SEED) -> Column:
    """52 bits of a seeded hash of the id; a null id hashes as ``null``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size), which share all of the sizes.

    Sources by code point, null last, get the weights in turn. Sources sorted
    by cap over weight are capped in that order, so the level is the first
    one that leaves its source, and thus all later ones, at or under the cap:
    what repeated resharing of the excess ends in. Works on one row a source
    in one task: meant for up to some hundred thousand sources.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    cap = F.lit(max_epochs) * F.col("source_size")
    rows = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    capped_before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_from = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", (F.col("total") - capped_before) / weight_from)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything)
    rows = rows.withColumn("from_ratio", level)
    final = F.min(F.when(F.col("ratio") == F.col("from_ratio"), F.struct(F.col("ratio"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("ratio") < F.coalesce("from_ratio", F.lit(float("inf"))), F.col("cap").cast("double")).otherwise(F.least(final * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _digit(level: int) -> Column:
    shift = 4 * HASH_DIGITS - LEVEL_BITS * (level + 1)
    return F.shiftright("hash", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def _join(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, null with null, without any column twice."""
    right = sources.withColumnRenamed("source", "_source")
    return rows.join(common.maybe_broadcast(right, MAX_BROADCAST_SOURCES), rows["source"].eqNullSafe(right["_source"]), how).drop("_source")


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repetitions, and the hash up to which one more is taken.

    All rows of one hash go together. ``sizes`` has source, size and hash.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = common.materialize(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    inside = sizes.select("source", "size", "hash")
    for level in range(LEVELS):
        sums = inside.groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        sums = _join(sums.withColumn("upto", upto), state.select("source", "rest"))
        edge = sums.where("upto > rest").groupBy("source").agg(F.min(F.struct("digit", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"))).alias("edge"))
        edge = common.materialize(edge.select("source", F.col("edge.digit").alias("edge"), F.col("edge.left").alias("rest")), "mix-edges")
        inside = _join(inside, edge.select("source", "edge")).where(_digit(level) == F.col("edge")).drop("edge")
        state = _join(state.drop("rest"), edge.select("source", "rest", F.col("edge").alias(f"digit{level}")), "left")
    units = _join(inside.groupBy("source", "hash").agg(F.sum("size").alias("n")), state.select("source", "rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = units.withColumn("before", before).where(F.col("before") + F.col("n") / 2.0 <= F.col("rest")).groupBy("source").agg(F.max("hash").alias("last"))
    first = sum((F.col(f"digit{k}") * F.lit(1 << (4 * HASH_DIGITS - LEVEL_BITS * (k + 1))) for k in range(LEVELS)), F.lit(0).cast("long"))
    state = _join(state, last, "left")
    # at the cap nothing more is taken, not even a row without words
    threshold = F.when(F.col("whole") >= MAX_EPOCHS, F.lit(-1)).otherwise(F.coalesce("last", first - 1, F.lit(-1)))
    return state.select("source", "source_size", "target", "whole", threshold.alias("threshold"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), seeded_hash(id_col, seed).alias("hash"))


def plan(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, target, whole and threshold, for materialized sizes."""
    sources = common.materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    return common.materialize(thresholds(sizes, water_fill(sources)), "mix-plan")


def repeats() -> Column:
    """How often a row is taken, given its hash and its source's plan."""
    return F.col("whole") + F.when(F.col("hash") <= F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    A null text has size 0, null is a source of its own, a source without
    words has target 0, rows that repeat an id are taken alike, an empty
    table gives no row. The same rows and seed give the same mix.
    """
    sizes = common.materialize(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    rows = _join(sizes, plan(sizes))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats()).alias("taken"), "source", repeats().alias("repeats"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, at most ``MAX_EPOCHS`` times; columns stay, whatever their names."""
    sizes = common.materialize(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _join(docs.select(whole, F.col(source_col).alias("source"), seeded_hash(id_col, seed).alias("hash")), plan(sizes).select("source", "whole", "threshold"))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), repeats().cast("int")))).select("row.*")


ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {HASH_DIGITS}) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM t GROUP BY source),
o AS (
  SELECT *, CAST({MAX_EPOCHS} * source_size AS DOUBLE) / weight AS ratio,
    row_number() OVER (ORDER BY {MAX_EPOCHS} * source_size / weight, source NULLS LAST) AS k,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (
  SELECT *, CAST(total - coalesce(sum({MAX_EPOCHS} * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
w AS (
  SELECT source, source_size, CASE WHEN k < coalesce((SELECT min(k) FROM l WHERE level <= ratio), 1 << 60) THEN CAST({MAX_EPOCHS} * source_size AS DOUBLE)
    ELSE least((SELECT min_by(level, k) FROM l WHERE level <= ratio) * weight, CAST({MAX_EPOCHS} * source_size AS DOUBLE)) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM w),
u AS (SELECT source, hash, sum(size) AS n FROM t GROUP BY source, hash),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT t.doc_id, t.size, p.source_size, p.target,
  CAST(t.size * (p.whole + CASE WHEN c.before + c.n / 2.0 <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source
JOIN c ON c.source IS NOT DISTINCT FROM t.source AND c.hash = t.hash
"""


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, with the words that the mix takes of each."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

"""Graded relevance metrics of rankings, all from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)


def judged(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """Each gold row with its rank, null if it wasn't ranked. Queries without gold abstain."""
    return gold.select("query_id", "passage_id", "grade").join(rankings.select("query_id", "passage_id", "rank"), ["query_id", "passage_id"], "left")


def per_query(rankings: DataFrame, gold: DataFrame, k: int = 10, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """query_id, recall_at_*, reciprocal_rank, direct_hit, ndcg.

    Recall divides by all gold; a direct hit has grade 2; nDCG's gain is
    2^grade - 1 and its ideal is cut at ``k``.
    """
    rows = judged(rankings, gold)
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "passage_id"))
    rows = rows.withColumn("ideal_rank", ideal)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    dcg = F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0))
    best = F.sum(F.when(F.col("ideal_rank") <= k, gain / F.log2(F.col("ideal_rank") + 1)).otherwise(0.0))
    recalls = [(F.sum(F.when(F.col("rank") <= c, 1).otherwise(0)) / F.count("*")).alias(f"recall_at_{c}") for c in cutoffs]
    first = F.min(F.when((F.col("rank") <= k) & (F.col("grade") >= 1), F.col("rank")))
    direct = F.coalesce(F.bool_or((F.col("rank") <= k) & (F.col("grade") == 2)), F.lit(False))
    return rows.groupBy("query_id").agg(*recalls, F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"), direct.alias("direct_hit"), F.coalesce(F.try_divide(dcg, best), F.lit(0.0)).alias("ndcg"))


def means(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: means over answerable queries, and how many answer and abstain."""
    names = [c for c in scored.columns if c not in ("query_id", "direct_hit")]
    every = questions.select("query_id").join(scored, "query_id", "left")
    answered = F.col("ndcg").isNotNull()
    return every.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in names], F.avg(F.col("direct_hit").cast("double")).alias("direct_hit_rate"),
        F.count_if(answered).alias("answer_count"), F.count_if(~answered).alias("abstain_count"),
    )


def input_violations(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id and rule of every ranking or judgment that metrics can't take."""
    twice = rankings.groupBy("query_id", "passage_id").count().where("count > 1").select("query_id", F.lit("ranked twice").alias("rule"))
    low = gold.where("grade IS NULL OR grade < 1").select("query_id", F.lit("grade below 1").alias("rule"))
    gap = rankings.groupBy("query_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n").select("query_id", F.lit("ranks with gaps").alias("rule"))
    return twice.union(low).union(gap)

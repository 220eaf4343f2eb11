"""Unions of two rankings, their coverage of gold, fusion, and re-ranking of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(bm25: DataFrame, dense: DataFrame, depth: int) -> DataFrame:
    """query_id, passage_id, bm25_rank, dense_rank of everything in either list's first ``depth``."""
    left = bm25.where(F.col("rank") <= depth).select("query_id", "passage_id", F.col("rank").alias("bm25_rank"))
    right = dense.where(F.col("rank") <= depth).select("query_id", "passage_id", F.col("rank").alias("dense_rank"))
    return left.join(right, ["query_id", "passage_id"], "full_outer")


def stored(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """``candidates`` with accepted_order and, per query, position: the order of storage, which says nothing of relevance.

    ``accepted`` has passage_id and accepted_order. Candidates that aren't accepted come last.
    """
    rows = candidates.join(accepted.select("passage_id", "accepted_order"), "passage_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.col("accepted_order").asc_nulls_last(), "passage_id")
    return rows.withColumn("position", F.row_number().over(order))


def coverage(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query with gold: candidates, recall, direct hit, and gold that only one list found."""
    size = candidates.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    rows = gold.join(candidates, ["query_id", "passage_id"], "left")
    lexical, vector = F.col("bm25_rank").isNotNull(), F.col("dense_rank").isNotNull()
    found = rows.groupBy("query_id").agg(
        (F.count_if(lexical | vector) / F.count("*")).alias("candidate_recall"), F.bool_or((lexical | vector) & (F.col("grade") == 2)).alias("direct_hit"),
        F.count_if(~lexical & ~vector).alias("missed"), F.count_if(lexical & ~vector).alias("bm25_only"), F.count_if(vector & ~lexical).alias("dense_only"),
    )
    return found.join(size, "query_id", "left").fillna(0, ["candidate_count"])


def fuse(candidates: DataFrame, constant: int = 60) -> DataFrame:
    """query_id, passage_id, score, rank by equal-weight reciprocal ranks."""
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    scored = candidates.select("query_id", "passage_id", (part("bm25_rank") + part("dense_rank")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "passage_id")
    return scored.withColumn("rank", F.row_number().over(order))


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """Candidates by a raw score, higher first; ties in corpus order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("reranker_score"), "passage_id")
    return candidates.withColumn("reranker_score", score).withColumn("reranker_rank", F.row_number().over(order))


def pair_scores(pairs: DataFrame, scorer: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], question_col: str = "question", text_col: str = "text", batch: int = 32) -> DataFrame:
    """``pairs`` with ``pair_score`` from a scorer that is made once per worker."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = scorer()
        for left, right in parts:
            out: list[float] = []
            for at in range(0, len(left), batch):
                got = np.asarray(score(list(zip(left.iloc[at : at + batch], right.iloc[at : at + batch], strict=True))), np.float64)
                if not np.isfinite(got).all():
                    raise ValueError("a score is not finite")
                out += got.ravel().tolist()
            yield pd.Series(out)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pairs.withColumn("pair_score", F.pandas_udf(run, "double")(F.col(question_col), F.col(text_col)))


def candidate_violations(candidates: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, passage_id and rule of candidates that are outside the corpus, repeated or without a rank."""
    outside = candidates.join(passages.select("passage_id"), "passage_id", "left_anti").select("query_id", "passage_id", F.lit("outside the corpus").alias("rule"))
    twice = candidates.groupBy("query_id", "passage_id").count().where("count > 1").select("query_id", "passage_id", F.lit("repeated").alias("rule"))
    bare = candidates.where("bm25_rank IS NULL AND dense_rank IS NULL").select("query_id", "passage_id", F.lit("no rank").alias("rule"))
    return outside.union(twice).union(bare)

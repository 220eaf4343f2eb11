"""Whole evaluations: rank, measure, check, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import artifacts, dense, governance, hybrid, lexical, metrics
from ..sources import sinks


def _publish(rankings: DataFrame, gold: DataFrame, questions: DataFrame, inputs: dict[str, DataFrame], path: str, name: str, version: str, low: float | None, high: float | None) -> DataFrame:
    governance.enforce(metrics.input_violations(rankings, gold), "metric inputs")
    governance.enforce(artifacts.result_violations(rankings, low, high), name)
    record = artifacts.result_record(rankings, gold, questions, name, version, inputs)
    sinks.publish(record, path)
    return record


def bm25(passages: DataFrame, questions: DataFrame, gold: DataFrame, path: str, version: str = "1.0.0", k: int = 10) -> DataFrame:
    """BM25 over all passages, published once at ``path``."""
    found = lexical.rank(passages, questions, k)
    return _publish(found, gold, questions, {"passages": passages, "questions": questions, "gold": gold}, path, "bm25", version, 0.0, None)


def vectors(passages: DataFrame, queries: DataFrame, questions: DataFrame, gold: DataFrame, path: str, version: str = "1.0.0", k: int = 10) -> DataFrame:
    """Exact vector ranking, published once at ``path``; vectors are checked first."""
    governance.enforce(dense.violations(passages), "vectors")
    found = dense.rank(passages, queries, k)
    return _publish(found, gold, questions, {"passages": passages, "queries": queries, "gold": gold}, path, "dense", version, -1.0 - 1e-9, 1.0 + 1e-9)


def candidates(bm25_hits: DataFrame, dense_hits: DataFrame, passages: DataFrame, gold: DataFrame, path: str, depth: int = 20) -> DataFrame:
    """The union of two rankings and its coverage, published together at ``path``/candidates and /coverage."""
    union = hybrid.union(bm25_hits, dense_hits, depth)
    governance.enforce(hybrid.candidate_violations(union, passages), "candidates")
    sinks.publish_all(union.sparkSession, {f"{path}/candidates": (union, "json"), f"{path}/coverage": (hybrid.coverage(union, gold), "json")})
    return union

"""Manifests that pin how a dataset's cases are split, and what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The splits that every manifest names, and the version of how components are found.
NAMES = ("development", "validation", "test")
ALGORITHM = "1.0"


def _digest() -> Column:
    """A hash of all (case, split) pairs of a group: words of each pair's hash are summed, so no order and no single task is needed."""
    pair = T.sha256(F.concat_ws(":", F.col("case_id").cast("string"), F.coalesce("split_name", F.lit(""))))
    words = [F.sum(F.conv(F.substring(pair, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    return T.sha256(F.concat_ws(":", F.count("*"), *words))


def _facts(assignments: DataFrame) -> DataFrame:
    """Per dataset: components, cases by split, and the digest of its assignments."""
    whole = assignments.groupBy("dataset_id").agg(_digest().alias("assignments_sha256"))
    parts = assignments.select("dataset_id", "component").distinct().groupBy("dataset_id").agg(F.count("*").alias("component_count"))
    counts = assignments.where("split_name IS NOT NULL").groupBy("dataset_id", "split_name").agg(F.count("*").alias("n"))
    # a row a split, and there are few
    maps = counts.groupBy("dataset_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split_name", "n")))).alias("split_case_counts"))
    return whole.join(parts, "dataset_id").join(maps, "dataset_id", "left")


def manifests(assignments: DataFrame, datasets: DataFrame) -> DataFrame:
    """A manifest a dataset: dataset_id, dataset_sha256, algorithm_version, component_count, split_case_counts, assignments_sha256.

    ``assignments`` has dataset_id, case_id, component and split_name,
    ``datasets`` dataset_id and the hash of its content.
    """
    rows = datasets.join(_facts(assignments), "dataset_id")
    return rows.select("dataset_id", "dataset_sha256", F.lit(ALGORITHM).alias("algorithm_version"), "component_count", "split_case_counts", "assignments_sha256")


def violations(found: DataFrame, assignments: DataFrame, datasets: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """dataset_id and rule of what manifests (``found``) and assignments have against each other.

    Of a manifest: "no manifest", "repeated", "no dataset", "dataset_sha256",
    "algorithm_version", "component_count", "split names" (not exactly
    ``names``), "split counts" and "assignments" (cases or splits changed since). Of
    the assignments: "case in several splits", "case without split" and
    "component crosses splits".
    """
    known = datasets.select("dataset_id", F.col("dataset_sha256").alias("_sha"))
    facts = _facts(assignments).select("dataset_id", *[F.col(c).alias(f"_{c}") for c in ("component_count", "split_case_counts", "assignments_sha256")])
    met = found.join(known, "dataset_id", "left").join(facts, "dataset_id", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    named = F.sort_array(F.map_keys("split_case_counts")).eqNullSafe(F.sort_array(F.array(*map(F.lit, names))))
    counts = lambda c: F.sort_array(F.map_entries(c))
    faults = F.array_compact(F.array(
        F.when(~F.col("dataset_sha256").eqNullSafe(F.col("_sha")), "dataset_sha256"), F.when(~F.col("algorithm_version").eqNullSafe(F.lit(ALGORITHM)), "algorithm_version"),
        F.when(differs("component_count"), "component_count"), F.when(~named, "split names"), F.when(named & ~counts("split_case_counts").eqNullSafe(counts("_split_case_counts")), "split counts"),
        F.when(differs("assignments_sha256"), "assignments"),
    ))
    rules = F.when(F.col("_sha").isNull(), F.array(F.lit("no dataset"))).otherwise(faults)
    out = met.select("dataset_id", F.explode(rules).alias("rule")).distinct()
    out = out.union(datasets.join(found, "dataset_id", "left_anti").select("dataset_id", F.lit("no manifest")))
    out = out.union(found.groupBy("dataset_id").agg(F.count("*").alias("n")).where("n > 1").select("dataset_id", F.lit("repeated")))
    cases = assignments.groupBy("dataset_id", "case_id").agg(F.count_distinct("split_name").alias("n"))
    case = F.when(F.col("n") > 1, "case in several splits").when(F.col("n") == 0, "case without split")
    out = out.union(cases.select("dataset_id", case.alias("rule")).where("rule IS NOT NULL").distinct())
    parts = assignments.groupBy("dataset_id", "component").agg(F.count_distinct("split_name").alias("n")).where("n > 1")
    return out.union(parts.select("dataset_id", F.lit("component crosses splits")).distinct())

"""Results and rounds as single records, bound to their inputs by SHA-256."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import governance, metrics
from .governance import ContractViolation, binding


def result_record(rankings: DataFrame, gold: DataFrame, questions: DataFrame, result_id: str, version: str, inputs: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """One row: ids, bindings of the inputs, mean metrics, and an array of the queries' results."""
    scored = metrics.per_query(rankings, gold, k)
    hits = rankings.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "passage_id", "score"))).alias("hits"))
    each = scored.join(hits, "query_id", "left").agg(F.sort_array(F.collect_list(F.struct(*[c for c in ("query_id", *[x for x in scored.columns if x != "query_id"], "hits")]))).alias("queries"))
    out = metrics.means(scored, questions).crossJoin(each)
    for name, df in inputs.items():
        out = out.crossJoin(F.broadcast(binding(df, df.columns).select(F.col("sha256").alias(f"{name}_sha256"), F.col("rows").alias(f"{name}_rows"))))
    return out.select(F.lit(result_id).alias("result_id"), F.lit(version).alias("result_version"), *[c for c in out.columns if c != "queries"], "queries")


def result_violations(rankings: DataFrame, low: float | None = 0.0, high: float | None = None) -> DataFrame:
    """query_id and rule of scores that aren't finite or in range, and of ranks out of the scores' order."""
    s = F.col("score")
    rule = F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), "not finite")
    if low is not None:
        rule = rule.when(s < low, "too low")
    if high is not None:
        rule = rule.when(s > high, "too high")
    out = rankings.select("query_id", rule.alias("rule")).where("rule IS NOT NULL")
    nxt = rankings.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("score").alias("_s"))
    return out.union(rankings.join(nxt, ["query_id", "rank"]).where("_s > score").select("query_id", F.lit("order").alias("rule")))


def same_candidates(reranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, passage_id that only one side has."""
    a, b = reranked.select("query_id", "passage_id"), candidates.select("query_id", "passage_id")
    return a.exceptAll(b).union(b.exceptAll(a))


def round_record(cases: DataFrame, assignments: DataFrame, version: str, adjudicator: str) -> DataFrame:
    """One row per annotator: the round's version, the batch's binding, and the cases in order."""
    bound = binding(cases, cases.columns).select(F.col("sha256").alias("batch_sha256"), F.col("rows").alias("case_count"))
    rows = assignments.groupBy("annotator_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "case_id"))), lambda x: x["case_id"]).alias("case_ids"))
    return rows.crossJoin(F.broadcast(bound)).withColumn("round_version", F.lit(version)).withColumn("adjudicator_id", F.lit(adjudicator))


def record_template(assignments: DataFrame) -> DataFrame:
    """An empty record for each assigned case."""
    empty = F.array().cast("array<string>")
    return assignments.select(
        F.concat_ws(":", "annotator_id", F.col("case_id").cast("string")).alias("annotation_id"), "annotator_id", "case_id", "position", F.lit(None).cast("string").alias("evidence_status"),
        F.lit(None).cast("string").alias("response_action"), empty.alias("reason_codes"), empty.alias("missing_information"), F.lit(False).alias("uncertainty"), F.lit(None).cast("string").alias("annotated_at"),
    )


def receipt(records: DataFrame, template: DataFrame) -> DataFrame:
    """One row per annotator: records, statuses and a binding. Records must cover the template exactly."""
    keys = ["annotator_id", "case_id"]
    wrong = records.select(*keys).exceptAll(template.select(*keys)).union(template.select(*keys).exceptAll(records.select(*keys)))
    if not wrong.isEmpty():
        raise ContractViolation(f"records and assignments differ: {wrong.first()}")
    digest = F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256)
    sums = F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)"))
    return records.groupBy("annotator_id").agg(F.count("*").alias("record_count"), F.count_if(F.col("evidence_status") == "sufficient").alias("sufficient_count"), F.count_if(F.col("uncertainty")).alias("uncertain_count"), F.sha2(sums.cast("string"), 256).alias("records_sha256"))


def _listed(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row with all rows of ``df`` in the order of a code, of which there are few."""
    rest = [c for c in df.columns if c != key]
    return df.agg(F.sort_array(F.collect_list(F.struct(key, *rest))).alias(name))


def _bound(facts: DataFrame, identity: dict[str, str]) -> DataFrame:
    return facts.select(*[F.lit(v).alias(k) for k, v in identity.items()], *facts.columns)


def agreement_report(pairs: DataFrame, identity: dict[str, str]) -> DataFrame:
    """One row: ``identity`` (ids, versions and hashes of what was compared) and the agreement of both annotators.

    ``pairs`` are those of ``governance.annotator_pairs`` with evidence_status
    and reason_codes.
    """
    status = governance.kappa(pairs, "first_evidence_status", "second_evidence_status").select("case_count", F.struct(F.col("agreement").alias("raw_agreement"), F.col("kappa").alias("cohen_kappa")).alias("status_agreement"))
    per_code = governance.code_scores(pairs, "first_reason_codes", "second_reason_codes")
    sets = governance.code_agreement(pairs, "first_reason_codes", "second_reason_codes").crossJoin(F.broadcast(governance.macro(per_code))).crossJoin(F.broadcast(_listed(per_code, "code", "per_code")))
    who = pairs.agg(F.sort_array(F.array_distinct(F.flatten(F.array(F.collect_set("first_annotator_id"), F.collect_set("second_annotator_id"))))).alias("annotator_ids"))
    facts = who.crossJoin(F.broadcast(status)).crossJoin(F.broadcast(sets.select(F.struct("*").alias("reason_code_agreement"))))
    return _bound(facts, identity)


def structure_report(pairs: DataFrame, metadata: DataFrame, identity: dict[str, str], columns: tuple[str, ...] = ("question_structure_codes", "evidence_structure_codes")) -> DataFrame:
    """One row: ``identity``, the number of cases and each structure's counts in the order of its codes."""
    facts = pairs.agg(F.count("*").alias("case_count"))
    for name in columns:
        facts = facts.crossJoin(F.broadcast(_listed(governance.structure_counts(pairs, metadata, name), "structure_code", name.removesuffix("_codes") + "_counts")))
    return _bound(facts, identity)

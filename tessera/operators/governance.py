"""Leakage components, grouped splits, agreement of annotators, and contracts."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.checkpoints import cut
from ..functions.order import dense_order
from ..functions.sizes import look_up

SPLITS = ("train", "validation", "test")


class ContractViolation(ValueError):
    """Rows break a contract; the message has the first of them."""


def enforce(violations: DataFrame, name: str = "contract") -> None:
    """Raise if there is any violation; at most ten rows are fetched."""
    rows = violations.limit(10).collect()
    if rows:
        raise ContractViolation(f"{name}: " + "; ".join(str(r.asDict()) for r in rows))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b).

    Every node points to the first of itself and its neighbours, in an order by
    hashes that each round draws anew, and pointers are contracted: what remains
    of the links goes on between the nodes that were pointed to. As the order
    has nothing to do with names, each round leaves a fraction of the nodes of
    the one before, so a chain of n takes a logarithm of rounds however it is
    named. Pointers are put together at the end, from the last and smallest
    round on; all nodes are read twice, not once a round. A hub, or the root of a
    component with most nodes, has no task of its own: see :func:`sizes.look_up`.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # a node that is linked with itself is one of the first round
    edges, rounds = cut(ordered(links.where("a IS NOT NULL AND b IS NOT NULL"))), []
    while not edges.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        point = edges.union(edges.select("b", "a")).groupBy("a").agg(F.count("*").alias("_n"), F.min(place("b")).alias("low"))
        point = cut(point.select("a", "_n", F.when(F.col("low") < place("a"), F.col("low.node")).otherwise(F.col("a")).alias("to")))
        for end, other in (("a", "b"), ("b", "a")):
            named = point.withColumnRenamed("a", end)
            met = look_up(edges, named.drop("_n"), end, counts=named.drop("to"))
            edges = met.select(F.col("to").alias(end), other)
        edges = cut(ordered(edges.where("a <> b")))
        rounds.append(point.select(F.col("a").alias("node"), "to"))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds.pop().withColumnRenamed("to", "root")
    for point in reversed(rounds):
        met = look_up(point, labels.withColumnRenamed("node", "to"), "to")
        labels = cut(met.select("node", F.coalesce("root", "to").alias("root")))
    least = cut(labels.groupBy("root").agg(F.min("node").alias("component")))
    return look_up(labels, least, "root").select("node", "component")


def leakage_links(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """Links (a, b) of a case with its query, its passages and their logical sources."""
    case = F.concat(F.lit("case:"), F.col("case_id").cast("string"))
    evidence = cases.select(case.alias("a"), F.explode("evidence_passage_ids").alias("passage_id"))
    to = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    out = cases.select(case.alias("a"), to("query:", "query_id").alias("b"))
    out = out.union(evidence.select("a", to("passage:", "passage_id").alias("b")))
    return out.union(evidence.join(passages.select("passage_id", "logical_source_key"), "passage_id").where("logical_source_key IS NOT NULL").select("a", to("source:", "logical_source_key").alias("b")))


def case_components(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """case_id, component: cases that share a query, passage or source, directly or by others."""
    found = components(leakage_links(cases, passages)).where(F.col("node").startswith("case:"))
    # "case:" stands before all other kinds, so the least node is the least case
    return found.select(F.expr("substring(node, 6)").alias("case_id"), F.expr("substring(component, 6)").alias("component"))


def split_violations(assignments: DataFrame, groups: Iterable[str] = ("component", "query_id")) -> DataFrame:
    """Groups whose cases are in several splits, and cases assigned twice or not at all."""
    out = assignments.groupBy("case_id").agg(F.count("*").alias("n"), F.count("split_name").alias("s")).where("n > 1 OR s = 0").select(F.col("case_id").cast("string").alias("id"), F.lit("case").alias("rule"))
    for g in groups:
        bad = assignments.groupBy(g).agg(F.count_distinct("split_name").alias("n")).where("n > 1")
        out = out.union(bad.select(F.col(g).cast("string").alias("id"), F.lit(f"{g} crosses splits").alias("rule")))
    return out


def grouped_splits(groups: DataFrame, shares: tuple[float, ...] = (0.6, 0.2, 0.2), names: tuple[str, ...] = SPLITS) -> DataFrame:
    """document_id, query_id, split_name, greedily and whole groups only.

    ``groups`` has document_id, query_id, case_count, insufficient_count. In
    each document, groups with most insufficient cases come first; a group
    goes where case and insufficient counts come nearest to their targets,
    with a preference for splits with many places left.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["insufficient_count", "case_count", "h"], ascending=[False, False, True], kind="stable")
        n = len(group)
        places = [int(s * n) for s in shares]
        for i in range(n - sum(places)):
            places[i % len(places)] += 1
        share, left = [p / n for p in places], list(places)
        cases, bad = [0] * len(names), [0] * len(names)
        all_cases, all_bad, out = int(group["case_count"].sum()), int(group["insufficient_count"].sum()), []
        for c, b in zip(group["case_count"].tolist(), group["insufficient_count"].tolist(), strict=True):
            cost = []
            for i in range(len(names)):
                if left[i]:
                    want, want_bad = all_cases * share[i], all_bad * share[i]
                    cost.append((((cases[i] + c - want) / max(1.0, want)) ** 2 + ((bad[i] + b - want_bad) / max(1.0, want_bad)) ** 2 + 1.0 / left[i], i))
            i = min(cost)[1]
            left[i], cases[i], bad[i] = left[i] - 1, cases[i] + c, bad[i] + b
            out.append(names[i])
        return group.assign(split_name=out)[["document_id", "query_id", "split_name"]]

    rows = groups.withColumn("h", T.sha256(F.col("query_id").cast("string")))
    return rows.groupBy("document_id").applyInPandas(run, rows.select("document_id", "query_id", F.lit("").alias("split_name")).schema)


def kappa(pairs: DataFrame, first: str = "first_status", second: str = "second_status", positive: str = "sufficient") -> DataFrame:
    """One row: cases, agreement, Cohen's kappa (null where chance agrees fully)."""
    a, b = F.col(first) == positive, F.col(second) == positive
    out = pairs.agg(F.count("*").alias("case_count"), F.avg((F.col(first) == F.col(second)).cast("double")).alias("agreement"), F.avg(a.cast("double")).alias("pa"), F.avg(b.cast("double")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return out.select("case_count", "agreement", F.when(chance < 1, F.try_divide(F.col("agreement") - chance, 1 - chance)).alias("kappa"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of codes; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def code_agreement(pairs: DataFrame, first: str = "first_codes", second: str = "second_codes") -> DataFrame:
    """One row: mean Jaccard similarity and share of equal sets."""
    same = F.sort_array(first) == F.sort_array(second)
    return pairs.agg(F.avg(jaccard(F.col(first), F.col(second))).alias("mean_jaccard"), F.avg(same.cast("double")).alias("exact_match_rate"))


def code_scores(pairs: DataFrame, first: str = "first_codes", second: str = "second_codes") -> DataFrame:
    """Per code: tp, fp, fn, precision, recall, f1, the first annotator being the reference."""
    one = pairs.select("case_id", F.explode(F.array_distinct(first)).alias("code"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    two = pairs.select("case_id", F.explode(F.array_distinct(second)).alias("code"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    rows = one.union(two).groupBy("case_id", "code").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    out = rows.groupBy("code").agg(F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("tp"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("fp"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.select("code", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    """One row of unweighted means over codes; null without codes."""
    return scores.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def adjudication_needed(pairs: DataFrame) -> DataFrame:
    """Cases with any disagreement or any uncertainty."""
    differs = (F.col("first_status") != F.col("second_status")) | (F.sort_array("first_codes") != F.sort_array("second_codes"))
    unsure = F.coalesce(F.col("first_uncertain"), F.lit(False)) | F.coalesce(F.col("second_uncertain"), F.lit(False))
    return pairs.withColumn("disagrees", differs).withColumn("uncertain", unsure).where("disagrees OR uncertain")


def adjudication_violations(records: DataFrame, needed: DataFrame) -> DataFrame:
    """case_id and rule: records must be exactly the cases that need one, with categories where labels differ.

    ``records`` has case_id, final_status, final_codes, categories,
    guide_change and guide_summary.
    """
    out = records.join(needed.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("not needed").alias("rule"))
    out = out.union(needed.join(records.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("missing")))
    out = out.union(records.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("repeated")))
    rows = records.join(needed.select("case_id", "disagrees"), "case_id")
    rule = (
        F.when(F.col("disagrees") & (F.size("categories") == 0), "no category").when(F.col("guide_change") != F.col("guide_summary").isNotNull(), "guide change without summary")
        .when((F.col("final_status") == "sufficient") & (F.size("final_codes") > 0), "codes of sufficient evidence").when((F.col("final_status") == "insufficient") & (F.size("final_codes") == 0), "no codes")
    )
    return out.union(rows.select("case_id", rule.alias("rule")).where("rule IS NOT NULL"))


def alignment_violations(left: DataFrame, right: DataFrame, key: str = "case_id", order: str = "position") -> DataFrame:
    """Keys that are on one side only or at different positions."""
    a, b = left.select(key, F.col(order).alias("_a")), right.select(key, F.col(order).alias("_b"))
    rows = a.join(b, key, "full_outer")
    rule = F.when(F.col("_b").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").when(F.col("_a") != F.col("_b"), "position")
    return rows.select(key, rule.alias("rule")).where("rule IS NOT NULL")


def enumeration_violations(rows: DataFrame, allowed: dict[str, list[str]], key: str = "case_id") -> DataFrame:
    """Key and column of values outside their column's list; arrays are checked by element."""
    found = []
    for name, values in allowed.items():
        many = rows.schema[name].dataType.typeName() == "array"
        bad = F.size(F.array_except(name, F.array(*map(F.lit, values)))) > 0 if many else ~F.col(name).isin(*values)
        found.append(F.when(F.col(name).isNull() | bad, name))
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("rule"))


def disagreement_by_code(pairs: DataFrame, metadata: DataFrame, codes: str) -> DataFrame:
    """Per structure code: cases and disagreements; a case counts once for each of its codes."""
    rows = pairs.join(metadata.select("case_id", F.explode(F.array_distinct(codes)).alias("structure_code")), "case_id")
    return rows.groupBy("structure_code").agg(F.count("*").alias("case_count"), F.count_if(F.col("first_status") != F.col("second_status")).alias("status_disagreements"))


def group_counts(cases: DataFrame) -> DataFrame:
    """Per query: its document, its cases and how many of them are insufficient, as ``grouped_splits`` takes them.

    A query whose cases name several documents, or none, has a null document.
    """
    one = F.when((F.min("document_id") == F.max("document_id")) & (F.count("document_id") == F.count("*")), F.min("document_id"))
    return cases.groupBy("query_id").agg(one.alias("document_id"), F.count("*").alias("case_count"), F.count_if(F.col("evidence_status") == "insufficient").alias("insufficient_count"))


def annotator_pairs(records: DataFrame, fields: Iterable[str], key: str = "case_id", annotator: str = "annotator_id") -> DataFrame:
    """One row per case of exactly two annotators: both ids and each of ``fields`` as first_* and second_*.

    The first is the smaller id. Cases with another number of records are
    left out; :func:`pair_violations` lists them.
    """
    both = F.struct(annotator, *fields)
    rows = records.groupBy(key).agg(F.count("*").alias("_n"), F.min_by(both, annotator).alias("_a"), F.max_by(both, annotator).alias("_b"))
    rows = rows.where((F.col("_n") == 2) & (F.col(f"_a.{annotator}") != F.col(f"_b.{annotator}")))
    return rows.select(key, *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("_a", "first"), ("_b", "second")) for c in (annotator, *fields)])


def pair_violations(records: DataFrame, key: str = "case_id", annotator: str = "annotator_id") -> DataFrame:
    """Key and rule of cases that don't have one record each of two annotators."""
    rows = records.groupBy(key).agg(F.count("*").alias("n"), F.min(annotator).alias("a"), F.max(annotator).alias("b"))
    rule = F.when(F.col("n") != 2, "records").when(F.col("a").isNull() | (F.col("a") == F.col("b")), "one annotator")
    return rows.select(key, rule.alias("rule")).where("rule IS NOT NULL")


def structure_counts(pairs: DataFrame, metadata: DataFrame, codes: str) -> DataFrame:
    """Per code of a structure: its cases and how many differ, are uncertain or need a third opinion.

    ``pairs`` has first_* and second_* of evidence_status, response_action,
    reason_codes and uncertainty. A case counts once for each of its codes.
    """
    differs = lambda c: ~F.col(f"first_{c}").eqNullSafe(F.col(f"second_{c}"))
    status, action = differs("evidence_status"), differs("response_action")
    reasons = ~F.sort_array(F.array_distinct("first_reason_codes")).eqNullSafe(F.sort_array(F.array_distinct("second_reason_codes")))
    unsure = F.coalesce("first_uncertainty", F.lit(False)) | F.coalesce("second_uncertainty", F.lit(False))
    any_of = status | action | reasons
    rows = pairs.join(metadata.select("case_id", F.explode(F.array_distinct(codes)).alias("structure_code")), "case_id")
    counts = {
        "disagreement_case_count": any_of, "uncertainty_case_count": unsure, "requires_adjudication_count": any_of | unsure, "evidence_status_disagreement_count": status,
        "response_action_disagreement_count": action, "reason_codes_disagreement_count": reasons,
    }
    return rows.groupBy("structure_code").agg(F.count("*").alias("case_count"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def url_rule(url: Column, hosts: list[str]) -> Column:
    """Why a URL isn't allowed: not HTTPS, or a host off the list; null if it is."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(scheme.isNull() | (scheme != "https"), "not https").when(host.isNull() | ~host.isin(*hosts), "host")


def iso_date_rule(value: Column) -> Column:
    good = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    return F.when(value.isNotNull() & ~good, "date")


def timestamp_rule(value: Column) -> Column:
    """UTC to the second, written exactly as YYYY-MM-DDTHH:MM:SSZ."""
    at = F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(at.isNull() | (F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'") != value), "timestamp")


def manifest_violations(documents: DataFrame, hosts: list[str]) -> DataFrame:
    """document_id and rule of manifest rows: URLs, dates, file names, repeats."""
    rules = [url_rule(F.col("download_url"), hosts)]
    rules += [iso_date_rule(F.col(c)) for c in ("publication_date", "verified_date") if c in documents.columns]
    name = F.col("filename")
    rules += [F.when(name.isNull() | ~F.lower(name).endswith(".pdf") | name.rlike(r"[/\\]"), "filename")]
    out = documents.select(F.col("document_id").cast("string").alias("document_id"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    for c in ("document_id", "filename", "download_url"):
        twice = documents.groupBy(c).agg(F.count("*").alias("n"), F.min("document_id").alias("d")).where("n > 1")
        out = out.union(twice.select(F.col("d").cast("string"), F.lit(f"{c} repeated")))
    return out


def set_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(F.col(key).cast("string").alias("id")).distinct(), right.select(F.col(key).cast("string").alias("id")).distinct()
    return a.join(b, "id", "left_anti").select("id", F.lit("unexpected").alias("rule")).union(b.join(a, "id", "left_anti").select("id", F.lit("missing").alias("rule")))


def benchmark_violations(questions: DataFrame, judgments: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id and rule: judgments of answer and abstain queries, their grades, passages and scope.

    ``questions`` has query_id, expected_behavior, document_scope.
    """
    counts = judgments.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("relevance_grade") == 2).alias("direct"))
    rows = questions.join(counts, "query_id", "left").fillna(0, ["n", "direct"])
    answers = F.col("expected_behavior") == "answer"
    rule = F.when(~F.col("expected_behavior").isin("answer", "abstain"), "behavior").when(answers & (F.col("n") == 0), "no judgment").when(answers & (F.col("direct") == 0), "no direct evidence").when(~answers & (F.col("n") > 0), "abstention with judgments")
    out = rows.select("query_id", rule.alias("rule")).where("rule IS NOT NULL")
    known = judgments.join(passages.select("passage_id", "document_id"), "passage_id", "left").join(questions.select("query_id", "document_scope"), "query_id")
    bad = F.when(~F.col("relevance_grade").isin(1, 2), "grade").when(F.col("document_id").isNull(), "no such passage").when(~F.array_contains("document_scope", F.col("document_id")), "outside the scope")
    out = out.union(known.select("query_id", bad.alias("rule")).where("rule IS NOT NULL"))
    twice = judgments.groupBy("query_id", "passage_id").count().where("count > 1").select("query_id", F.lit("judged twice").alias("rule"))
    return out.union(twice)


def label_violations(cases: DataFrame) -> DataFrame:
    """case_id and rule where status, action, codes and missing information don't go together."""
    enough, n, m = F.col("evidence_status") == "sufficient", F.size("reason_codes"), F.size("missing_information")
    rule = (
        F.when(~F.col("evidence_status").isin("sufficient", "insufficient"), "status").when(enough & (F.col("response_action") != "answer"), "action")
        .when(~enough & (F.col("response_action") != "abstain"), "action").when(enough & ((n > 0) | (m > 0)), "codes of sufficient evidence").when(~enough & ((n == 0) | (m == 0)), "no codes")
        .when(n != F.size(F.array_distinct("reason_codes")), "codes repeated")
    )
    return cases.select("case_id", rule.alias("rule")).where("rule IS NOT NULL")


def forbidden_fields(df: DataFrame, forbidden: set[str]) -> list[str]:
    """Columns that a blinded table must not have."""
    return sorted(set(df.columns) & forbidden)


def inventory_violations(inventory: DataFrame, development: DataFrame) -> DataFrame:
    """New queries that repeat a development query's id or its question after normalisation.

    The inventory is read and normalised once. It stays where it is unless
    development has more than ``sizes.MAX_ROWS`` ids or questions.
    """
    norm = lambda df: df.select("query_id", T.normalized_question(F.col("question")).alias("q"))
    known = norm(development)
    rows = look_up(norm(inventory), known.select("query_id").distinct().withColumn("_id", F.lit(True)), "query_id")
    rows = look_up(rows, known.select("q").distinct().withColumn("_q", F.lit(True)), "q")
    rules = F.array_compact(F.array(F.when(F.col("_id"), "id in development"), F.when(F.col("_q"), "question in development")))
    return rows.select("query_id", F.explode(rules).alias("rule"))


def round_assignments(cases: DataFrame, annotators: list[str], adjudicator: str, seed: str = "round") -> DataFrame:
    """annotator_id, position, case_id: every annotator gets every case, in an order of their own."""
    if len(set(annotators)) != len(annotators) or len(annotators) < 2 or adjudicator in annotators:
        raise ContractViolation("a round needs two annotators or more, all different from the adjudicator")
    who = F.explode(F.array(*map(F.lit, annotators))).alias("annotator_id")
    rows = cases.select("case_id", who)
    order = T.sha256(F.concat_ws(":", F.lit(seed), "annotator_id", F.col("case_id").cast("string")))
    # annotators have as many cases each, so places in one order of all give places in their own
    n = cases.count()
    placed = dense_order(rows.withColumn("_order", order), "annotator_id", "_order", "case_id", name="_place")
    return placed.select("annotator_id", (F.pmod("_place", F.lit(max(1, n))) + 1).cast("int").alias("position"), "case_id")


def assignment_violations(assignments: DataFrame, cases: DataFrame) -> DataFrame:
    """annotator_id and rule where an order isn't a permutation of all cases."""
    n = cases.agg(F.count("*").alias("n_cases"))
    found = assignments.join(cases.select("case_id", F.lit(1).alias("known")), "case_id", "left").groupBy("annotator_id").agg(F.count("known").alias("k"), F.count_distinct("case_id").alias("d"), F.count_distinct("position").alias("p"), F.max("position").alias("hi"))
    bad = (F.col("k") != F.col("n_cases")) | (F.col("d") != F.col("n_cases")) | (F.col("p") != F.col("n_cases")) | (F.col("hi") != F.col("n_cases"))
    return found.crossJoin(F.broadcast(n)).where(bad).select("annotator_id", F.lit("not a permutation").alias("rule"))


def binding(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: rows and a SHA-256 that binds all rows, whatever their partitioning.

    Rows are hashed as JSON with their key, summed per column of the digest,
    so no task orders or joins them; a repeated row changes the sum too.
    """
    digest = T.sha256(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    words = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    out = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(w), F.lit(0).cast("decimal(38,0)")).alias(f"w{i}") for i, w in enumerate(words)])
    return out.select("rows", T.sha256(F.concat_ws(":", "rows", *[F.col(f"w{i}").cast("string") for i in range(5)], F.lit(",".join(order)))).alias("sha256"))


def bound(df: DataFrame, order: list[str], sha256: str) -> DataFrame:
    """``df``, if :func:`binding` gives the pinned hash; else an error."""
    found = binding(df, order).first()["sha256"]
    if found != sha256:
        raise ContractViolation(f"rows have {found}, not {sha256}")
    return df

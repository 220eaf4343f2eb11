"""Question to answer or abstention, for any number of questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sizes import maybe_broadcast
from . import lexical
from .lexical_index import Index
from .sufficiency import Model, features

MAX_QUESTION, MAX_LIMIT, SHORT_BODY = 2000, 10, 120
#: What an abstention says is missing.
MISSING = "No passage that was found answers this question; more evidence on it is needed."
#: Reasons, as users of answers compare them.
NO_MATCH, ENOUGH, NOT_ENOUGH = "no_positive_lexical_match", "evidence_passed_silver_sufficiency_threshold", "evidence_below_silver_sufficiency_threshold"


def eligible(passages: DataFrame) -> DataFrame:
    """Passages that the service searches: no bibliography, no heading body of at most 120 characters."""
    reference = F.lit(False)
    if {"reference_entry_start_ordinal", "reference_entry_end_ordinal"} <= set(passages.columns):
        reference = F.col("reference_entry_start_ordinal").isNotNull() & F.col("reference_entry_end_ordinal").isNotNull()
    return passages.where(~reference & ~((F.col("unit_kind") == "heading_body") & (F.length("citation_text") <= SHORT_BODY)))


def question_violations(questions: DataFrame) -> DataFrame:
    clean = T.strip(F.col("text"))
    rule = F.when(clean.isNull() | (clean == ""), "empty").when(F.length(clean) > MAX_QUESTION, "too long")
    return questions.select("query_id", rule.alias("rule")).where("rule IS NOT NULL")


def select_evidence(hits: DataFrame) -> DataFrame:
    """The first positive hit, and the second if it is positive and of the same source."""
    first = F.max(F.when(F.col("rank") == 1, F.col("logical_source_key"))).over(Window.partitionBy("query_id"))
    rows = hits.where("score > 0 AND rank <= 2").withColumn("_first", first)
    same = (F.col("rank") == 2) & (F.col("_first") != "") & (F.col("logical_source_key") == F.col("_first"))
    return rows.where((F.col("rank") == 1) | same).drop("_first")


def answer(passages: DataFrame, questions: DataFrame, model: Model, limit: int = 5, normalize: bool = True, index: Index | None = None) -> DataFrame:
    """Per question: action, reason, probability_sufficient, answer, counts and feature values.

    ``passages`` has passage_id, text, citation_text, label, unit_kind and
    logical_source_key; ``questions`` query_id and text. A stored ``index`` of
    the eligible passages is probed instead of reading all texts.
    """
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError("limit must be an integer in 1..10")
    asked = questions.select("query_id", T.strip(F.col("text")).alias("text"))
    corpus = eligible(passages)
    hits = index.search(asked, limit) if index else lexical.rank(corpus, asked, limit, normalize=normalize)
    known = corpus.select("passage_id", "citation_text", "label", "logical_source_key")
    positive = hits.where("score > 0")
    chosen = select_evidence(known.join(maybe_broadcast(positive.where("rank <= 2")), "passage_id"))
    evidence = chosen.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "citation_text", "label"))).alias("e"))
    counted = positive.groupBy("query_id").agg(F.count("*").alias("positive"))
    rows = asked.join(evidence, "query_id", "left").join(counted, "query_id", "left")
    named = features(F.col("text"), F.col("e.citation_text"), F.col("e.label"))
    rows = rows.select("query_id", "e", "positive", *[F.when(F.col("e").isNotNull(), c).alias(n) for n, c in named.items()])
    rows = rows.withColumn("p", F.when(F.col("e").isNull(), 0.0).otherwise(model.probability({n: F.col(n) for n in named})))
    enough = F.col("e").isNotNull() & (F.col("p") >= model.threshold)
    numbered = F.array_join(F.transform("e", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["citation_text"])), "\n\n")
    reason = F.when(F.col("e").isNull(), NO_MATCH).when(enough, ENOUGH).otherwise(NOT_ENOUGH)
    return rows.select(
        "query_id", F.when(enough, "answer").otherwise("abstain").alias("action"), reason.alias("reason"), T.round12(F.col("p")).alias("probability_sufficient"),
        F.coalesce("positive", F.lit(0)).alias("positive_candidate_count"), F.coalesce(F.size("e"), F.lit(0)).alias("selected_passage_count"), F.when(enough, numbered).alias("answer"),
        F.when(enough, F.array().cast("array<string>")).otherwise(F.array(F.lit(MISSING))).alias("missing_information"), *[T.round12(F.col(n)).alias(n) for n in named],
    )

"""Queries of sufficiency, agreement, splits and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import governance as G
from ..operators import service
from ..operators import sufficiency as S
from . import adapters as A

#: A fixed model for the decision's query; the numbers are of no data set.
MODEL = S.Model((0.4, 0.2, 0.8, 0.1, -0.3), 0.1, (1.0, 5.0, 0.5, 0.1, 0.4), (1.0, 2.0, 0.25, 0.2, 0.2), 0.6)
HOSTS = ["example.com", "example.org"]


def evidence_features(spark, sf):
    rows = A.evidence(spark, sf)
    named = S.features(F.col("question"), F.col("texts"), F.col("labels"))
    return rows.select("query_id", "passage_id", *[F.round(c, 9).alias(n) for n, c in named.items()])


def _numbers(spark, sf):
    """Documents' length and words as two features."""
    docs = A.table(spark, sf, "documents")
    return docs.select("doc_id", F.col("n_chars").cast("double").alias("a"), T.count_words(F.col("text")).cast("double").alias("b"))


def standardize(spark, sf):
    rows = _numbers(spark, sf)
    out = S.standardize(rows, S.standardization(rows, ("a", "b")), ("a", "b"))
    return out.select("doc_id", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


def logistic_fit(spark, sf):
    """The model that labelled documents' length and words give, as one row: the optimum, by Newton's steps."""
    rows = _numbers(spark, sf).join(A.table(spark, sf, "labels"), "doc_id").withColumn("target", F.col("quality"))
    m = S.fit_newton(rows, ("a", "b"))
    return spark.createDataFrame([(*m.coefficients, m.intercept)], "a double, b double, intercept double").select(*[F.round(c, 9).alias(c) for c in ("a", "b", "intercept")])


def sigmoid_score(spark, sf):
    rows = _numbers(spark, sf)
    return rows.select("doc_id", T.round12(T.sigmoid((F.col("b") - 300) / 50)).alias("probability"))


def threshold_search(spark, sf):
    return S.best_threshold(S.thresholds(A.scored(spark, sf)))


def threshold_candidates(spark, sf):
    return S.thresholds(A.scored(spark, sf)).withColumn("threshold", F.round("threshold", 9))


def confusion_metrics(spark, sf):
    rows = A.scored(spark, sf).join(A.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "lang"), "case_id")
    return S.metrics(rows.withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0)), "lang")


def _service_passages(spark, sf):
    rows = A.passages(spark, sf)
    return rows.select("passage_id", "text", F.col("text").alias("citation_text"), F.col("document_id").alias("label"), F.lit("heading_body").alias("unit_kind"), F.col("document_id").alias("logical_source_key"))


def answer_or_abstain(spark, sf):
    out = service.answer(_service_passages(spark, sf), A.questions(spark, sf), MODEL, 5)
    return out.select("query_id", "action", "reason", F.round("probability_sufficient", 9).alias("probability_sufficient"), F.col("positive_candidate_count").cast("long").alias("positive"), F.col("selected_passage_count").cast("long").alias("selected"))


def agreement_kappa(spark, sf):
    return G.kappa(A.raters(spark, sf)).select("case_count", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


def jaccard_codes(spark, sf):
    return G.code_agreement(A.raters(spark, sf)).select(F.round("mean_jaccard", 9).alias("mean_jaccard"), F.round("exact_match_rate", 9).alias("exact_match_rate"))


def per_code_prf(spark, sf):
    out = G.code_scores(A.raters(spark, sf))
    return out.select("code", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def macro_prf(spark, sf):
    out = G.macro(G.code_scores(A.raters(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def adjudication(spark, sf):
    rows = A.raters(spark, sf).withColumn("first_uncertain", F.col("case_id") % 7 == 0).withColumn("second_uncertain", F.lit(False))
    return G.adjudication_needed(rows).select("case_id", "disagrees", "uncertain")


def disagreement_counts(spark, sf):
    meta = A.raters(spark, sf).select("case_id", F.array("lang", "source").alias("codes"))
    return G.disagreement_by_code(A.raters(spark, sf), meta, "codes")


def _cases(spark, sf):
    """Documents as cases: even ones are complete, odd ones name the case before; some name none, another query's, or have no strict subset of it."""
    docs, d = A.table(spark, sf, "documents"), F.col("doc_id")
    odd, name = d % 2 == 1, lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    codes = F.when(odd, F.array(F.lit("incomplete_evidence_set"), F.lit("strict_subset_of_complete_evidence"))).when(d % 10 == 4, F.array(F.lit("conflicting_passages"))).when(d % 6 == 0, F.array(F.lit("multiple_complementary_passages"))).otherwise(F.array(F.lit("one_complete_passage")))
    whole = F.when(d % 27 == 7, F.array(name(d - 1), name(d))).when(d % 33 == 9, F.array(F.lit("elsewhere"))).otherwise(F.array(name(d)))
    ids = F.when(odd, whole).otherwise(F.array(name(d), name(d + 1)))
    query, reference = F.floor(d / 2) + F.when(odd & (d % 21 == 5), 1_000_000).otherwise(0), F.when(odd, F.when(d % 15 == 1, d + 1_000_000_000).otherwise(d - 1))
    return docs.select(d.alias("case_id"), query.alias("query_id"), ids.alias("evidence_passage_ids"), codes.alias("evidence_structure_codes"), reference.alias("complete_reference_case_id"))


def silver_labels(spark, sf):
    rows = _cases(spark, sf)
    return rows.select("case_id", S.silver_label(F.col("evidence_structure_codes")).alias("evidence_status"))


def case_reference_checks(spark, sf):
    return S.reference_violations(_cases(spark, sf))


def _linked(spark, sf):
    """Customers as cases: the nation is the query, nation and segment the passage, the region its source."""
    nation = A.table(spark, sf, "nation")
    rows = A.table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    passage = F.concat_ws("-", "n_nationkey", "c_mktsegment")
    cases = rows.select(F.col("c_custkey").alias("case_id"), F.col("n_nationkey").alias("query_id"), F.array(passage).alias("evidence_passage_ids"), F.col("n_regionkey").alias("region"))
    passages = rows.select(passage.alias("passage_id"), F.col("n_regionkey").alias("logical_source_key")).distinct()
    return cases, passages


def leakage_components(spark, sf):
    """Customers as cases in chains: two share a query, two others a passage, and ten make a chain.

    Some passages have a source that leads from one chain of a hundred to another.
    """
    k = F.col("c_custkey")
    passage = F.when(k % 10 == 0, F.concat(F.lit("own-"), k)).otherwise(F.concat(F.lit("p-"), F.floor((k + 1) / 2)))
    rows = A.table(spark, sf, "customer").select(k.alias("case_id"), F.floor(k / 2).alias("query_id"), F.array(passage).alias("evidence_passage_ids"), F.when(k % 50 == 5, F.floor(k / 100)).alias("source"))
    passages = rows.select(F.col("evidence_passage_ids")[0].alias("passage_id"), "source").groupBy("passage_id").agg(F.max("source").alias("logical_source_key"))
    return G.case_components(rows.drop("source"), passages)


def split_leak_check(spark, sf):
    cases, _ = _linked(spark, sf)
    split = F.when(F.col("case_id") % 3 == 0, "test").otherwise("train")
    rows = cases.select("case_id", "query_id", F.col("region").alias("component"), split.alias("split_name"))
    return G.split_violations(rows)


def grouped_split(spark, sf):
    rows = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels"), "doc_id", "left")
    groups = rows.groupBy(F.col("lang").alias("document_id"), F.col("source").alias("query_id")).agg(F.count("*").alias("case_count"), F.count_if(F.col("quality") == 0).alias("insufficient_count"))
    return G.grouped_splits(groups)


def benchmark_contract(spark, sf):
    asked = A.questions(spark, sf).select("query_id", F.when(F.col("query_id") % 2 == 0, "answer").otherwise("abstain").alias("expected_behavior"), F.array(*[F.lit(f"src{i}") for i in range(15)]).alias("document_scope"))
    judged = A.gold(spark, sf).select("query_id", "passage_id", F.col("grade").alias("relevance_grade"))
    return G.benchmark_violations(asked, judged, A.passages(spark, sf))


def inventory_antijoin(spark, sf):
    """Every line of every document as a new question, against the benchmark's questions."""
    lines = A.document_lines(spark, sf).select(F.col("document_id").alias("query_id"), F.col("text").alias("question"))
    conv = A.table(spark, sf, "benchmark").select((F.col("item_id") + 100000000).alias("query_id"), F.explode(F.split("text", "\n")).alias("question")).where(F.trim("question") != "")
    return G.inventory_violations(lines, conv)


def _manifest(spark, sf):
    return A.table(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.when(F.col("page_id") % 50 == 9, "https://example.com/same").otherwise(F.col("url")).alias("download_url"), F.concat(F.lit("p"), "page_id", F.when(F.col("page_id") % 10 == 0, ".txt").otherwise(".pdf")).alias("filename"), F.when(F.col("page_id") % 13 == 0, "2024-02-30").otherwise("2024-05-06").alias("verified_date"))


def manifest_urls(spark, sf):
    return G.manifest_violations(_manifest(spark, sf), HOSTS)


def url_domain_check(spark, sf):
    rows = A.table(spark, sf, "pages").select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), G.url_rule(F.col("url"), HOSTS).alias("rule"))
    return rows.groupBy("host", "rule").agg(F.count("*").alias("pages"))


def round_assignment(spark, sf):
    cases = A.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"))
    return G.round_assignments(cases, ["ann-a", "ann-b"], "ann-c")


def label_contract(spark, sf):
    rows = A.raters(spark, sf)
    action = F.when(F.col("first_status") == "sufficient", "answer").otherwise("abstain")
    cases = rows.select("case_id", F.col("first_status").alias("evidence_status"), action.alias("response_action"), F.col("first_codes").alias("reason_codes"), F.col("first_codes").alias("missing_information"))
    return G.label_violations(cases)


def sha256_binding(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", T.sha256(F.col("text")).alias("text_sha256"))


def question_words(spark, sf):
    rows = A.questions(spark, sf)
    return rows.select("query_id", F.size(T.content_tokens(F.col("text"))).cast("long").alias("content_tokens"), F.size(T.word_tokens(F.col("text"))).cast("long").alias("word_tokens"), F.md5(T.normalized_question(F.col("text"))).alias("normalized_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_features, standardize, logistic_fit, sigmoid_score, threshold_search, threshold_candidates, confusion_metrics, answer_or_abstain, agreement_kappa,
        jaccard_codes, per_code_prf, macro_prf, adjudication, disagreement_counts, silver_labels, case_reference_checks, leakage_components, split_leak_check,
        grouped_split, benchmark_contract, inventory_antijoin, manifest_urls, url_domain_check, round_assignment, label_contract, sha256_binding, question_words,
    )
}

from .ranking import _GOLD, _rank_sql  # noqa: E402
from .structure import _LINES  # noqa: E402

_WORD = "'[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {_WORD}), lambda w: lower(w))"


def _content(x: str) -> str:
    return f"list_filter(list_distinct({_tokens(x)}), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"


_FEATURES = """CAST(n AS DOUBLE) AS evidence_count, ln(1 + len(words)) AS log_evidence_word_count, CASE WHEN len(asked) > 0 THEN CAST(len(list_intersect(asked, found)) AS DOUBLE) / len(asked) ELSE 0 END AS question_content_coverage,
  CASE WHEN len(asked) > 0 THEN CAST(len(list_intersect(asked, named)) AS DOUBLE) / len(asked) ELSE 0 END AS citation_label_content_coverage, CAST(len(found) AS DOUBLE) / greatest(1, len(words)) AS evidence_content_density"""
_RATERS = """r AS (SELECT doc_id AS case_id, lang, source, quality = 1 AS a, toxic = 1 AS b, list_filter([CASE WHEN quality = 0 THEN 'noise' END, CASE WHEN toxic = 1 THEN 'harm' END], lambda x: x IS NOT NULL) AS x,
  list_filter([CASE WHEN n_chars < 500 THEN 'noise' END, CASE WHEN toxic = 1 THEN 'harm' END], lambda x: x IS NOT NULL) AS y FROM labels JOIN documents USING (doc_id))"""
_SCORED = "s AS (SELECT doc_id AS case_id, lang, quality AS target, round(1 / (1 + exp(-(ln(n_chars + 1.0) - 6))), 3) AS probability FROM labels JOIN documents USING (doc_id))"
_RATES = """CAST({tp} AS DOUBLE) AS tp, CAST({fp} AS DOUBLE) AS fp, CAST({fn} AS DOUBLE) AS fn"""
_CUTS = f"""{_SCORED}, v AS (SELECT DISTINCT probability AS p FROM s), c AS (SELECT p AS threshold FROM v UNION SELECT (p + lead(p) OVER (ORDER BY p)) / 2 FROM v UNION SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE])),
m AS (SELECT threshold, CAST(count(*) FILTER (target = 1 AND probability >= threshold) AS DOUBLE) AS tp, count(*) FILTER (target = 0 AND probability >= threshold) AS fp, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n
  FROM c CROSS JOIN s WHERE threshold IS NOT NULL GROUP BY threshold),
k AS (SELECT threshold, round((CASE WHEN p > 0 THEN tp / p ELSE 0 END + CASE WHEN n > 0 THEN (n - fp) / CAST(n AS DOUBLE) ELSE 0 END) / 2, 12) AS balanced_accuracy,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p) ELSE 0 END, 12) AS f1 FROM m)"""
_PRF = """c AS (SELECT code, CAST(count(*) FILTER (u AND w) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT u AND w) AS DOUBLE) AS fp, CAST(count(*) FILTER (u AND NOT w) AS DOUBLE) AS fn FROM (
  SELECT code, list_contains(x, code) AS u, list_contains(y, code) AS w FROM r CROSS JOIN (SELECT unnest(['noise', 'harm']) AS code)) WHERE u OR w GROUP BY code),
k AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM k)"""
_CASES = """c AS (SELECT doc_id AS case_id, doc_id // 2 + CASE WHEN doc_id % 2 = 1 AND doc_id % 21 = 5 THEN 1000000 ELSE 0 END AS query_id,
  CASE WHEN doc_id % 2 = 0 THEN ['src' || doc_id % 20, 'src' || (doc_id + 1) % 20] WHEN doc_id % 27 = 7 THEN ['src' || (doc_id - 1) % 20, 'src' || doc_id % 20] WHEN doc_id % 33 = 9 THEN ['elsewhere'] ELSE ['src' || doc_id % 20] END AS ids,
  CASE WHEN doc_id % 2 = 1 THEN ['incomplete_evidence_set', 'strict_subset_of_complete_evidence'] WHEN doc_id % 10 = 4 THEN ['conflicting_passages'] WHEN doc_id % 6 = 0 THEN ['multiple_complementary_passages'] ELSE ['one_complete_passage'] END AS codes,
  CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 15 = 1 THEN doc_id + 1000000000 ELSE doc_id - 1 END END AS ref FROM documents)"""
_HOST = r"lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1))"
_HOSTED = "CASE WHEN page_id % 50 = 9 THEN 'https://example.com/same' ELSE url END"
_DATED = "CASE WHEN page_id % 13 = 0 THEN '2024-02-30' ELSE '2024-05-06' END"
_URL = f"CASE WHEN NOT starts_with(url, 'https://') THEN 'not https' WHEN {_HOST} NOT IN ('example.com', 'example.org') THEN 'host' END"

ORACLE = {
    "evidence_features": f"""WITH {_GOLD}, e AS (SELECT g.query_id, g.passage_id, 1 AS n, {_content('b.text')} AS asked, {_content('d.text')} AS found, {_content('d.source')} AS named, {_tokens('d.text')} AS words
  FROM g JOIN documents d ON d.doc_id = g.passage_id JOIN benchmark b ON b.item_id = g.query_id), f AS (SELECT query_id, passage_id, {_FEATURES} FROM e)
SELECT query_id, passage_id, {', '.join(f'round({c}, 9) AS {c}' for c in S.FEATURES)} FROM f""",
    "standardize": r"""WITH x AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS a, CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) AS b FROM documents), m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM x)
SELECT doc_id, round((a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 9) AS a, round((b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END, 9) AS b FROM x CROSS JOIN m""",
    "sigmoid_score": r"SELECT doc_id, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 12) AS probability FROM (SELECT doc_id, (len(regexp_extract_all(text, '\S+')) - 300) / 50.0::DOUBLE AS z FROM documents)",
    "threshold_search": f"WITH {_CUTS} SELECT threshold, balanced_accuracy, f1 FROM k ORDER BY balanced_accuracy DESC, f1 DESC, -abs(threshold - 0.5) DESC, threshold DESC LIMIT 1",
    "threshold_candidates": f"WITH {_CUTS} SELECT round(threshold, 9) AS threshold, balanced_accuracy, f1 FROM k",
    "confusion_metrics": f"""WITH {_SCORED}, c AS (SELECT lang, count(*) AS case_count, count(*) FILTER (target = 1 AND probability >= 0.5) AS tp, count(*) FILTER (target = 0 AND probability < 0.5) AS tn, count(*) FILTER (target = 0 AND probability >= 0.5) AS fp,
  count(*) FILTER (target = 1 AND probability < 0.5) AS fn FROM s GROUP BY lang), k AS (SELECT *, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r, CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END AS s, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p FROM c)
SELECT lang, case_count, tp, tn, fp, fn, round(CAST(tp + tn AS DOUBLE) / case_count, 12) AS accuracy, round((r + s) / 2, 12) AS balanced_accuracy, round(p, 12) AS precision, round(r, 12) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 12) AS f1 FROM k""",
    "answer_or_abstain": f"""WITH {_rank_sql(5).replace('FROM documents', 'FROM documents WHERE length(text) > 120')},
h AS (SELECT bm.*, d.text, d.source, max(CASE WHEN bm.rank = 1 THEN d.source END) OVER (PARTITION BY bm.query_id) AS first FROM bm JOIN documents d ON d.doc_id = bm.passage_id WHERE score > 0),
e AS (SELECT query_id, count(*) AS n, string_agg(text, chr(10) ORDER BY rank) AS t, string_agg(source, chr(10) ORDER BY rank) AS l FROM h WHERE rank = 1 OR (rank = 2 AND source = first AND first <> '') GROUP BY query_id),
x AS (SELECT b.item_id AS query_id, e.n, {_content('b.text')} AS asked, {_content('e.t')} AS found, {_content('e.l')} AS named, {_tokens('e.t')} AS words FROM benchmark b LEFT JOIN e ON e.query_id = b.item_id),
fz AS (SELECT query_id, n, {_FEATURES} FROM x),
z AS (SELECT *, 0.1 + 0.4 * (evidence_count - 1) + 0.2 * ((log_evidence_word_count - 5) / 2) + 0.8 * ((question_content_coverage - 0.5) / 0.25) + 0.1 * ((citation_label_content_coverage - 0.1) / 0.2) - 0.3 * ((evidence_content_density - 0.4) / 0.2) AS v FROM fz),
pr AS (SELECT *, CASE WHEN n IS NULL THEN 0 ELSE 1 / (1 + exp(-v)) END AS prob FROM z)
SELECT query_id, CASE WHEN n IS NOT NULL AND prob >= 0.6 THEN 'answer' ELSE 'abstain' END AS action, CASE WHEN n IS NULL THEN 'no_positive_lexical_match' WHEN prob >= 0.6 THEN 'evidence_passed_silver_sufficiency_threshold' ELSE 'evidence_below_silver_sufficiency_threshold' END AS reason,
  round(prob, 9) AS probability_sufficient, (SELECT count(*) FROM h WHERE h.query_id = pr.query_id) AS positive, coalesce(n, 0) AS selected FROM pr""",
    "agreement_kappa": f"""WITH {_RATERS}, k AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(CAST(a AS DOUBLE)) AS pa, avg(CAST(b AS DOUBLE)) AS pb FROM r)
SELECT n AS case_count, round(po, 9) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 9) AS kappa FROM k""",
    "jaccard_codes": f"WITH {_RATERS} SELECT round(avg(CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END), 9) AS mean_jaccard, round(avg(CAST(list_sort(x) = list_sort(y) AS DOUBLE)), 9) AS exact_match_rate FROM r",
    "per_code_prf": f"WITH {_RATERS}, {_PRF} SELECT code, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f",
    "macro_prf": f"WITH {_RATERS}, {_PRF} SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1 FROM f",
    "adjudication": f"WITH {_RATERS} SELECT case_id, a <> b OR list_sort(x) <> list_sort(y) AS disagrees, case_id % 7 = 0 AS uncertain FROM r WHERE a <> b OR list_sort(x) <> list_sort(y) OR case_id % 7 = 0",
    "disagreement_counts": f"WITH {_RATERS} SELECT structure_code, count(*) AS case_count, count(*) FILTER (a <> b) AS status_disagreements FROM (SELECT unnest(list_distinct([lang, source])) AS structure_code, a, b FROM r) GROUP BY structure_code",
    "silver_labels": f"""WITH {_CASES} SELECT case_id, CASE WHEN list_contains(codes, 'incomplete_evidence_set') THEN 'insufficient' WHEN list_has_any(codes, ['one_complete_passage', 'multiple_complementary_passages']) THEN 'sufficient' END AS evidence_status FROM c""",
    "case_reference_checks": f"""WITH {_CASES}, j AS (SELECT c.case_id, c.query_id, c.ids, o.query_id AS q, o.ids AS whole FROM c LEFT JOIN c o ON o.case_id = c.ref WHERE c.ref IS NOT NULL),
k AS (SELECT case_id, CASE WHEN whole IS NULL THEN 'no such case' WHEN q <> query_id THEN 'another query' WHEN NOT (list_has_all(whole, ids) AND NOT list_has_all(ids, whole)) THEN 'not a strict subset' END AS rule FROM j) SELECT * FROM k WHERE rule IS NOT NULL""",
    "leakage_components": """WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey // 2 AS q, CASE WHEN c_custkey % 10 = 0 THEN 'own-' || c_custkey ELSE 'p-' || ((c_custkey + 1) // 2) END AS p, CASE WHEN c_custkey % 50 = 5 THEN c_custkey // 100 END AS s FROM customer),
d AS (SELECT k, q, p, max(s) OVER (PARTITION BY p) AS s FROM c),
e AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM d a JOIN d b ON a.q = b.q UNION SELECT a.k, b.k FROM d a JOIN d b ON a.p = b.p UNION SELECT a.k, b.k FROM d a JOIN d b ON a.s = b.s),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT CAST(a AS VARCHAR) AS case_id, min(CAST(b AS VARCHAR)) AS component FROM r GROUP BY a""",
    "split_leak_check": """WITH a AS (SELECT c_custkey % 3 = 0 AS t, n_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT CAST(n_regionkey AS VARCHAR) AS id, 'component crosses splits' AS rule FROM a GROUP BY n_regionkey HAVING count(DISTINCT t) > 1
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'query_id crosses splits' FROM a GROUP BY n_nationkey HAVING count(DISTINCT t) > 1""",
    "benchmark_contract": f"""WITH {_GOLD}, n AS (SELECT item_id AS query_id, count(g.passage_id) AS n, count(*) FILTER (grade = 2) AS direct FROM benchmark LEFT JOIN g ON g.query_id = item_id GROUP BY item_id)
SELECT query_id, CASE WHEN query_id % 2 = 0 AND n = 0 THEN 'no judgment' WHEN query_id % 2 = 0 AND direct = 0 THEN 'no direct evidence' ELSE 'abstention with judgments' END AS rule FROM n WHERE (query_id % 2 = 0 AND direct = 0) OR (query_id % 2 = 1 AND n > 0)
UNION ALL SELECT g.query_id, 'outside the scope' FROM g JOIN documents d ON d.doc_id = g.passage_id WHERE d.source NOT IN ({', '.join(f"'src{i}'" for i in range(15))})""",
    "inventory_antijoin": rf"""WITH {_LINES}, d AS (SELECT document_id AS query_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS q FROM l),
b AS (SELECT DISTINCT trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '\s+', ' ', 'g')) AS q FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark) WHERE trim(x) <> '')
SELECT query_id, 'question in development' AS rule FROM d SEMI JOIN b USING (q)""",
    "manifest_urls": f"""WITH m AS (SELECT page_id, {_HOSTED} AS url, 'p' || page_id || CASE WHEN page_id % 10 = 0 THEN '.txt' ELSE '.pdf' END AS filename, {_DATED} AS verified_date FROM pages)
SELECT CAST(page_id AS VARCHAR) AS document_id, rule FROM (SELECT page_id, unnest(list_filter([{_URL}, CASE WHEN page_id % 13 = 0 THEN 'date' END, CASE WHEN page_id % 10 = 0 THEN 'filename' END], lambda x: x IS NOT NULL)) AS rule FROM m)
UNION ALL SELECT CAST(min(page_id) AS VARCHAR), 'download_url repeated' FROM m GROUP BY url HAVING count(*) > 1""",
    "url_domain_check": f"SELECT host, rule, count(*) AS pages FROM (SELECT {_HOST} AS host, {_URL} AS rule FROM pages) GROUP BY ALL",
    "round_assignment": """SELECT annotator_id, row_number() OVER (PARTITION BY annotator_id ORDER BY sha256('round:' || annotator_id || ':' || doc_id), doc_id) AS position, doc_id AS case_id FROM labels CROSS JOIN (SELECT unnest(['ann-a', 'ann-b']) AS annotator_id)""",
    "label_contract": f"WITH {_RATERS} SELECT case_id, CASE WHEN a THEN 'codes of sufficient evidence' ELSE 'no codes' END AS rule FROM r WHERE (a AND len(x) > 0) OR (NOT a AND len(x) = 0)",
    "sha256_binding": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "question_words": rf"SELECT item_id AS query_id, len({_content('text')}) AS content_tokens, len({_tokens('text')}) AS word_tokens, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS normalized_md5 FROM benchmark",
}

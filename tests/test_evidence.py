import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import artifacts as R
from tessera.operators import governance as G
from tessera.operators import service
from tessera.operators import sufficiency as S
from tessera.plans import adapters, evidence


def test_features_by_hand(rows):
    df = rows([("Which risk controls apply?", ["Risk controls must apply.", "Other text"], ["Risk list"])], "q string, t array<string>, l array<string>")
    got = df.select(*S.features(F.col("q"), F.col("t"), F.col("l")).values()).first()
    assert got[0] == 2.0 and got[1] == pytest.approx(math.log1p(6)) and got[2] == pytest.approx(1.0) and got[3] == pytest.approx(1 / 3) and got[4] == pytest.approx(5 / 6)


def test_fit_follows_the_written_descent(rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=30) > 0).astype(int)
    m = S.fit(rows([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, target int"), ("a", "b"), iterations=50)
    z = (x - x.mean(0)) / x.std(0)
    w, b = [0.0, 0.0], math.log(y.mean() / (1 - y.mean()))
    for _ in range(50):
        e = [1 / (1 + math.exp(-(b + w[0] * r[0] + w[1] * r[1]))) - t for r, t in zip(z, y, strict=True)]
        b -= 0.05 * sum(e) / 30
        w = [w[j] - 0.05 * (sum(v * r[j] for v, r in zip(e, z, strict=True)) / 30 + 0.01 * w[j]) for j in range(2)]
    assert m.coefficients == pytest.approx(w) and m.intercept == pytest.approx(b)
    with pytest.raises(ValueError):
        S.fit(rows([(1.0, 1)], "a double, target int"), ("a",))


def test_rounding_to_twelve_digits_is_that_of_the_binary_value(rows):
    rng = np.random.default_rng(9)
    values = [*rng.normal(size=2000), *(rng.random(500) * 9000), *[(int(k) + 0.5) / 1e12 for k in rng.integers(0, 10**12, 3000)], 0.0, -0.5e-12, 1.5e-12, 2.5e-12, 0.1234567890125, 0.1234567890135, 8191.5, 1e300, -9007.5, 4096.123456789012]
    got = rows([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").select("v", T.round12(F.col("v")).alias("r")).collect()
    assert got[-2]["r"] is None and math.isnan(got[-1]["r"])
    assert [(r["v"], r["r"]) for r in got[:-2] if r["r"] != round(r["v"], 12)] == []


def test_newton_reaches_the_optimum_of_the_written_descent(rows, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2)) * [3.0, 0.01] + [100.0, 5.0]
    y = (x[:, 0] - 100 + 2 * rng.normal(size=80) > 0).astype(int)
    df = rows([(*map(float, r), 1.0, int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, target int")  # c is constant
    names = ("a", "b", "c")
    m, far = S.fit_newton(df.repartition(4), names), S.fit(df, names, iterations=40_000)
    assert m.coefficients == pytest.approx(far.coefficients, abs=1e-6) and m.intercept == pytest.approx(far.intercept, abs=1e-6)
    assert m.means == pytest.approx(far.means) and m.scales == pytest.approx(far.scales)
    with pytest.raises(ValueError):
        S.fit_newton(df.where("target = 1"), names)
    near = S.fit(df, names, iterations=4)
    monkeypatch.setattr(S, "MAX_LOCAL_ROWS", 10)  # each step a pass over all rows
    again = S.fit(df, names, iterations=4)
    assert again.coefficients == pytest.approx(near.coefficients) and again.intercept == pytest.approx(near.intercept)


def test_components_of_chains_hubs_and_loops(rows, monkeypatch):
    from tessera.functions import sizes

    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"x{i}") for i in range(300)] + [("alone", "alone"), ("p", "q"), ("q", "p")]
    want = {f"c{i:03d}": "c000" for i in range(71)} | {f"x{i}": "hub" for i in range(300)} | {"hub": "hub", "alone": "alone", "p": "p", "q": "p"}
    df = rows(edges, "a string, b string")
    assert {r["node"]: r["component"] for r in G.components(df).collect()} == want
    monkeypatch.setattr(sizes, "small", lambda *_: False)  # hubs apart from the rest
    assert {r["node"]: r["component"] for r in G.components(df).collect()} == want


def test_a_chain_takes_a_logarithm_of_rounds(rows, monkeypatch):
    cut, written = G.cut, []
    monkeypatch.setattr(G, "cut", lambda df: written.append(1) or cut(df))
    out = G.components(rows([(i, i + 1) for i in range(120)], "a long, b long"))
    assert {r["component"] for r in out.collect()} == {0}
    assert len(written) <= 3 * 15 + 2  # tables of 15 rounds


def test_nothing_but_bounded_tables_is_broadcast(spark, monkeypatch):
    from tessera.functions import sizes

    left, right = spark.range(2000).withColumnRenamed("id", "k"), spark.range(1500).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    monkeypatch.setattr(sizes, "small", lambda *_: False)
    for counts in (None, left.groupBy("k").agg(F.count("*").alias("_n"))):
        out = sizes.look_up(left, right, "k", counts=counts)
        assert {tuple(r) for r in out.collect()} == {(i, i + 1 if i < 1500 else None) for i in range(2000)}
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_links_no_components(rows):
    assert G.components(rows([], "a long, b long")).collect() == []
    assert [tuple(r) for r in G.components(rows([(1, None), (None, 2), (3, 3)], "a long, b long")).collect()] == [(3, 3)]


def test_threshold_against_brute_force(rows):
    rng = np.random.default_rng(2)
    p, t = np.round(rng.random(40), 2), rng.integers(0, 2, 40)
    got = S.best_threshold(S.thresholds(rows([(float(a), int(b)) for a, b in zip(p, t, strict=True)], "probability double, target int"))).first()
    u = sorted(set(p.tolist()))
    best = None
    for c in sorted({0.0, 0.5, 1.0, *u, *[(a + b) / 2 for a, b in zip(u, u[1:], strict=False)]}):
        tp, fp = int(((p >= c) & (t == 1)).sum()), int(((p >= c) & (t == 0)).sum())
        pos, neg = int(t.sum()), int((1 - t).sum())
        r, s, q = tp / pos, (neg - fp) / neg, tp / (tp + fp) if tp + fp else 0.0
        key = (round((r + s) / 2, 12), round(2 * q * r / (q + r), 12) if q + r else 0.0, -abs(c - 0.5), c)
        best = max(best, key) if best else key
    assert (got["threshold"], got["balanced_accuracy"]) == pytest.approx((best[3], best[0]))


def test_metrics_and_standardisation(rows):
    df = rows([(1, 1), (1, 0), (0, 0), (0, 0)], "target int, prediction int")
    m = S.metrics(df).first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["accuracy"], m["recall"]) == (1, 2, 0, 1, 0.75, 0.5)
    flat = S.standardize(rows([(1.0,), (1.0,)], "a double"), S.standardization(rows([(1.0,), (1.0,)], "a double"), ("a",)), ("a",)).collect()
    assert [r[0] for r in flat] == [0.0, 0.0]


@pytest.mark.parametrize("intercept,action", [(10.0, "answer"), (-10.0, "abstain")])
def test_service_decides(rows, intercept, action):
    model = S.Model((0.0,) * 5, intercept, (0.0,) * 5, (1.0,) * 5)
    long = "risk controls " * 12
    passages = rows([(1, long, long, "A", "heading_body", "k"), (2, long + "x", long + "x", "A", "heading_body", "k"), (3, "risk", "risk", "B", "heading_body", "z")], "passage_id long, text string, citation_text string, label string, unit_kind string, logical_source_key string")
    out = {r["query_id"]: r for r in service.answer(passages, rows([(1, " risk "), (2, "nothing")], "query_id long, text string"), model).collect()}
    assert out[1]["action"] == action and out[1]["selected_passage_count"] == 2
    assert out[2]["reason"] == "no_positive_lexical_match" and out[2]["probability_sufficient"] == 0.0
    if action == "answer":
        assert out[1]["answer"].startswith("[1] risk controls") and "\n\n[2] " in out[1]["answer"]
    with pytest.raises(ValueError):
        service.answer(passages, passages, model, 11)


def test_model_is_checked():
    with pytest.raises(ValueError):
        S.Model((1.0,), 0.0, (0.0,), (0.0,))


def test_silver_rule(rows):
    df = rows([("a", ["incomplete_evidence_set", "strict_subset_of_complete_evidence"], "b"), ("b", ["one_complete_passage"], None), ("c", ["x"], None), ("d", ["incomplete_evidence_set"], "b")], "case_id string, evidence_structure_codes array<string>, complete_reference_case_id string")
    assert [r[0] for r in df.orderBy("case_id").select(S.silver_label(F.col("evidence_structure_codes"))).collect()] == ["insufficient", "sufficient", None, "insufficient"]
    assert {(r[0], r[1]) for r in S.silver_violations(df).collect()} == {("c", "no complete structure"), ("d", "not a strict subset")}


def test_agreement(rows):
    df = rows([(1, "sufficient", "sufficient", [], []), (2, "insufficient", "sufficient", ["x"], []), (3, "insufficient", "insufficient", ["x", "y"], ["y", "x"]), (4, "insufficient", "insufficient", ["x"], ["y"])], "case_id int, first_status string, second_status string, first_codes array<string>, second_codes array<string>")
    k = G.kappa(df).first()
    assert k["agreement"] == 0.75 and k["kappa"] == pytest.approx(0.5)
    assert G.kappa(df.where("case_id = 1")).first()["kappa"] is None
    c = G.code_agreement(df).first()
    assert (c["mean_jaccard"], c["exact_match_rate"]) == (0.5, 0.5)
    s = {r["code"]: (r["tp"], r["fp"], r["fn"]) for r in G.code_scores(df).collect()}
    assert s == {"x": (1, 0, 2), "y": (1, 1, 0)}
    assert G.macro(G.code_scores(df.where("case_id = 1"))).first()[0] is None
    assert {r["case_id"] for r in G.adjudication_needed(df.withColumn("first_uncertain", F.col("case_id") == 1).withColumn("second_uncertain", F.lit(False))).collect()} == {1, 2, 4}


def test_components_do_not_depend_on_order(rows):
    cases = [("c1", "q1", ["p1"]), ("c2", "q1", ["p2"]), ("c3", "q3", ["p2"]), ("c4", "q4", ["p4"]), ("c5", "q5", ["p5"]), ("c6", "q6", ["p6"])]
    passages = rows([("p1", "s1"), ("p2", "s2"), ("p4", "s4"), ("p5", "s4"), ("p6", None)], "passage_id string, logical_source_key string")
    want = {"c1": "c1", "c2": "c1", "c3": "c1", "c4": "c4", "c5": "c4", "c6": "c6"}
    for data in (cases, cases[::-1]):
        out = G.case_components(rows(data, "case_id string, query_id string, evidence_passage_ids array<string>"), passages)
        assert {r[0]: r[1] for r in out.collect()} == want
    chain = rows([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["component"] for r in G.components(chain).collect()} == {0}


def test_splits(rows):
    groups = rows([("d", f"q{i}", 2, i % 2) for i in range(10)], "document_id string, query_id string, case_count long, insufficient_count long")
    out = G.grouped_splits(groups)
    assert {k: n for k, n in out.groupBy("split_name").count().collect()} == {"train": 6, "validation": 2, "test": 2}
    bad = rows([("a", "k", "q", "train"), ("b", "k", "q2", "test")], "case_id string, component string, query_id string, split_name string")
    assert [r["rule"] for r in G.split_violations(bad).collect()] == ["component crosses splits"]


def test_contracts(rows):
    asked = rows([(1, "answer", ["d"]), (2, "abstain", ["d"]), (3, "answer", ["d"])], "query_id long, expected_behavior string, document_scope array<string>")
    judged = rows([(1, "p", 2), (2, "p", 1), (3, "zz", 3)], "query_id long, passage_id string, relevance_grade int")
    found = {(r[0], r[1]) for r in G.benchmark_violations(asked, judged, rows([("p", "d")], "passage_id string, document_id string")).collect()}
    assert found == {(2, "abstention with judgments"), (3, "no direct evidence"), (3, "grade")}
    with pytest.raises(G.ContractViolation, match="abstention"):
        G.enforce(G.benchmark_violations(asked.where("query_id = 2"), judged.where("query_id = 2"), rows([("p", "d")], "passage_id string, document_id string")))
    urls = rows([("http://a.org/x.pdf",), ("https://b.org/x.pdf",), ("https://A.org/x.pdf",), ("nope",)], "u string")
    assert [r[0] for r in urls.select(G.url_rule(F.col("u"), ["a.org"])).collect()] == ["not https", "host", None, "not https"]
    manifest = rows([("a", "https://a.org/1", "1.pdf", "2024-02-30"), ("a", "https://a.org/2", "x/2.pdf", None)], "document_id string, download_url string, filename string, publication_date string")
    assert {r[1] for r in G.manifest_violations(manifest, ["a.org"]).collect()} == {"date", "filename", "document_id repeated"}
    times = rows([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+00:00",)], "t string")
    assert [r[0] for r in times.select(G.timestamp_rule(F.col("t"))).collect()] == [None, "timestamp"]
    labels = rows([("a", "sufficient", "answer", ["x"], []), ("b", "insufficient", "abstain", [], []), ("c", "insufficient", "abstain", ["x"], ["y"])], "case_id string, evidence_status string, response_action string, reason_codes array<string>, missing_information array<string>")
    assert {r[0] for r in G.label_violations(labels).collect()} == {"a", "b"}
    assert G.forbidden_fields(labels, {"reason_codes", "z"}) == ["reason_codes"]


def test_round_binding_and_receipt(rows, spark):
    cases = rows([(i,) for i in range(5)], "case_id long")
    given = G.round_assignments(cases, ["a", "b"], "c")
    assert G.assignment_violations(given, cases).isEmpty() and given.count() == 10
    assert G.assignment_violations(given.where("position < 5"), cases).count() == 2
    with pytest.raises(G.ContractViolation):
        G.round_assignments(cases, ["a", "a"], "c")
    one, two = G.binding(cases, ["case_id"]).first(), G.binding(cases.repartition(3), ["case_id"]).first()
    assert one == two and one != G.binding(cases.union(cases), ["case_id"]).first()
    template = R.record_template(given)
    done = template.withColumn("evidence_status", F.lit("sufficient"))
    assert {r["record_count"] for r in R.receipt(done, template).collect()} == {5}
    with pytest.raises(G.ContractViolation):
        R.receipt(done.where("case_id > 0"), template)
    assert R.round_record(cases, given, "1.0.0", "c").count() == 2


def test_result_record(rows):
    ranking = rows([(1, 10, 2.0, 1), (1, 11, 1.0, 2)], "query_id long, passage_id long, score double, rank int")
    gold = rows([(1, 10, 2)], "query_id long, passage_id long, grade int")
    r = R.result_record(ranking, gold, rows([(1,)], "query_id long"), "bm25", "1.0.0", {"gold": gold}).first()
    assert r["mean_recall_at_1"] == 1.0 and r["gold_rows"] == 1 and len(r["queries"]) == 1
    assert R.result_violations(ranking).isEmpty()
    assert {x["rule"] for x in R.result_violations(ranking.withColumn("score", F.lit(-1.0) * F.col("rank")), 0.0).collect()} == {"too low"}


def test_manifest_query_reports_repeated_urls(spark, rows, tmp_path):
    pages = [(3, "https://example.com/a", ""), (1, "https://example.com/b", ""), (7, "https://example.com/a", ""), (10, "http://example.com/c", "")]
    rows(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, evidence.manifest_urls(spark, str(tmp_path)).collect()))
    assert got == [("10", "filename"), ("10", "not https"), ("3", "download_url repeated")]


def test_thresholds_over_many_ranges(spark, rows):
    rng = np.random.default_rng(2)
    p, t = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    out = {r["threshold"]: r["balanced_accuracy"] for r in S.thresholds(rows([(float(a), int(b)) for a, b in zip(p, t, strict=True)], "probability double, target int")).collect()}
    values = np.unique(p)
    cuts = sorted({0.0, 0.5, 1.0, *values.tolist(), *((values[:-1] + values[1:]) / 2).tolist()})
    assert sorted(out) == cuts
    for c in cuts:
        hit = p >= c
        assert out[c] == pytest.approx(((hit & (t == 1)).sum() / (t == 1).sum() + (~hit & (t == 0)).sum() / (t == 0).sum()) / 2)


def test_needles_in_texts(rows):
    texts = rows([(1, "xx abc def"), (2, "abcabc"), (3, None), (4, "")], "passage_id long, text string")
    needles = rows([(7, "abc", 2), (8, "bc a", 1), (8, "c d", 2), (9, "", 1), (10, "abc", 1)], "query_id long, needle string, grade int")
    got = sorted(map(tuple, adapters.contained(texts, needles).collect()))
    assert got == sorted([(7, 1, 2), (8, 1, 2), (7, 2, 2), (10, 1, 1), (10, 2, 1), (9, 1, 1), (9, 2, 1), (9, 4, 1)])

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import best
from tessera.functions import text as T
from tessera.operators import dense, hybrid, lexical, metrics

PASSAGES = [(1, "red red blue"), (2, "red green"), (3, "green grey")]


def test_terms_fold_compatibility_forms(rows):
    df = rows([("Ａrticle don’t—stop x/y aıb 5ﬁ",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.lexical_terms(F.col("t"))).collect()]
    assert got == [["article", "don", "t", "stop", "x", "y", "aıb", "5fi"], None, []]


def test_bm25_by_hand(rows):
    out = lexical.rank(rows(PASSAGES, "passage_id long, text string"), rows([(7, "red blue red")], "query_id long, text string"), 3)
    got = [(r["passage_id"], r["rank"], r["score"]) for r in out.orderBy("rank").collect()]
    avg, idf = 7 / 3, lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    w = lambda tf, n: tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / avg))
    assert [x[:2] for x in got] == [(1, 1), (2, 2), (3, 3)]
    assert got[0][2] == pytest.approx(idf(2) * w(2, 3) + idf(1) * w(1, 3))
    assert got[1][2] == pytest.approx(idf(2) * w(1, 2))
    assert got[2][2] == 0.0


def test_bm25_without_a_match_is_in_corpus_order(rows):
    out = lexical.rank(rows(PASSAGES, "passage_id long, text string").repartition(3), rows([(7, "violet"), (8, "")], "query_id long, text string"), 2)
    assert sorted((r[0], r[1], r[3]) for r in out.collect()) == [(7, 1, 1), (7, 2, 2), (8, 1, 1), (8, 2, 2)]


@pytest.mark.parametrize("bad", [dict(k1=0), dict(b=1.5), dict(k1=True), dict(k1=math.inf)])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        lexical.Parameters(**bad)


def test_limit_is_checked(rows):
    with pytest.raises(ValueError):
        lexical.rank(rows(PASSAGES, "passage_id long, text string"), rows([(7, "a")], "query_id long, text string"), True)


def test_metrics_by_hand(rows):
    ranking = rows([(1, p, i + 1) for i, p in enumerate("xcab")], "query_id long, passage_id string, rank int")
    gold = rows([(1, "a", 2), (1, "b", 2), (1, "c", 1)], "query_id long, passage_id string, grade int")
    r = metrics.per_query(ranking, gold).first()
    ideal = 3 + 3 / math.log2(3) + 1 / math.log2(4)
    assert (r["recall_at_1"], r["reciprocal_rank"], r["direct_hit"]) == (0.0, 0.5, True)
    assert r["recall_at_3"] == pytest.approx(2 / 3)
    assert r["ndcg"] == pytest.approx((1 / math.log2(3) + 3 / math.log2(4) + 3 / math.log2(5)) / ideal)
    mean = metrics.means(metrics.per_query(ranking, gold), rows([(1,), (2,)], "query_id long")).first()
    assert (mean["answer_count"], mean["abstain_count"], mean["direct_hit_rate"]) == (1, 1, 1.0)


def test_metric_inputs_are_checked(rows):
    ranking = rows([(1, "a", 1), (1, "a", 3)], "query_id long, passage_id string, rank int")
    gold = rows([(1, "a", 0)], "query_id long, passage_id string, grade int")
    assert {r["rule"] for r in metrics.input_violations(ranking, gold).collect()} == {"ranked twice", "grade below 1", "ranks with gaps"}


def test_dense_top_k_equals_numpy(rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = rows([(i, v.tolist()) for i, v in enumerate(x)], "passage_id long, embedding array<double>")
    out = dense.rank(df.repartition(5), df.where("passage_id < 3").withColumnRenamed("passage_id", "query_id"), 4)
    for q in range(3):
        got = [r["passage_id"] for r in out.where(F.col("query_id") == q).orderBy("rank").collect()]
        assert got == np.argsort(-(x @ x[q]), kind="stable")[:4].tolist()


def test_dense_checks(rows):
    df = rows([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0])], "passage_id long, embedding array<double>")
    assert {(r[0], r[1]) for r in dense.violations(df).collect()} == {(2, "null"), (3, "not finite"), (4, "not of length 1")}
    unit = [r[0] for r in rows([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(dense.normalize(F.col("v"))).collect()]
    assert unit == [[0.6, 0.8], None]


def test_embedding_batches(rows):
    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    out = dense.embed(rows([("ab",), ("abcd",)], "t string").coalesce(1), "t", encoder, batch=1, prefix="xx").collect()
    assert [round(r["embedding"][0] / r["embedding"][1]) for r in out] == [4, 6]


def test_union_coverage_fusion_and_order(rows):
    one = rows([(1, 10, 1), (1, 11, 2)], "query_id long, passage_id long, rank int")
    two = rows([(1, 11, 1), (1, 12, 2)], "query_id long, passage_id long, rank int")
    u = hybrid.union(one, two, 2)
    assert {tuple(r) for r in u.collect()} == {(1, 10, 1, None), (1, 11, 2, 1), (1, 12, None, 2)}
    gold = rows([(1, 10, 2), (1, 12, 1), (1, 99, 1)], "query_id long, passage_id long, grade int")
    c = hybrid.coverage(u, gold).first()
    assert (c["candidate_count"], c["missed"], c["bm25_only"], c["dense_only"], c["direct_hit"]) == (3, 1, 1, 1, True)
    assert hybrid.fuse(u).orderBy("rank").first()["passage_id"] == 11
    r = hybrid.rerank(u, F.lit(1.0)).orderBy("reranker_rank").collect()
    assert [x["passage_id"] for x in r] == [10, 11, 12]
    assert hybrid.candidate_violations(u, rows([(10,), (11,)], "passage_id long")).first()["rule"] == "outside the corpus"


def test_dense_search_in_several_blocks_and_scans(rows, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 8)
    monkeypatch.setattr(dense, "SCAN_BLOCKS", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    df = rows([(i, v.tolist()) for i, v in enumerate(x)], "passage_id long, embedding array<double>").repartition(4)
    out = dense.rank(df, df.where("passage_id < 37").withColumnRenamed("passage_id", "query_id"), 5)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["passage_id"])
    assert got == {q: np.lexsort((np.arange(60), -np.round(x @ x[q], 12)))[:5].tolist() for q in range(37)}
    assert dense.rank(df, df.limit(0).withColumnRenamed("passage_id", "query_id")).count() == 0


def test_the_best_of_a_task_are_all_that_leave_it():
    rng = np.random.default_rng(5)
    scores = np.round(rng.random((7, 900)), 2)  # many ties
    found, ids = best.Best(7, 5, 10, 0.0), rng.permutation(900)
    found.most = 200
    for lo in range(0, 900, 50):
        found.add(scores[:, lo : lo + 50], ids[lo : lo + 50])
    query, got, value = found.rows()
    for q in range(7):
        order = np.lexsort((ids, -scores[q]))[:5]
        assert got[query == q].tolist() == ids[order].tolist() and value[query == q].tolist() == scores[q, order].tolist()


def test_bm25_in_several_scans_of_questions(rows, monkeypatch):
    monkeypatch.setattr(lexical, "SCAN_QUESTIONS", 2)
    words = ["red", "blue", "green", "grey", "pink"]
    asked = rows([(i, " ".join(words[i % 5 :])) for i in range(5)] + [(9, "none")], "query_id long, text string")
    data = [(str(i), " ".join(words[(i * j) % 5] for j in range(1, 2 + i % 4))) for i in range(60)]
    got = lexical.rank(rows(data, "passage_id string, text string").repartition(3), asked, 4)
    avg = sum(len(t.split()) for _, t in data) / 60
    df = {w: sum(w in t.split() for _, t in data) for w in words}
    for q in range(5):
        score = lambda t: sum(math.log(1 + (60 - df[w] + 0.5) / (df[w] + 0.5)) * t.split().count(w) * 2.2 / (t.split().count(w) + 1.2 * (0.25 + 0.75 * len(t.split()) / avg)) for w in words[q:])  # noqa: B023, E731
        want = sorted(data, key=lambda x: (-round(score(x[1]), 10), x[0]))[:4]
        assert [r["passage_id"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == [x[0] for x in want]
    assert got.count() == 24


def test_vectors_leave_a_task_once(rows, spark):
    data = rows([(i, [float(i % 7), float(i % 11)]) for i in range(60)] + [(60, [float("nan"), 0.0])], "passage_id long, embedding array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        left = dense._scan(data, np.array([1, 2]), np.array([[1.0, 0.0], [0.0, 1.0]]), 3, "embedding").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["passage_id"] for r in left if r["query_id"] == 1) == [6, 13, 60] and len(left) == 6

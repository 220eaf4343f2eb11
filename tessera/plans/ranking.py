"""Queries of ranking and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, dense_index, hybrid, lexical, metrics
from . import adapters as A

K, DEPTH = 10, 20


def lexical_terms(spark, sf):
    terms = T.lexical_terms(F.col("text"))
    rows = A.passages(spark, sf).select("passage_id", terms.alias("t"))
    return rows.select("passage_id", F.size("t").cast("long").alias("term_count"), F.size(T.unique_terms(F.col("t"))).cast("long").alias("unique_count"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


def bm25_index_stats(spark, sf):
    termed = lexical.with_terms(A.passages(spark, sf))
    found = lexical.postings(termed.select("passage_id", "terms", "length"))
    df = found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
    out = df.crossJoin(F.broadcast(lexical.corpus_stats(termed)))
    return out.select("term", "df", "total_tf", F.round(lexical.idf(F.col("n"), F.col("df")), 9).alias("idf"), F.round("avg_length", 9).alias("avg_length"))


def _bm25(spark, sf, k):
    return A.corpus_index(spark, sf).search(A.questions(spark, sf), k)


def bm25_topk(spark, sf):
    """All texts are read; the other queries probe a stored index, which gives the same."""
    return lexical.rank(A.passages(spark, sf), A.questions(spark, sf), K).withColumn("score", F.round("score", 9))


def bm25_index_build(spark, sf):
    """A stored index in two segments, the second an increment, as its terms see the whole corpus."""
    index, state = A.index_in_segments(spark, sf)
    return index.term_stats(state).select("term", "df", "total_tf", F.lit(state.passages).alias("passages"), F.round(F.lit(state.average_length), 9).alias("avg_length"))


def bm25_indexed_topk(spark, sf):
    """What ``bm25_topk`` gives, from a stored index of two segments whose blocks are skipped where bounds allow."""
    index, _ = A.index_in_segments(spark, sf)
    return index.search(A.questions(spark, sf), K).withColumn("score", F.round("score", 9))


def bm25_zero_score_order(spark, sf):
    asked = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", F.lit("qqq"), F.translate("n_name", " ", "")).alias("text"))
    return lexical.rank(A.passages(spark, sf), asked, K).withColumn("score", F.round("score", 9))


def dense_topk(spark, sf):
    rows = A.vectors(spark, sf)
    return dense.rank(rows, rows.where("passage_id % 50 = 0").withColumnRenamed("passage_id", "query_id"), K).withColumn("score", F.round("score", 6))


def _unit_vectors(spark, sf):
    unit = dense.normalize(F.col("embedding"))
    return A.vectors(spark, sf).select("passage_id", unit.alias("embedding")).where("embedding IS NOT NULL")


def dense_indexed_topk(spark, sf):
    """Exact search over a stored index of two segments of unit vectors; blocks that bounds rule out aren't read."""
    rows = _unit_vectors(spark, sf)
    index = dense_index.build(rows.where("passage_id % 4 > 0"), 64)
    index.add(rows.where("passage_id % 4 = 0"))
    found, _ = index.search(rows.where("passage_id % 50 = 0").withColumnRenamed("passage_id", "query_id"), K)
    return found.withColumn("score", F.round("score", 6))


def dense_normalize(spark, sf):
    unit = dense.normalize(F.col("embedding"))
    rows = A.vectors(spark, sf).select("passage_id", "embedding", unit.alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return rows.select("passage_id", F.round(dense.norm(F.col("embedding")), 6).alias("norm"), F.round(total, 6).alias("unit_sum"), F.size("embedding").cast("long").alias("dimension"))


def _lists(spark, sf):
    return _bm25(spark, sf, DEPTH), dense.rank(A.vectors(spark, sf), A.question_vectors(spark, sf), DEPTH)


def hybrid_union(spark, sf):
    return hybrid.union(*_lists(spark, sf), DEPTH)


def hybrid_coverage(spark, sf):
    return hybrid.coverage(hybrid.union(*_lists(spark, sf), DEPTH), A.gold(spark, sf)).withColumn("candidate_recall", F.round("candidate_recall", 9))


def rrf_fusion(spark, sf):
    return hybrid.fuse(hybrid.union(*_lists(spark, sf), DEPTH)).withColumn("score", F.round("score", 9))


def rerank_candidates(spark, sf):
    """A surrogate scorer stands in for a cross-encoder: the share of the question's terms in the passage."""
    candidates = hybrid.union(*_lists(spark, sf), DEPTH)
    corpus = A.passages(spark, sf).select("passage_id", F.array_distinct(T.lexical_terms(F.col("text"))).alias("have"))
    asked = A.questions(spark, sf).select("query_id", F.array_distinct(T.lexical_terms(F.col("text"))).alias("want"))
    rows = candidates.join(corpus, "passage_id").join(asked, "query_id")
    score = F.round(F.size(F.array_intersect("want", "have")) / F.size("want"), 9)
    return hybrid.rerank(rows, score).select("query_id", "passage_id", "bm25_rank", "dense_rank", "reranker_score", "reranker_rank")


def _metrics(spark, sf):
    return metrics.per_query(_bm25(spark, sf, K), A.gold(spark, sf), K)


def recall_at_k(spark, sf):
    return _metrics(spark, sf).select("query_id", *[F.round(f"recall_at_{c}", 9).alias(f"recall_at_{c}") for c in metrics.CUTOFFS])


def mrr_at_10(spark, sf):
    return _metrics(spark, sf).select("query_id", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


def direct_hit(spark, sf):
    return _metrics(spark, sf).select("query_id", "direct_hit")


def ndcg_at_10(spark, sf):
    return _metrics(spark, sf).select("query_id", F.round("ndcg", 9).alias("ndcg"))


def ranking_means(spark, sf):
    out = metrics.means(_metrics(spark, sf), A.questions(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("mean") or c.endswith("rate") else c for c in out.columns])


QUERIES = {
    f.__name__: f
    for f in (
        lexical_terms, bm25_index_stats, bm25_topk, bm25_index_build, bm25_indexed_topk, bm25_zero_score_order, dense_topk, dense_indexed_topk, dense_normalize, hybrid_union, hybrid_coverage,
        rrf_fusion, rerank_candidates, recall_at_k, mrr_at_10, direct_hit, ndcg_at_10, ranking_means,
    )
}

TERMS = "regexp_extract_all(lower(text), '[a-z0-9ı]+')"
_P = f"p AS (SELECT doc_id AS passage_id, {TERMS} AS terms FROM documents), st AS (SELECT count(*) AS n, avg(len(terms)) AS avg_length FROM p)"


def _rank_sql(k: int, questions: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""{_P},
q AS (SELECT query_id, unnest(list_distinct({TERMS})) AS term FROM ({questions})),
post AS (SELECT passage_id, len(terms) AS length, unnest(terms) AS term FROM p),
tf AS (SELECT term, passage_id, length, count(*) AS tf FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q.query_id, tf.passage_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avg_length))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
f AS (SELECT x.query_id, p.passage_id, coalesce(s.score, 0) AS score FROM (SELECT query_id FROM ({questions})) x CROSS JOIN p LEFT JOIN s ON s.query_id = x.query_id AND s.passage_id = p.passage_id),
bm AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, passage_id) AS rank FROM f QUALIFY rank <= {k})"""


_GOLD = """g AS (SELECT item_id AS query_id, doc_id AS passage_id, CASE WHEN contains(d.text, b.text) THEN 2 ELSE 1 END AS grade FROM documents d JOIN benchmark b
  ON contains(d.text, b.text) OR (length(split_part(b.text, '.', 1)) > 20 AND contains(d.text, split_part(b.text, '.', 1))))"""
_DOT = "list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_DENSE = f"""de AS (SELECT b.item_id AS query_id, e.vec_id AS passage_id, {_DOT.format('x.embedding', 'e.embedding')} AS score,
  row_number() OVER (PARTITION BY b.item_id ORDER BY round({_DOT.format('x.embedding', 'e.embedding')}, 12) DESC, e.vec_id) AS rank
  FROM benchmark b JOIN embeddings x ON x.vec_id = b.item_id CROSS JOIN embeddings e QUALIFY rank <= {DEPTH})"""
_UNION = """u AS (SELECT coalesce(bm.query_id, de.query_id) AS query_id, coalesce(bm.passage_id, de.passage_id) AS passage_id, bm.rank AS bm25_rank, de.rank AS dense_rank
  FROM bm FULL JOIN de ON bm.query_id = de.query_id AND bm.passage_id = de.passage_id)"""
_HYBRID = f"{_rank_sql(DEPTH)}, {_DENSE}, {_UNION}"
_METRICS = f"""{_rank_sql(K)}, {_GOLD},
j AS (SELECT g.*, bm.rank, row_number() OVER (PARTITION BY g.query_id ORDER BY grade DESC, g.passage_id) AS ideal FROM g LEFT JOIN bm ON bm.query_id = g.query_id AND bm.passage_id = g.passage_id),
m AS (SELECT query_id, {', '.join(f'CAST(count(*) FILTER (rank <= {c}) AS DOUBLE) / count(*) AS recall_at_{c}' for c in metrics.CUTOFFS)},
  coalesce(1.0 / min(rank), 0) AS reciprocal_rank, coalesce(bool_or(rank <= 10 AND grade = 2), false) AS direct_hit,
  coalesce(sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END), 0) / sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) END) AS ndcg FROM j GROUP BY query_id)"""
_R = ", ".join(f"round(recall_at_{c}, 9) AS recall_at_{c}" for c in metrics.CUTOFFS)
_MEAN = ", ".join(f"round(avg({c}), 9) AS mean_{c}" for c in (*[f"recall_at_{c}" for c in metrics.CUTOFFS], "reciprocal_rank", "ndcg"))

ORACLE = {
    "lexical_terms": f"SELECT doc_id AS passage_id, len({TERMS}) AS term_count, len(list_distinct({TERMS})) AS unique_count, md5(array_to_string({TERMS}, ' ')) AS terms_md5 FROM documents",
    "bm25_index_stats": f"WITH {_P}, tf AS (SELECT term, passage_id, count(*) AS tf FROM (SELECT passage_id, unnest(terms) AS term FROM p) GROUP BY ALL) "
    "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf, round(any_value(avg_length), 9) AS avg_length FROM tf CROSS JOIN st GROUP BY term",
    "bm25_topk": f"WITH {_rank_sql(K)} SELECT query_id, passage_id, round(score, 9) AS score, rank FROM bm",
    "bm25_index_build": f"WITH {_P}, tf AS (SELECT term, passage_id, count(*) AS tf FROM (SELECT passage_id, unnest(terms) AS term FROM p) GROUP BY ALL) "
    "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf, any_value(n) AS passages, round(any_value(avg_length), 9) AS avg_length FROM tf CROSS JOIN st GROUP BY term",
    "bm25_indexed_topk": f"WITH {_rank_sql(K)} SELECT query_id, passage_id, round(score, 9) AS score, rank FROM bm",
    "bm25_zero_score_order": f"""WITH {_rank_sql(K, "SELECT n_nationkey AS query_id, 'qqq ' || replace(n_name, ' ', '') AS text FROM nation")} SELECT query_id, passage_id, round(score, 9) AS score, rank FROM bm""",
    "dense_topk": f"""SELECT q.vec_id AS query_id, e.vec_id AS passage_id, round({_DOT.format('q.embedding', 'e.embedding')}, 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format('q.embedding', 'e.embedding')}, 12) DESC, e.vec_id) AS rank
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= {K}""",
    "dense_indexed_topk": f"""WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt({_DOT.format('embedding', 'embedding')})) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, u.vec_id AS passage_id, list_inner_product(q.e, u.e) AS score FROM u q CROSS JOIN u WHERE q.vec_id % 50 = 0)
SELECT query_id, passage_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, passage_id) AS rank FROM s QUALIFY rank <= {K}""",
    "dense_normalize": f"SELECT vec_id AS passage_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) AS norm, round(list_sum(CAST(embedding AS DOUBLE[])) / sqrt({_DOT.format('embedding', 'embedding')}), 6) AS unit_sum, len(embedding) AS dimension FROM embeddings",
    "hybrid_union": f"WITH {_HYBRID} SELECT * FROM u",
    "hybrid_coverage": f"""WITH {_HYBRID}, {_GOLD}, n AS (SELECT query_id, count(*) AS candidate_count FROM u GROUP BY query_id)
SELECT g.query_id, round(CAST(count(u.passage_id) AS DOUBLE) / count(*), 9) AS candidate_recall, bool_or(u.passage_id IS NOT NULL AND grade = 2) AS direct_hit, count(*) FILTER (u.passage_id IS NULL) AS missed,
  count(*) FILTER (bm25_rank IS NOT NULL AND dense_rank IS NULL) AS bm25_only, count(*) FILTER (bm25_rank IS NULL AND dense_rank IS NOT NULL) AS dense_only, coalesce(any_value(candidate_count), 0) AS candidate_count
FROM g LEFT JOIN u ON u.query_id = g.query_id AND u.passage_id = g.passage_id LEFT JOIN n ON n.query_id = g.query_id GROUP BY g.query_id""",
    "rrf_fusion": f"WITH {_HYBRID}, z AS (SELECT query_id, passage_id, coalesce(1.0 / (60 + bm25_rank), 0.0::DOUBLE) + coalesce(1.0 / (60 + dense_rank), 0.0::DOUBLE) AS s FROM u) SELECT query_id, passage_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, passage_id) AS rank FROM z",
    "rerank_candidates": f"""WITH {_HYBRID}, z AS (SELECT u.*, round(CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9ı]+')), p.terms)) AS DOUBLE) / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9ı]+'))), 9) AS reranker_score
  FROM u JOIN p USING (passage_id) JOIN benchmark b ON b.item_id = u.query_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, passage_id) AS reranker_rank FROM z""",
    "recall_at_k": f"WITH {_METRICS} SELECT query_id, {_R} FROM m",
    "mrr_at_10": f"WITH {_METRICS} SELECT query_id, round(reciprocal_rank, 9) AS reciprocal_rank FROM m",
    "direct_hit": f"WITH {_METRICS} SELECT query_id, direct_hit FROM m",
    "ndcg_at_10": f"WITH {_METRICS} SELECT query_id, round(ndcg, 9) AS ndcg FROM m",
    "ranking_means": f"WITH {_METRICS} SELECT {_MEAN}, round(avg(CAST(direct_hit AS DOUBLE)), 9) AS direct_hit_rate, count(m.query_id) AS answer_count, count(*) - count(m.query_id) AS abstain_count FROM benchmark b LEFT JOIN m ON m.query_id = b.item_id",
}

"""The stored BM25 index against ranking that reads all texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import checkpoints
from tessera.operators import dense, dense_index, lexical, lexical_index
from tessera.operators.governance import ContractViolation
from tessera.sources.sinks import OutputExists

SCHEMA = "passage_id long, text string"


def corpus(n=1500, seed=0):
    rng = random.Random(seed)
    common, rare = ["the", "of", "risk"], [f"w{i}" for i in range(400)]
    return [(i, " ".join(rng.choices(common, k=rng.randint(2, 30)) + rng.choices(rare, k=rng.randint(1, 12)))) for i in range(n)]


def rounded(df):
    return sorted((r["query_id"], r["rank"], r["passage_id"], round(r["score"], 9)) for r in df.collect())


ASKED = [(1, "the risk of w3 w4"), (2, "w7"), (3, "nothing known"), (4, "of the"), (5, "w1 w2 w3 w399 the"), (6, ""), (7, "W7 w7 ｗ7")]


@pytest.mark.parametrize("segments", [1, 3])
def test_search_equals_ranking_of_all_texts(rows, tmp_path, monkeypatch, segments):
    monkeypatch.setattr(lexical_index, "BLOCK_BITS", 5)
    data = corpus()
    asked = rows(ASKED, "query_id long, text string")
    index = lexical_index.Index.create(rows([], SCHEMA).sparkSession, str(tmp_path / "index"))
    for k in range(segments):  # segments of unlike lengths, so weights' bounds move
        index.add(rows([(i, t + " of" * (40 * k)) for i, t in data[k::segments]], SCHEMA).repartition(3))
    whole = rows([(i, t + " of" * (40 * k)) for k in range(segments) for i, t in data[k::segments]], SCHEMA)
    for size in (1, 10):
        assert rounded(index.search(asked, size)) == rounded(lexical.rank(whole, asked, size))
    assert index.state().version == segments and index.state().passages == len(data)
    stats = {r["term"]: (r["df"], r["total_tf"]) for r in index.term_stats().collect()}
    want = {r["term"]: (r["df"], r["tf"]) for r in lexical.postings(lexical.with_terms(whole)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).collect()}
    assert stats == want


def test_blocks_are_skipped_and_bounds_hold(rows, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_BITS", 4)
    monkeypatch.setattr(lexical_index, "LISTED_TERMS", 2)  # terms by a join
    index = lexical_index.build(rows(corpus(), SCHEMA).coalesce(1), str(tmp_path / "index"))
    asked = rows([(1, "the of risk w3 w4")], "query_id long, text string")
    blocks, terms = index.candidate_blocks(asked, 3)
    all_blocks = index.blocks().join(terms, "term").select("block").distinct().count()
    assert 0 < blocks.count() < 0.9 * all_blocks
    assert rounded(index.search(asked, 3)) == rounded(lexical.rank(rows(corpus(), SCHEMA), asked, 3))
    p, avg = index.state().parameters, index.state().average_length
    over = index.blocks().select("top", F.explode("postings").alias("p")).where(lexical.weight(F.col("p.tf"), F.col("p.length"), F.lit(avg), p) > F.col("top") + 1e-12)
    assert over.isEmpty()


def test_passages_are_checked(rows, tmp_path):
    spark = rows([], SCHEMA).sparkSession
    index = lexical_index.build(rows([(1, "a b"), (2, "c")], SCHEMA), str(tmp_path / "index"), lexical.Parameters(k1=0.9), normalize=False)
    for bad in ([(3, "x"), (3, "y")], [(None, "x")], [(3, None)], [(2, "again")]):
        with pytest.raises(ContractViolation):
            index.add(rows(bad, SCHEMA))
    assert index.state().version == 1 and index.state().parameters.k1 == 0.9 and not index.state().normalize
    assert index.add(rows([], SCHEMA)).version == 1
    with pytest.raises(OutputExists):
        lexical_index.Index.create(spark, str(tmp_path / "index"))
    before = index.state()
    index.add(rows([(3, "b c d")], SCHEMA))
    with pytest.raises(OutputExists):  # another writer was first
        index._publish(lexical_index.replace(before, version=before.version + 1))
    asked = rows([(1, "b")], "query_id long, text string")
    assert [r["passage_id"] for r in index.search(asked, 5, version=1).orderBy("rank").collect()] == [1, 2]
    assert [r["passage_id"] for r in index.search(asked, 5).orderBy("rank").collect()] == [1, 3, 2]
    with pytest.raises(ValueError):
        index.search(asked, 0)
    with pytest.raises(ValueError):
        lexical_index.Index.create(spark, str(tmp_path / "none")).search(asked)


def test_a_scope_leaves_no_table(spark, rows, tmp_path):
    import os

    index = lexical_index.build(rows(corpus(50), SCHEMA), str(tmp_path / "index"))
    asked = rows([(1, "w3 nothing")], "query_id long, text string")
    folder = checkpoints.folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with checkpoints.scope(spark):
        assert index.search(asked, 4).count() == 4
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before


VECTORS = "passage_id long, embedding array<double>"


def clustered(n=900, size=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, size))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are one vector
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vector_search_is_exact_and_skips_blocks(rows, tmp_path, monkeypatch):
    monkeypatch.setattr(dense_index, "BLOCK_ROWS", 32)
    x = clustered()
    df = rows([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(4)
    index = dense_index.build(df.where("passage_id % 3 > 0"), 8, str(tmp_path / "index"))
    index.add(df.where("passage_id % 3 = 0"))
    asked = rows([(i, (2 * x[i]).tolist()) for i in range(0, 900, 45)] + [(5000, None)], "query_id long, embedding array<double>")
    for k in (1, 10):
        found, read = index.search(asked, k)
        assert rounded(found) == rounded(dense.rank(df, asked, k))
    blocks = index.blocks()
    assert blocks.agg(F.sum("n")).first()[0] == 900 and blocks.agg(F.max("n")).first()[0] < 100
    per_query = [r["blocks_read"] for r in read.collect()]
    assert len(per_query) == 20 and sum(per_query) < 0.7 * 20 * blocks.count()


def test_indexed_vectors_are_checked(rows, tmp_path):
    index = dense_index.build(rows([(1, [1.0, 0.0]), (2, [0.0, 1.0])], VECTORS), 2, str(tmp_path / "index"))
    for bad in ([(3, [2.0, 0.0])], [(3, None)], [(3, [1.0])], [(3, [1.0, 0.0]), (3, [0.0, 1.0])], [(1, [1.0, 0.0])], [(3, [float("nan"), 0.0])]):
        with pytest.raises(ContractViolation):
            index.add(rows(bad, VECTORS))
    assert index.state().version == 1 and index.add(rows([], VECTORS)).version == 1
    found, _ = index.search(rows([], "query_id long, embedding array<double>"), 3)
    assert found.count() == 0
    found, _ = index.search(rows([(9, [0.6, 0.8])], "query_id long, embedding array<double>"), 5)
    assert [(r["passage_id"], round(r["score"], 9)) for r in found.orderBy("rank").collect()] == [(2, 0.8), (1, 0.6)]
    for size in (0, True, 1.5):
        with pytest.raises(ValueError):
            dense_index.Index.create(index.spark, str(tmp_path / "no"), size)


def test_a_block_stands_in_one_file(rows, tmp_path, monkeypatch):
    """It is put together where its texts are read, so building shuffles no postings."""
    monkeypatch.setattr(lexical_index, "BLOCK_BITS", 4)
    index = lexical_index.build(rows(corpus(200), SCHEMA).repartition(3), str(tmp_path / "index"))
    stored = rows([], SCHEMA).sparkSession.read.parquet(f"{index.state().segments[0].path}/blocks")
    files = stored.groupBy("block").agg(F.count_distinct("_metadata.file_path").alias("n"), F.count("*").alias("terms")).collect()
    assert len(files) >= 13 and {r["n"] for r in files} == {1} and min(r["terms"] for r in files) > 1
    assert index.blocks().where("term = ''").isEmpty()

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, minhash

SCHEMA = "doc_id long, text string"


def brute_sets(docs, width):
    out = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute_components(docs, width=2, percent=80):
    sets, up = brute_sets(docs, width), {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {d: (len(sets[d]), root(d)) for d, _ in docs}


def corpus(seed=0, copies=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, base = [], [rng.choices(words, k=40) for _ in range(12)]
    for b in base:
        for _ in range(copies):
            d = list(b)
            for _ in range(rng.randint(0, 5)):
                d[rng.randrange(len(d))] = rng.choice(words)
            docs.append(" ".join(d))
    docs += [" ".join(base[0])] * 20 + ["common line here now " + " ".join(rng.choices(words, k=3)) for _ in range(30)]
    docs += ["", " \t\n", "one", "ONE", "one two", "a b"]
    return [(i * 3, t) for i, t in enumerate(docs)] + [(10_001, None)]


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(rows, width):
    docs = corpus()
    out = minhash.near_duplicates(rows(docs, SCHEMA).repartition(6), width=width).collect()
    assert len(out) == len(docs)
    want = brute_components(docs, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in out)


def test_components_where_nothing_is_small(rows, monkeypatch):
    """Hot buckets apart from the others, as with tables too large to broadcast."""
    docs = corpus(3, 15)
    monkeypatch.setattr(common, "small", lambda *_: False)
    monkeypatch.setattr(common, "HOT_GROUPS", 20)
    out = minhash.near_duplicates(rows(docs, SCHEMA).repartition(4), width=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(docs, 2)


def test_components_where_buckets_are_parted(rows, monkeypatch):
    docs = corpus(3, 15)
    monkeypatch.setattr(common, "small", lambda *_: False)
    monkeypatch.setattr(common, "PART_ROWS", 3)
    out = minhash.near_duplicates(rows(docs, SCHEMA).repartition(4), width=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(docs, 2)


def test_hot_key_is_dealt_over_parts_and_read_once(spark, monkeypatch):
    """Rows of hot and other keys used to be told apart by a semi and an anti join over all rows."""
    monkeypatch.setattr(common, "small", lambda *_: False)
    monkeypatch.setattr(common, "PART_ROWS", 50)
    left = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    left = left.join(left.groupBy("k").agg(F.count("*").alias("size")), "k")
    right = left.select("k", "size").distinct().withColumn("p", F.explode(F.array(F.lit(1), F.lit(2))))
    out = common.join_parts(left, right, "k", "size")
    want = sorted((r["k"], r["id"], p) for r in left.collect() for p in (1, 2))
    assert sorted((r["k"], r["id"], r["p"]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    parts = left.withColumn("part", F.pmod(F.xxhash64("id", "size"), F.floor(F.col("size") / 50) + 1)).groupBy("k", "part").count()
    assert parts.agg(F.max("count")).first()[0] < 150


def test_near_dedup_edges(rows):
    assert minhash.near_duplicates(rows([], SCHEMA)).count() == 0
    long = " ".join(f"x{i}" for i in range(30_000))
    docs = rows([(1, long, "a"), (2, long + " y", "b"), (None, long, "c"), (2, long + " y", "d"), (3, "A  b", "e"), (4, "a b", "f")], "doc_id long, text string, n string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect() if r["doc_id"])
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 3, False)]
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["n"] for r in left.collect()) == ["a", "c", "e"]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (400, 50, 50))
    x, y = minhash.signature(np.concatenate([both, a]), 2000), minhash.signature(np.concatenate([both, b]), 2000)
    assert abs((x == y).mean() - 0.8) < 0.04


def test_merge_of_a_chain_and_a_star(rows):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in minhash.merge(rows(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_exact_dedup_equals_brute_force(rows):
    rng = random.Random(1)
    pool = ["", "a", "b", "a" * 300 + "x", "a" * 300 + "y", "é", "é", None]
    docs = [(i, rng.choice(pool)) for i in range(120)]
    for everything in (True, False):
        out = exact_dedup.refine(rows(docs, SCHEMA).repartition(5), all_digests=everything).collect()
        groups = {}
        for d, t in docs:
            groups.setdefault(t or "", []).append(d)
        for r in out:
            t = dict(docs)[r["doc_id"]] or ""
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[t]), len(groups[t]), r["doc_id"] == max(groups[t]))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest() or (not everything and len(groups[t]) == 1)


def test_exact_dedup_edges(rows):
    assert exact_dedup.refine(rows([], SCHEMA)).count() == 0
    docs = rows([(1, "x", 1), (2, "x", 2), (2, "x", 3), (2, "z", 4), (None, "x", 5), (None, None, 6), (7, "", 7)], "doc_id long, text string, size int")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    got = sorted(r["size"] for r in left.collect())
    assert len(got) == 3 and got[-2:] == [4, 7] and got[0] in (2, 3)


def test_no_task_holds_most_rows_without_broadcasts(spark, rows, monkeypatch):
    """Neither rows without copies nor those of one large group meet in a task, whatever is too large to broadcast."""
    monkeypatch.setattr(common, "small", lambda *_: False)
    docs = [(i, f"text {i} " + "x" * (i % 50)) for i in range(6000)] + [(10_000 + i, "one text") for i in range(3000)] + [(20_000 + i, f"pair {i // 2}") for i in range(1000)]
    a_file_a_task = common.setting(spark, "spark.sql.files.openCostInBytes", "128m")
    with a_file_a_task, common.setting(spark, "spark.sql.adaptive.enabled", "false"), common.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = common.materialize(exact_dedup.refine(rows(docs, SCHEMA).repartition(8)).withColumn("part", F.spark_partition_id()), "dedup-parts")
        sizes = [r["count"] for r in out.groupBy("part").count().collect()]
    assert max(sizes) < 0.2 * len(docs)
    groups = {r["keep_id"]: r["group_size"] for r in out.where("kept").collect()}
    assert groups[12_999] == 3000 and groups[20_999] == 2 and groups[5] == 1 and len(groups) == 6501
    assert out.where("kept").count() == 6501 and out.count() == len(docs)


def test_digests_of_unique_rows_are_not_made(rows):
    out = exact_dedup.refine(rows([(1, "a"), (2, "bb"), (3, "bb")], SCHEMA))
    assert out.where("text_sha256 IS NULL").select("doc_id").collect() == [(1,)]


def test_hash_sample_is_fixed(rows):
    df = rows([(i,) for i in range(5000)], "k long")
    a, b = (sorted(common.hash_sample(x, 300, "k").collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 300
    assert common.hash_sample(df.where(F.col("k") < 10), 300, "k").count() == 10

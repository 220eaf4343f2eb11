"""Nulls, empty and very long texts, repeated rows and clashing names through the operators that read whole texts."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import exact_dedup, lattice, minhash, mixing, packing, quality, toxicity, wavelet

#: Names that the operators use for columns of their own.
CLASH = ("id", "grade", "values", "columns", "hit", "level", "size", "hash", "row", "bucket", "comp", "n", "part", "seq", "payload", "piece", "length", "rank", "kept", "text_sha256", "score", "terms", "word", "count")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG_WORD = "zq" * 30_000
TEXTS = [
    (1, "plain words stand here", "s1"), (2, None, None), (3, "", "s1"), (4, " \t\n", "s2"), (5, LONG_WORD, "s2"), (6, " ".join(f"w{i % 997}" for i in range(60_000)), "s1"),
    (7, "same row", "s1"), (7, "same row", "s1"), (None, "no id here", "s3"), (None, None, None), (8, "İ ß é 日本 \x00 x", "s3"), (9, "plain words stand here", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", s, 0, *CLASH) for i, t, s in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bare(spark):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in TEXTS], "doc_id long, text string, lang string, source string").repartition(2).cache()


def key(rows):
    return sorted(rows, key=lambda r: str(tuple(r)))


def test_tokens_and_packing(spark, odd, bare, tmp_path):
    found = []
    for k, df in enumerate((odd, bare)):
        wavelet.write_shards(df, f"{tmp_path}/{k}")
        found.append(key(wavelet.document_digests(wavelet.read_shards(spark, f"{tmp_path}/{k}")).collect()))
    assert found[0] == found[1] and len(found[0]) == len(TEXTS)
    pieces = [key(packing.pack(df).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) for df in (odd, bare)]
    assert pieces[0] == pieces[1]
    whole = collections.Counter(r["doc_id"] for r in pieces[0] if r["piece"] == 0)
    assert whole == collections.Counter(i for i, _, _ in TEXTS)


def test_language_model(odd, bare):
    a, b = (key(lattice.lm_scores(df).collect()) for df in (odd, bare))
    assert len(a) == len(TEXTS) and [r["doc_id"] for r in a] == [r["doc_id"] for r in b]
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b]) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in a)


def test_classifiers_and_mixing(rows, odd, bare):
    labels = rows([(i, i % 2, i % 3 == 0) for i in range(1, 10)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic")
    graded = [key(quality.grade(df, quality.fit(df, labels)).collect()) for df in (odd, bare)]
    assert graded[0] == graded[1] and len(graded[0]) == len(TEXTS)
    kept = quality.keep_good(odd, quality.fit(odd, labels))
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in graded[0])
    scored = [key(toxicity.score(df, toxicity.fit(df, labels)).collect()) for df in (odd, bare)]
    assert scored[0] == scored[1] and len(scored[0]) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored[0])
    assert len({tuple(r) for r in scored[0] if r["doc_id"] == 7}) == 1
    mixed = [key(mixing.mix(df).collect()) for df in (odd, bare)]
    assert mixed[0] == mixed[1] and len(mixed[0]) == len(TEXTS) and all(r["taken"] <= 3 * r["size"] for r in mixed[0])


def test_every_stage_of_the_pipeline(rows, spark, odd, tmp_path):
    """Stages take nulls, repeats and other columns, keep the columns, and lose no text but copies and rejected rows."""
    rows([(i, 1, 0) for i in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == odd.columns, name
        have, had = ({r["text"] or "" for r in x.collect()} for x in (docs, before))
        assert have <= had, name
        if name in ("exact_dedup", "near_dedup"):
            assert have == had, name  # no two of these texts are near each other
    # one row for each text, null and empty being one
    once = exact_dedup.drop_copies(odd)
    assert once.count() == len({t or "" for _, t, _ in TEXTS}) and minhash.drop_near_duplicates(once).count() == once.count()
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert len([r for r in packed if r["piece"] == 0]) == docs.count()


def brute_tree(b, g, h, sizes, rows, depth):
    """The best split of some rows by trying all, and so on; leaves are values."""
    best = None
    if depth and len(rows) >= 2 * toxicity.MIN_LEAF:
        score = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + toxicity.L2)
        for j, size in enumerate(sizes):
            for cut in range(size - 1):
                left, right = [i for i in rows if b[i][j] <= cut], [i for i in rows if b[i][j] > cut]
                if min(len(left), len(right)) >= toxicity.MIN_LEAF:
                    gain = score(left) + score(right) - score(rows)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = gain, j, cut, left, right
    if best is None:
        return toxicity.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + toxicity.L2)
    _, j, cut, left, right = best
    return j, cut, brute_tree(b, g, h, sizes, left, depth - 1), brute_tree(b, g, h, sizes, right, depth - 1)


def test_a_tree_splits_where_all_splits_say(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 2)
    monkeypatch.setattr(toxicity, "BINS", 6)
    monkeypatch.setattr(toxicity, "MIN_LEAF", 5)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (rng.random(160) < 0.1)).astype(float)
    model = toxicity.Boosted({})
    model.fit_trees(x, y)
    b, sizes, total = model.bins(x).tolist(), [len(e) + 1 for e in model.edges], np.full(160, model.offset)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-total))
        want = brute_tree(b, (y - p).tolist(), (p * (1 - p)).tolist(), sizes, list(range(160)), toxicity.DEPTH)

        def same(k, node, tree=tree):
            split, cut, value = tree[k]
            if isinstance(node, tuple):
                assert (split, cut) == node[:2]
                same(2 * k + 1, node[2])
                same(2 * k + 2, node[3])
            else:
                assert split < 0 and value == pytest.approx(node, abs=1e-9)

        same(0, want)
        one = toxicity.Boosted({}, edges=model.edges, trees=[tree])
        total = total + one.raw(x)

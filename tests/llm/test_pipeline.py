import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import common, exact_dedup, minhash, mixing, quality, tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, folder = random.Random(7), tmp_path_factory.mktemp("sf")
    words, docs, labels = [f"w{i}" for i in range(500)], [], []
    for i in range(160):
        text = rng.choices(words, k=rng.randint(20, 60))
        if i % 8 == 0:
            text = [w + "%%%" for w in text]
        docs.append([i, " ".join(text), "en", f"s{i % 4}", 0])
        labels.append((i, 0 if i % 8 == 0 else 1, 0))
    docs += [[200 + i, docs[i + 1][1], "en", "s9", 0] for i in range(0, 40, 5)]
    docs += [[300 + i, docs[i + 1][1] + " tail", "en", None, 0] for i in range(2, 40, 5)]
    spark.createDataFrame([tuple(d) for d in docs], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_each_stage_works_on_what_was_kept(spark, sf):
    docs = common.table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    good = corpus_pipeline.keep_quality(spark, docs, sf)
    model = quality.fit(docs, common.table(spark, sf, "labels"))
    assert ids(good) == ids(quality.grade(docs, model).where("kept")) and not any(i % 8 == 0 for i in ids(good) if i < 160)
    assert {i for i in range(160) if i % 8} <= set(ids(good))
    exact = corpus_pipeline.drop_exact_copies(spark, good, sf)
    assert ids(exact) == ids(exact_dedup.refine(good).where("kept"))
    near = corpus_pipeline.drop_near_copies(spark, exact, sf)
    assert ids(near) == ids(minhash.near_duplicates(exact).where("kept"))
    mixed = corpus_pipeline.mix_sources(spark, near, sf)
    want = [r["doc_id"] for r in mixing.mix(near).collect() for _ in range(r["repeats"])]
    assert ids(mixed) == sorted(want)
    for df in (good, exact, near, mixed):
        assert df.columns == docs.columns


def test_run_packs_what_the_stages_leave(spark, sf):
    docs = common.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "test-stage")
    t = Tokenizer.from_file(tokens.vocabulary_path())
    total = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert int(out["length"].sum()) == total
    used = out.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and len(used) == int(np.ceil(total / 2048))


def test_stages_take_empty_tables(spark, sf):
    docs = common.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0

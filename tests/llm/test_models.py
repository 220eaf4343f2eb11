import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, lattice, mixing, quality, sharding, toxicity

SCHEMA = "doc_id long, text string"


def graded(n=240, seed=0):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        g = i % 3
        good = [rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(30)]
        bad = [w + "%%" for w in good[: (2 - g) * 12]]
        docs.append((i, " ".join(bad + good[len(bad) :])))
        labels.append((i, g))
    return docs, labels


def test_ordinal_model_orders_three_grades(rows):
    docs, labels = graded()
    df = rows(docs, SCHEMA)
    model = quality.fit(df, rows(labels[:180], "doc_id long, quality int"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = {r["doc_id"]: r for r in quality.grade(df, model).collect()}
    held = range(180, 240)
    means = [np.mean([out[i]["expected_grade"] for i in held if i % 3 == g]) for g in range(3)]
    assert means[0] + 0.5 < means[1] < means[2] - 0.5
    assert all(out[i]["kept"] == (i % 3 > 0) for i in held)
    assert quality.keep_good(df, model).count() == sum(r["kept"] for r in out.values())


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    rows_ = [(rng.integers(0, 50, 5).astype(np.int32), rng.random(5)) for _ in range(60)]
    y = np.array([float(r[0][0] > 20) + float(r[0][0] > 35) for r in rows_])
    m = quality.Ordinal.fit(np.full(60, 5), np.concatenate([c for c, _ in rows_]), np.concatenate([v for _, v in rows_]), y)
    value = np.array([(m.weights[c] * v).sum() for c, v in rows_])
    p = np.stack([np.concatenate([[1.0], m.above(v), [0.0]]) for v in value])
    likelihood = np.log((p[:, :-1] - p[:, 1:])[np.arange(60), y.astype(int)]).mean()
    assert likelihood > -0.7


def test_quality_edges(rows):
    df = rows([(1, None, 5), (2, "", 5), (2, "x", 5)], "doc_id long, text string, grade int")
    none = quality.fit(df, rows([], "doc_id long, quality int"))
    assert none is None and quality.grade(df, none).where("kept").count() == 3 and quality.keep_good(df, none).columns == df.columns
    one = quality.fit(df, rows([(1, 1), (2, None)], "doc_id long, quality int"))
    assert [r["expected_grade"] for r in quality.grade(df, one).collect()] == [1.0] * 3
    docs, labels = graded(60)
    model = quality.fit(rows(docs, SCHEMA), rows(labels, "doc_id long, quality int"))
    assert quality.grade(df, model).count() == 3 and quality.grade(df.limit(0), model).count() == 0


def toxic_corpus(n=1500, seed=0):
    rng, docs, labels = random.Random(seed), [], []
    words = [f"word{i}" for i in range(400)]
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["zorgon", "Zorgon,", "blarkish!", "idiot"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_the_held_out_fold(rows):
    docs, labels = toxic_corpus()
    df = rows(docs, SCHEMA)
    model = toxicity.fit(df, rows(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r["held_out"]} == set(held)
    right = np.mean([out[i]["predicted"] == labels[i][1] for i in held])
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in out.values())
    hidden = toxicity.score(rows([(1, "you are an 1d10t word1 word2"), (2, "word3 word4"), (3, None), (4, "")], SCHEMA), model).orderBy("doc_id").collect()
    assert hidden[0]["score"] > hidden[1]["score"] and hidden[2]["score"] == hidden[3]["score"]


def test_held_out_labels_change_nothing(rows):
    docs, labels = toxic_corpus(400)
    df = rows(docs, SCHEMA)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = (sorted(toxicity.score(df, toxicity.fit(df, rows(x, "doc_id long, toxic int"))).collect()) for x in (labels, flipped))
    assert a == b


def test_isotonic_calibration_and_no_labels(rows):
    m = toxicity.Boosted({})
    m.calibrate(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 0, 1, 1]))
    v = np.interp([1, 2, 3, 4, 5, 6], m.at, m.value)
    assert (np.diff(v) >= 0).all() and v[1] == pytest.approx(v[3])
    empty = toxicity.fit(rows([(1, "a")], SCHEMA), rows([], "doc_id long, toxic int"))
    assert toxicity.score(rows([(1, "a")], SCHEMA), empty).first()["score"] == pytest.approx(0.5)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, cap, total = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3 * sizes[s] for s in names}, sum(sizes.values())
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > cap[s]] if free else []
        if not over:
            return {s: fixed.get(s, rest * weight[s] / w if free else 0) for s in names}
        fixed |= {s: cap[s] for s in over}


def test_mixing_meets_targets(rows):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", "ä", "Z", None] + ["a"] * 5)) for i in range(900)] + [(2000, None, "empty"), (2001, "x", "tiny")]
    df = rows(docs, "doc_id long, text string, source string").repartition(7)
    out = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    want = brute_targets({s: sizes[s] for s in {d[2] for d in docs}})
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(2)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}
    repeated = Counter(r["doc_id"] for r in mixing.repeat_rows(df).collect())
    assert all(repeated[r["doc_id"]] * r["size"] == r["taken"] for r in out)


def test_mixing_edges(rows):
    schema = "doc_id long, text string, source string, size int"
    assert mixing.mix(rows([], schema)).count() == 0
    assert mixing.repeat_rows(rows([], schema)).count() == 0
    same = rows([(1, "a b", "s", 9)] * 4 + [(None, "", None, 9)], schema)
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(same).collect()} == {(1, 2), (None, 0)}
    assert mixing.repeat_rows(same).columns == same.columns


def brute_model(pieces, uses, lasts):
    """Probabilities of pieces and of stopping after each, in plain Python."""
    first = sum(u for p, u in zip(pieces, uses, strict=True) if p.startswith(lattice.START))
    later, mean = sum(uses) - first, sum(lasts) / sum(uses)
    share = {p: u / (first if p.startswith(lattice.START) else later) for p, u in zip(pieces, uses, strict=True)}
    stop = {p: (z + lattice.PRIOR_STOPS * mean) / (u + lattice.PRIOR_STOPS) for p, u, z in zip(pieces, uses, lasts, strict=True)}
    return share, stop


def log_add(terms):
    top = max(terms, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


def brute_arcs(word, model):
    share, stop = model
    text, longest = lattice.START + word, max(map(len, share))
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            p = text[i:j]
            if p in share:
                yield i, j, p, math.log(share[p]) + math.log(stop[p] if j == len(text) else 1 - stop[p])


def brute_lattice(word, model):
    arcs, ending = list(brute_arcs(word, model)), {}
    for i, j, _, x in arcs:
        ending.setdefault(j, []).append((i, x))
    alpha = [0.0]
    for j in range(1, len(word) + 2):
        alpha.append(log_add([alpha[i] + x for i, x in ending.get(j, ())]))
    return alpha[-1]


def brute_uses(word, model):
    """Expected uses of pieces, and of last pieces, by walking every segmentation."""
    uses, lasts, total = Counter(), Counter(), brute_lattice(word, model)
    arcs = {}
    for i, j, p, x in brute_arcs(word, model):
        arcs.setdefault(i, []).append((j, p, x))

    def walk(i, path, weight):
        if i == len(word) + 1:
            for p in path:
                uses[p] += math.exp(weight - total)
            lasts[path[-1]] += math.exp(weight - total)
        for j, p, x in arcs.get(i, ()):
            walk(j, [*path, p], weight + x)

    walk(0, [], 0.0)
    return uses, lasts


def test_lattice_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"\xffab", b"\xffa", b"bc", b"abc", b"cd"]
    rng = np.random.default_rng(0)
    uses = rng.random((len(pieces), 2))
    lasts = uses * rng.random((len(pieces), 2))
    m = lattice.Lattice(pieces, uses, lasts)
    words = [b"abc", b"abcd", b"a", "é".encode(), b"bcbcabc", b"abcbc"]
    models = [brute_model(pieces, uses[:, c], lasts[:, c]) for c in range(2)]
    got = m.scores([*words, b"x" * 50])
    assert got[:-1] == pytest.approx(np.array([[brute_lattice(w, x) for x in models] for w in words]))
    weights = rng.random((len(words), 3))
    found = m.expected(words, weights)
    for c in range(3):
        each = [brute_uses(w, models[0]) for w in words]
        assert found[:, c] == pytest.approx(np.array([sum(x * u[p] for x, (u, _) in zip(weights[:, c], each, strict=True)) for p in pieces]))
        assert found[:, 3 + c] == pytest.approx(np.array([sum(x * z[p] for x, (_, z) in zip(weights[:, c], each, strict=True)) for p in pieces]))


def brute_scores(docs, rounds):
    """log10 probabilities by the whole method, in plain Python."""
    learnt = [(t or "", c) for d, t, c in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    rows = Counter(c or "" for _, c in learnt)
    kinds = sorted(rows, key=lambda c: (-rows[c], c))
    counts = {c: Counter() for c in kinds}
    for t, c in learnt:
        counts[c or ""].update(t.encode().lower().split())
    both = sum(counts.values(), Counter())

    def facts(c, n):
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d, total = once / (once + 2 * twice) if once and twice else 0.5, max(1, sum(c.values()) + n)
        return d, total, d * len(c) / total if c else 1e-3

    pieces, logp = lattice.read_vocabulary(lattice.tokens.vocabulary_path(lattice.VOCABULARY))
    uses = np.exp(logp)
    lasts = uses * lattice.FIRST_STOP
    for turn in range(rounds):
        groups = [both] if turn < rounds - 1 else [counts[c] for c in kinds]
        model, fresh = brute_model(pieces, uses.tolist(), lasts.tolist()), []
        each = {w: brute_uses(w, model) for w in both}
        for g in groups:
            u, z = Counter(), Counter()
            for w in g:
                u.update(each[w][0])
                z.update(each[w][1])
            fresh.append((np.array([u[p] for p in pieces]) + lattice.SMOOTHING, np.array([z[p] for p in pieces]) + lattice.SMOOTHING * lattice.FIRST_STOP))
        uses, lasts = fresh[0]
    scale = lattice.PRIOR_PIECES / sum(u.sum() for u, _ in fresh)
    more = sum(u for u, _ in fresh) * scale, sum(z for _, z in fresh) * scale
    models = [brute_model(pieces, (u + more[0]).tolist(), (z + more[1]).tolist()) for u, z in fresh]
    pool, out = facts(both, len(learnt)), []
    for _, t, _ in docs:
        terms = []
        for c, m in zip(kinds, models, strict=True):
            own = facts(counts[c], rows[c])
            mixed = lambda a, b: (1 - lattice.POOLED) * a + lattice.POOLED * b
            x = math.log10(rows[c] / len(learnt)) + math.log10(mixed(rows[c] / own[1], len(learnt) / pool[1]))
            for w in (t or "").encode().lower().split():
                counted = mixed(max(counts[c][w] - own[0], 0) / own[1], max(both[w] - pool[0], 0) / pool[1])
                rest = math.log(mixed(own[2], pool[2])) + brute_lattice(w, m)
                x += log_add([math.log(counted) if counted else -math.inf, rest]) / math.log(10)
            terms.append(x * math.log(10))
        out.append(log_add(terms) / math.log(10))
    return out


@pytest.mark.parametrize("frequent", [lattice.FREQUENT_WORDS, 0])
def test_score_is_the_whole_method(rows, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT_WORDS", frequent)
    rng = random.Random(3)
    en, fr = ["the", "of,", "ring", "thand."], ["lé", "des", "eaux", "ré."]
    docs = [(i, " ".join(rng.choices(en if i % 3 else fr, k=6)) + rng.choice(["", " newe", " théa."]), "en" if i % 3 else "fr") for i in range(40)] + [(50, None, None), (51, " ", "en")]
    out = lattice.lm_scores(rows(docs, "doc_id long, text string, lang string").repartition(3), rounds=2).collect()
    want = dict(zip([d for d, _, _ in docs], brute_scores(docs, 2), strict=True))
    assert {r["doc_id"]: r["score"] for r in out} == pytest.approx(want, rel=1e-9)


def test_lm_counts_and_beats_nothing_known(rows):
    rng = random.Random(4)
    en, fr = [f"the{i}" for i in range(40)], [f"lé{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(en if i % 2 else fr, k=30)), "en" if i % 2 else None) for i in range(300)] + [(900, None, "en"), (901, "", "xx"), (902, "Zz qq", "en"), (902, "ZZ  qq", "en")]
    out = lattice.lm_scores(rows(docs, "doc_id long, text string, lang string").repartition(5), rounds=2).collect()
    train, n = Counter(), 0
    for d, t, _ in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update((t or "").encode().lower().split())
            n += 1
    total, distinct = sum(train.values()) + n, len(train) + 1
    assert len(out) == len(docs)
    texts = {}
    for d, t, _ in docs:
        texts.setdefault(d, t)
    for r in out:
        words = (texts[r["doc_id"]] or "").encode().lower().split()
        base = sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((n + 1) / (total + distinct + 1))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(train[w] > 0 for w in words) + 1, total)
        assert r["base_score"] == pytest.approx(base) and math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in out if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lattice.lm_scores(rows([], "doc_id long, text string")).count() == 0


def test_long_words_keep_their_whole_score(rows):
    rng = random.Random(7)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    known = "".join(rng.choices("0123456789abcdef", k=900))
    words = ["".join(rng.choices("0123456789abcdef", k=n)) for n in (20, 200, 1000, 5000)] + ["a" * 3000, known]
    train = [(learnt[0], "x x y"), (learnt[1], f"z {known}")]
    out = lattice.lm_scores(rows(train + list(zip(held, words, strict=False)), "doc_id long, text string"), rounds=0)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    pieces, logp = lattice.read_vocabulary(lattice.tokens.vocabulary_path(lattice.VOCABULARY))
    uses = np.exp(logp) * lattice.PRIOR_PIECES / np.exp(logp).sum()
    model = brute_model(pieces, uses.tolist(), (uses * lattice.FIRST_STOP).tolist())
    # two rows, five words, four distinct, three of them once and one twice
    total, discount = 7.0, 3 / 5
    for doc, word in zip(held, words, strict=False):
        part = brute_lattice(word.encode(), model) / math.log(10) + math.log10(discount * 4 / total)
        if word == known:
            part = math.log10((1 - discount) / total)
        assert got[doc] == pytest.approx(part + math.log10(2 / total), rel=1e-6)


def test_index_search(rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x[200:420] = x[200]
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [1.0]), (2400, [None] + [1.0] * 15)]
    df = rows(data, "vec_id long, embedding array<float>").repartition(6)
    out = ann.search(df, df.where("vec_id % 20 = 0"), 10)
    hits = total = 0
    for q in range(0, 800, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(800), d))[:10]
        got = out.where(F.col("query_id") == q).orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]]) for r in got)
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        hits, total = hits + len({r["vec_id"] for r in got} & set(want.tolist())), total + 10
        if 200 <= q < 420:
            assert [r["vec_id"] for r in got] == want.tolist()
    assert hits / total >= 0.9
    assert {r["query_id"] for r in out.select("query_id").distinct().collect()} == set(range(0, 800, 20))
    assert ann.search(df.limit(0), df, 10).count() == 0
    few = df.where("vec_id < 3")
    assert ann.search(few, few, 10).count() == 6


def test_shards_are_compacted_under_a_manifest(spark, rows, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=60_000, smallest=500, fanout=3)
    rng = random.Random(6)
    data = [(i, "".join(rng.choices("abcdefghij ", k=rng.randint(0, 300)))) for i in range(1200)]
    for k in range(0, 1200, 150):
        store.append(rows(data[k : k + 150], SCHEMA).coalesce(2))
    first, live = store.manifest()
    assert first == 8 and len(live) == 16 and sum(s.rows for s in live) == 1200
    last = store.compact_all()
    _, after = store.manifest()
    assert last > first and len(after) < len(live) and not sharding.plan_merges(after, 60_000, 500, 3)
    assert sorted(store.read().select("doc_id", "text").collect()) == sorted(data)
    assert store.read(first).count() == 1200
    with pytest.raises(sharding.VersionConflict):
        store._commit(last - 1, live)
    assert store.manifest()[0] == last
    store.expire()
    assert store.versions() == [last] and sorted(store.read().select("doc_id", "text").collect()) == sorted(data)
    assert store.append(rows([], SCHEMA)) == last
    empty = sharding.ShardStore(spark, str(tmp_path / "none"))
    assert empty.read() is None and empty.compact_all() == 0


def test_store_merges_each_run_apart(spark, rows, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=1 << 20, smallest=1000, fanout=2)
    rng = random.Random(1)
    columns = "doc_id long, text string, shard string"
    data = [(i, None if i % 9 == 0 else rng.randbytes(n).hex(), "mine") for i, n in enumerate([300] * 4 + [20_000] * 4)] + [(3, "", None), (3, "", None)]
    for row in data:
        store.append(rows([row], columns).coalesce(1))
    _, live = store.manifest()
    runs = sharding.plan_merges(live, store.target, store.smallest, store.fanout)
    assert len(runs) >= 2
    monkeypatch.setattr(sharding, "JOB_RUNS", 2)
    assert store.compact()
    _, after = store.manifest()
    merged = {(s.first, s.last, s.rows) for s in after}
    assert {(r[0].first, r[-1].last, sum(s.rows for s in r)) for r in runs} <= merged
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, store.read().collect())) == sorted(map(key, data))
    with pytest.raises(ValueError):
        store.read(path_col="shard")
    # what another writer has written and not committed stays
    rows(data[:1], columns).write.parquet(f"{store.root}/data/other")
    store.expire()
    assert spark.read.parquet(f"{store.root}/data/other").count() == 1 and store.read().count() == len(data)
    last, live = store.manifest()
    with pytest.raises(sharding.VersionConflict):
        store._commit(last - 1, live)


def test_no_row_is_repeated_above_the_cap(rows):
    docs = [(i, "w " * 50, "a") for i in range(40)] + [(100 + i, "w " * 5, "b") for i in range(5)] + [(200 + i, t, "b") for i, t in enumerate(["", None, " "] * 4)]
    df = rows([(*d, 7) for d in docs], "doc_id long, text string, source string, _mix_plan int")
    out = mixing.repeat_rows(df)
    times = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == df.columns and max(times.values()) <= mixing.MAX_EPOCHS
    assert all(times[i] == mixing.MAX_EPOCHS for i in range(100, 105))


def test_arrivals_with_other_columns_lose_nothing(spark, rows, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=1 << 20, smallest=1000, fanout=2)
    store.append(rows([(1, "a"), (2, None)], "doc_id int, text string").coalesce(1))
    store.append(rows([(3, "b", "de")], "doc_id int, text string, lang string").coalesce(1))
    store.append(rows([(4_000_000_000, "fr", 2)], "doc_id long, lang string, stars tinyint").coalesce(1))  # retyped, a dropped column, a new one
    store.append(rows([(5, "c", 0.5)], "doc_id long, text string, stars double").coalesce(1))
    want = [(1, "a", None, None), (2, None, None, None), (3, "b", "de", None), (5, "c", None, 0.5), (4_000_000_000, None, "fr", 2.0)]
    read = lambda: sorted(tuple(r) for r in store.read().select("doc_id", "text", "lang", "stars").collect())
    assert read() == want and store.read().columns == ["doc_id", "text", "lang", "stars"]
    version = store.compact_all()
    store.expire(0)
    assert store.versions() == [version] and len(store.manifest()[1]) == 1 and read() == want
    for bad, why in (("doc_id string", "doc_id"), ("DOC_ID long", "case"), ("doc_id long, text array<string>", "text")):
        with pytest.raises(ValueError, match=why):
            store.append(spark.createDataFrame([], bad))
    assert store.manifest()[0] == version


def test_very_long_texts_in_shards(spark, rows, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=1 << 20, smallest=1000, fanout=2)
    long = ["x" * 3_000_000, " ".join(map(str, range(300_000)))]
    for i, text in enumerate(long):
        store.append(rows([(i, text)], "doc_id int, text string").coalesce(1))
    store.compact_all()
    assert [r["text"] for r in store.read().orderBy("doc_id").collect()] == long


def test_the_shards_query_gives_every_row(spark, rows, tmp_path):
    data = [(i, None if i % 7 == 0 else f"text {i} é" * (i % 5)) for i in range(60)] + [(3, "again")]
    rows(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op7_tiered_shards(spark, str(tmp_path)).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((r["doc_id"], r["text_crc32"], r["text_bytes"]) for r in out) == sorted((i, crc(t), len((t or "").encode())) for i, t in data)
    held = Counter(r["shard_no"] for r in out)
    assert all(r["shard_rows"] == held[r["shard_no"]] for r in out) and len({r["version"] for r in out}) == 1

"""Vector codes and whitening against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import annulus, catalog, common, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, size=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, size)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are one vector
    x[:5, 0] = -1 / 4096
    return [(i * 3, [float(c) for c in v], i % 4 if i % 7 else None) for i, v in enumerate(x)]


BAD = [(901, None, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None, *[0.0] * 14], 2), (904, [math.inf] * 16, None), (905, [0.5] * 3, 1)]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    size = Counter(len(v) for _, v, _ in rows).most_common(1)[0][0]
    rows = sorted((r for r in rows if len(r[1]) == size), key=lambda r: (r[0], r[1]))
    width = size // parts
    cut = [[tuple(math.floor(4096 * c) for c in v[j * width : (j + 1) * width]) for j in range(parts)] for _, v, _ in rows]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, j: min((square(p, e), k) for k, e in enumerate(books[j]))
    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for c in cut:
            for j in range(parts):
                held[j][near(c[j], j)[1]].append(c[j])
        books = [[tuple(math.floor(sum(x) / len(h)) for x in zip(*h, strict=True)) if (h := held[j].get(k)) else e for k, e in enumerate(books[j])] for j in range(parts)]
    found = [[near(c[j], j) for j in range(parts)] for c in cut]
    errors = Counter()
    for r, f in zip(rows, found, strict=True):
        errors[r[2]] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[r[2]], sha) for r, f in zip(rows, found, strict=True))


def test_codes_equal_brute_force(rows):
    data = vectors() + [(0, vectors()[4][1], 1), (0, vectors()[4][1], 1)]
    out, books = annulus.compress(rows(data + BAD, SCHEMA).repartition(5))
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute_codes(data)
    by_id = {i: v for i, v, _ in data[:300]}
    i, code, error = next((r[0], r[1], r[2]) for r in got if r[0])
    assert sum((math.floor(4096 * c) - d) ** 2 for c, d in zip(by_id[i], annulus.decode(code, books).tolist(), strict=True)) == error


def test_the_query_equals_brute_force_and_sql_has_its_columns(spark, rows, tmp_path):
    data = vectors(60, 64)
    rows(data, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalog.QUERIES["op11_annular_codes"](spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == brute_codes(data)


def test_an_annulus_holds_every_nearest_entry_and_leaves_others_out():
    rng = np.random.default_rng(0)
    entries = rng.integers(-50, 50, (16, 3)) * np.arange(1, 17)[:, None]
    entries[9] = entries[2]  # a tie goes to the lower index
    points = np.concatenate([entries, rng.integers(-900, 900, (500, 3)), np.zeros((1, 3), np.int64)])
    book = annulus.Codebook(entries)
    index, squared = book.nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (squared == every.min(axis=1)).all()
    low, high = book.annulus(points)
    assert 0 < (high - low).sum() < 0.8 * every.size


def test_codes_of_odd_tables(rows):
    out, books = annulus.compress(rows([], SCHEMA))
    assert out.collect() == [] and books == []
    assert annulus.compress(rows(BAD[:4], SCHEMA))[0].count() == 0
    few = [(7, [0.5, 0.25], None), (None, [0.5, 0.25], None), (3, [0.0, 0.0], 2)]  # fewer rows than entries, fewer components than parts
    df = rows([(a, b, c, 1, "x") for a, b, c in few], SCHEMA + ", code int, error string")
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in annulus.compress(df)[0].collect())
    assert got == [("3", "00" * 8, 0, 0), ("7", "0101" + "00" * 6, 0, 0), ("None", "0101" + "00" * 6, 0, 0)]
    with pytest.raises(ValueError, match="256"):
        annulus.compress(df, entries=257)


def test_groups_join_without_a_hot_task(rows):
    data = rows([(i, "a" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(3000)], "id long, key string")
    sizes = data.groupBy("key").count()
    got = common.join_groups(data, sizes, "key", "count").select("id", "count").collect()
    assert sorted(got) == [(i, 1000 if i % 3 < 2 else 1) for i in range(3000)]


def brute_whitening(x):
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    m = np.array(x, dtype=object)
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in m]
    centred = np.array([[(n * int(a) - s) / n for a, s in zip(r, sums, strict=True)] for r in m])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return deviation, values[::-1], centred @ columns[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))


def test_whitening_equals_brute_force(rows):
    data = vectors(200, 20, 5)
    order = [i for i, _, _ in data]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in data]
    deviation, values, white = brute_whitening(x)
    for tile in (7, 32):  # tiles that don't divide the dimensions, and one tile
        out, model = whitening.whiten(rows(data + [(i, v and v[:16], c) for i, v, c in BAD], SCHEMA).repartition(5), tile=tile)
        got = out.collect()
        assert len(got) == 8 * len(data) and {r["n"] for r in got} == {200}
        assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(zip(order, deviation, strict=True))
        for k in range(8):
            mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
            mine = np.array([mine[i] for i in order])
            assert np.abs(mine - white[:, k] * np.sign(mine @ white[:, k])).max() < 1e-8
            assert next(r["explained"] for r in got if r["component"] == k + 1) == pytest.approx(values[k] / values.sum(), rel=1e-10)
        assert {r["identity_error"] for r in got}.pop() < 1e-9


def test_sums_do_not_depend_on_how_rows_are_dealt(rows):
    df = rows([(i, v) for i, v, _ in vectors(120, 12)], "vec_id long, embedding array<float>")
    a, b = (whitening.whiten(x, tile=5)[1] for x in (df.coalesce(1), df.repartition(7)))
    assert a.sums == b.sums and (a.eigenvalues == b.eigenvalues).all() and (a.vectors == b.vectors).all()


def test_products_are_exact_for_large_integers():
    rng = np.random.default_rng(1)
    for bits in (10, 26, 40, 60):
        a, b = (rng.integers(-(1 << bits), 1 << bits, (9, 3)) for _ in range(2))
        assert (whitening.product(a, b) == a.astype(object).T @ b.astype(object)).all()


def test_whitening_of_odd_tables(rows):
    schema = "vec_id long, embedding array<double>, n string, component int"
    out, model = whitening.whiten(rows([], schema))
    assert out.count() == 0 and model is None
    assert whitening.whiten(rows([(1, None, "", 0), (2, [None], "", 0), (3, [], "", 0)], schema))[0].count() == 0
    one = whitening.whiten(rows([(1, [0.5, 0.5], "a", 3)], schema))[0].collect()
    assert [(r["component"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0), (2, 0, None, None, 0.0)]
    line = [(i, [float(i), 2.0 * i, 7.0], "a", 3) for i in range(5)] + [(None, [0.0, 0.0, 7.0], "b", 1), (2, [2.0, 4.0, 7.0], "c", 1)]
    out = whitening.whiten(rows(line, schema))[0].collect()
    assert len(out) == 21 and all((r["whitened"] is None) == (r["component"] > 1) for r in out)
    assert {r["explained"] for r in out if r["component"] == 1} == {1.0} and {r["identity_error"] for r in out}.pop() < 1e-9


def test_the_whitening_query(spark, rows, tmp_path):
    data = vectors(50, 64)
    rows(data, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalog.QUERIES["op13_tiled_whitening"](spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    deviation, _, _ = brute_whitening([[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in data])
    got = out.collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(zip([i for i, _, _ in data], deviation, strict=True)) and len(got) == 400

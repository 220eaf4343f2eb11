"""Sums and sweeps over spans, regions, numbered sources, fingerprints, logs and blinding against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import groups
from tessera.operators import blinding, chains, fingerprints, intervals, regions, splits
from tessera.operators import lines as L
from tessera.operators import units as U


def spans_of(seed=0, documents=3, lines=200, n=60):
    rng = random.Random(seed)
    out = []
    for d in range(documents):
        for i in range(n):
            a = rng.randrange(lines)
            out.append((d, f"s{i}", a, min(lines, a + rng.choice([0, 1, 5, 40, 150])), rng.randint(1, 3)))
    return out


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_BITS", 4)


def test_sums_over_spans(rows):
    rng = random.Random(1)
    lines = [(d, p, rng.randint(0, 9)) for d in range(3) for p in range(200)]
    found = intervals.span_sums(rows(spans_of(), "document_id int, id string, a int, b int, r int"), rows(lines, "document_id int, line_pos long, v int").repartition(4), {"n": F.lit(1), "total": F.col("v")}, "a", "b", edges=("v",))
    at = {(d, p): v for d, p, v in lines}
    for r in found.collect():
        inside = [at[r["document_id"], p] for p in range(r["a"], r["b"])]
        assert (r["n"], r["total"]) == (len(inside), sum(inside))
        assert (r["first_v"], r["last_v"]) == ((inside[0], inside[-1]) if inside else (None, None))


def test_owners_by_a_sweep(rows):
    data = spans_of(2)
    spans = rows(data, "document_id int, owner string, start_pos int, stop_pos int, rank int")
    lines = rows([(d, p, f"t{p}") for d in range(4) for p in range(200)], "document_id int, line_pos int, text string")
    found = intervals.segments(spans)
    for r in intervals.place(lines, found).collect():
        over = sorted((k, o) for d, o, a, b, k in data if d == r["document_id"] and a <= r["line_pos"] < b)
        want = (over[0][1], over[0][0], sum(k == over[0][0] for k, _ in over)) if over else (None, None, None)
        assert (r["owner"], r["rank"], r["claims"]) == want and r["text"] == f"t{r['line_pos']}"
    stretches = sorted(map(tuple, found.select("document_id", "start_pos", "stop_pos").collect()))
    assert all(x[2] <= y[1] for x, y in zip(stretches, stretches[1:], strict=False) if x[0] == y[0])


def test_ledger_over_spans_and_regions(rows):
    lines = rows([("d", i, "" if i == 7 else "t") for i in range(10)], "document_id string, line_pos long, text string")
    owned = rows([("d", 0, 3, "content", "a"), ("d", 2, 4, "content", "b"), ("d", 3, 5, "heading", "h"), ("d", 5, 9, "frontmatter", "f")], "document_id string, start_pos long, stop_pos long, kind string, owner_id string")
    reasons = rows([("d", 5, 3, "line rule")], "document_id string, line_pos long, priority int, reason string")
    found = rows([("d", 5, 7, 2, "references"), ("d", 0, 9, 9, "late")], "document_id string, start_pos long, stop_pos long, priority int, reason string")
    got = {r["line_pos"]: (r["classification"], r["reason"], r["owner_id"], r["contents"]) for r in L.ledger(lines, owned, reasons, found).collect()}
    want = {0: ("content", None, "a", 1), 1: ("content", None, "a", 1), 2: ("content", None, "a", 2), 3: ("content", None, "b", 1), 4: ("heading", None, "h", 0), 5: ("excluded", "references", None, 0), 6: ("excluded", "references", None, 0)}
    assert got == want | {i: ("excluded", "late", None, 0) for i in (7, 8)} | {9: ("unassigned", None, None, 0)}
    assert sorted(map(tuple, L.ledger_violations(L.ledger(lines, owned, reasons, found)).select("line_pos", "rule").collect())) == [(2, "two owners"), (9, "no owner")]


def test_regions_give_themselves_away(rows):
    text = ["Contents", "One .... 3", "Two .... 9", "Body one", "x .... 7", "References", "[1] A", "2 Next", "tail", "Annex I", "last"]
    lines = rows([("d", i, t) for i, t in enumerate(text)], "document_id string, line_pos long, text string")
    rules = [regions.Run("contents", 1, r"\.{3,}\s*\d+$"), regions.From("references", 2, "^References$", r"^\d+ [A-Z]"), regions.From("annex", 3, "^Annex")]
    found = regions.find(lines, rules)
    assert sorted((r["reason"], r["start_pos"], r["stop_pos"]) for r in found.collect()) == [("annex", 9, 11), ("contents", 1, 3), ("references", 5, 7)]
    both = found.union(rows([("d", 2, 6, 1, "aaa")], "document_id string, start_pos long, stop_pos long, priority int, reason string"))
    got = {r["line_pos"]: r["reason"] for r in regions.exclusions(lines, both).collect()}
    assert got == {1: "contents", 2: "aaa", 3: "aaa", 4: "aaa", 5: "aaa", 6: "references", 9: "annex", 10: "annex"}
    with pytest.raises(ValueError):
        regions.find(lines, [])


def brute_chain(numbers):
    best = []
    def go(path):
        nonlocal best
        if len(path) > len(best):
            best = path
        for j in range(path[-1] + 1, len(numbers)):
            if numbers[j] == numbers[path[-1]] + 1:
                go([*path, j])
    for i in range(len(numbers)):
        go([i])
    return best


def test_the_longest_chain_of_numbers():
    rng = random.Random(3)
    assert regions.longest_chain([]) == [] and regions.longest_chain([5]) == [0]
    assert regions.longest_chain([1, 2, 1, 3, 9, 4, 2, 3]) == [0, 1, 3, 5]
    for _ in range(200):
        numbers = [rng.randint(1, 6) for _ in range(rng.randint(1, 12))]
        got = regions.longest_chain(numbers)
        assert all(numbers[b] == numbers[a] + 1 and a < b for a, b in zip(got, got[1:], strict=False))
        assert len(got) == len(brute_chain(numbers)) and got[0] == brute_chain(numbers)[0]


def test_numbered_sources_cover_their_region(rows):
    text = ["Title", "Whereas:", "(1) First", "wrapped", "(2) OJ L 3", "(2) Second, see", "(1) above", "(7) stray", "(3) Third", "HAVE ADOPTED", "(4) later"]
    lines = rows([("d", i, t) for i, t in enumerate(text)] + [("e", 0, "plain")], "document_id string, line_pos long, text string")
    bounds = rows([("d", 0, 9), ("e", 0, 1), ("f", 0, 0)], "document_id string, start_pos long, stop_pos long")
    found = regions.numbered_sources(lines, bounds, reference=F.col("text").rlike(r"^\(\d+\) OJ "))
    assert sorted((r["document_id"], r["source_key"], r["start_pos"], r["stop_pos"]) for r in found.collect()) == [("d", "frontmatter", 0, 2), ("d", "recital-001", 2, 5), ("d", "recital-002", 5, 8), ("d", "recital-003", 8, 9), ("e", "frontmatter", 0, 1)]
    kept = regions.source_lines(lines, found)
    assert sorted((r["document_id"], r["line_pos"]) for r in kept.collect()) == [("d", i) for i in range(9)] + [("e", 0)]
    fewer = regions.source_lines(lines, found, rows([("d", 8), ("d", 3)], "document_id string, line_pos long"))
    extra = regions.extra_sources(found, fewer, "Recital")
    assert sorted((r["source_key"], r["label"], r["lines"]) for r in extra.where("document_id = 'd'").collect()) == [("frontmatter", "frontmatter", 2), ("recital-001", "Recital 1", 2), ("recital-002", "Recital 2", 3)]
    nodes = rows([("n", "d", [], "Heading")], "node_id string, document_id string, ancestor_ids array<string>, full_heading string")
    assert U.logical_sources(nodes, rows([], "node_id string, line_pos long"), extra).count() == 5


def brute_fingerprint(values, hashes, field):
    modulus, base = fingerprints.FIELDS[field]
    return sum(hashes[field, v] * pow(base, i, modulus) for i, v in enumerate(values)) % modulus


def test_fingerprints_combine(spark, rows):
    rng = random.Random(4)
    parts = {(s, p): [rng.choice("abc") for _ in range(rng.randint(0, 40))] for s in range(4) for p in range(1, 5)}
    whole = {s: [v for p in range(1, 5) for v in parts[s, p]] for s in range(4)}
    data = rows([(s, i, v) for s, vs in whole.items() for i, v in enumerate(vs)], "s int, i long, v string")
    held = rows([(s, p, i, v) for (s, p), vs in parts.items() for i, v in enumerate(vs)], "s int, p int, i long, v string")
    one = {r["s"]: tuple(r)[1:] for r in fingerprints.fingerprint(data.repartition(5), ["s"], F.col("i"), F.col("v")).collect()}
    two = {r["s"]: tuple(r)[1:] for r in fingerprints.combine(fingerprints.fingerprint(held, ["s", "p"], F.col("i"), F.col("v")), ["s"], "p").collect()}
    assert one == two
    hashes = {}
    for k, (modulus, _) in enumerate(fingerprints.FIELDS):
        for r in spark.createDataFrame([("a",), ("b",), ("c",)], "v string").select("v", fingerprints._element(F.col("v"), modulus, k).alias("h")).collect():
            hashes[k, r["v"]] = r["h"]
    assert one == {s: (len(v), brute_fingerprint(v, hashes, 0), brute_fingerprint(v, hashes, 1)) for s, v in whole.items()}
    far = rows([(0, 123_456_789_012, "a")], "s int, i long, v string")  # a place of 37 bits
    got = fingerprints.fingerprint(far, ["s"], F.col("i"), F.col("v")).first()
    assert got["hash_a"] == hashes[0, "a"] * pow(fingerprints.FIELDS[0][1], 123_456_789_012, fingerprints.FIELDS[0][0]) % fingerprints.FIELDS[0][0]


def test_assembly_faults_are_told(rows):
    lines = rows([(s, i, f"{s}-{i}") for s in "abcdefg" for i in range(6)], "source_id string, line_order long, text string")
    whole = {(s, p, i): f"{s}-{3 * (p - 1) + i}" for s in "abcdefg" for p in (1, 2) for i in range(3)}
    whole["b", 1, 0], whole["b", 1, 2] = whole["b", 1, 2], whole["b", 1, 0]
    whole["c", 2, 0], whole["c", 1, 0] = whole["c", 1, 0], whole["c", 2, 0]  # across parts
    del whole["d", 2, 2]
    whole["e", 2, 1] += "!"
    held = rows([(*k, t) for k, t in whole.items() if k[0] != "f"] + [("x", 1, 0, "x")], "source_id string, part_number int, place long, text string")
    parts = held.select("source_id", "part_number").distinct().union(rows([("g", 1), ("f", 9)], "source_id string, part_number int"))
    got = sorted(map(tuple, fingerprints.assembly_violations(lines, parts, held).collect()))
    assert got == [("b", "order or text"), ("c", "order or text"), ("d", "lines"), ("e", "order or text"), ("f", "no parts"), ("f", "part without lines"), ("g", "part repeated"), ("x", "no source")]


def test_chains_of_records(rows):
    data = rows([(c, i, f"{c}{i}") for c in ("u", "v") for i in range(6)] + [("w", 0, None)], "who string, n int, content string")
    log = chains.seal(data.repartition(3), "who", ["n"], "content")
    kept = {(r["who"], r["place"]): r for r in log.collect()}
    first = kept["u", 0]
    assert first["previous_hash"] == chains.GENESIS and first["hash"] == hashlib.sha256("\x1f".join(["u", "0", chains.GENESIS, "u0"]).encode()).hexdigest()
    assert kept["u", 3]["previous_hash"] == kept["u", 2]["hash"] and chains.chain_violations(log, "who").isEmpty()
    beside = log.where("who = 'v' AND place = 2").withColumn("content", F.lit("slipped in")).withColumn("hash", chains.record_hash(F.col("who"), F.col("place"), F.col("previous_hash"), F.col("content")))
    bad = log.where("NOT (who = 'u' AND place = 1)").withColumn("content", F.when(F.expr("who = 'u' AND place = 4"), "changed").otherwise(F.col("content")))
    bad = bad.union(beside).union(log.where("who = 'w'"))
    moved = log.where("who = 'v' AND place = 5").withColumn("place", F.lit(9).cast("long"))
    bad = bad.where("NOT (who = 'v' AND place = 5)").union(moved)
    got = sorted(map(tuple, chains.chain_violations(bad, "who").collect()))
    assert got == [("u", 2, "gap"), ("u", 4, "content"), ("v", 2, "fork"), ("v", 2, "fork"), ("v", 9, "content"), ("v", 9, "place"), ("w", 0, "repeated")]


def test_round_completion(rows):
    who = rows([(1, a, "b1") for a in ("x", "y", "z")], "round_id int, annotator_id string, batch_sha256 string")
    steps = lambda a, **other: [(1, a, s, i, "b1", f"{a}{i - 1}", f"{a}{i}", s == "attestation") for i, s in enumerate(chains.STEPS)]
    schema = "round_id int, annotator_id string, step string, at int, batch_sha256 string, subject_sha256 string, own_sha256 string, independent boolean"
    assert chains.completion_violations(rows([r for a in "xyz" for r in steps(a)], schema), who).isEmpty()
    y, z = steps("y"), steps("z")
    y[2] = (*y[2][:3], 0, "b2", "other", *y[2][6:])
    z[3] = (*z[3][:7], None)
    got = chains.completion_violations(rows(steps("x")[:3] + y + z + z[:1] + steps("stranger")[:1], schema), who)
    assert sorted(map(tuple, got.select("annotator_id", "rule").collect())) == [("stranger", "unexpected"), ("x", "missing"), ("y", "batch"), ("y", "binding"), ("y", "order"), ("z", "attestation"), ("z", "repeated")]


def test_forbidden_names_at_any_depth(rows):
    data = [(1, '{"a": {"b": [{"Secret": 1}, [{"x": {"secret": null}}]]}, "secret": {"secret": 2}}'), (2, '{"secrets": ["secret"]}'), (3, "{oops"), (4, None), (5, "[]"), (6, '"secret"')]
    got = sorted(map(tuple, blinding.leaks(rows(data, "case_id int, record string"), "record", {"SECRET"}).collect()))
    assert got == [(1, "$.a.b[0].Secret"), (1, "$.a.b[1][0].x.secret"), (1, "$.secret"), (1, "$.secret.secret"), (3, "$")]


def test_split_manifests(rows):
    data = [("d", i, f"c{i % 5}", ("development", "validation", "test")[i % 5 % 3]) for i in range(30)]
    schema = "dataset_id string, case_id int, component string, split_name string"
    sets = rows([("d", "h")], "dataset_id string, dataset_sha256 string")
    made = splits.manifests(rows(data, schema), sets)
    record = made.first()
    assert (record["component_count"], record["split_case_counts"]) == (5, {"development": 12, "validation": 12, "test": 6})
    assert splits.violations(made, rows(data[::-1], schema).repartition(3), sets).isEmpty()
    rules = lambda found, a, d=sets: sorted(r["rule"] for r in splits.violations(found, rows(a, schema), d).collect())
    swapped = [("d", 1, "c1", "test"), ("d", 2, "c2", "validation"), *(r for r in data if r[1] not in (1, 2))]  # counts stay
    assert rules(made, swapped) == ["assignments", "component crosses splits"]
    assert rules(made, [*data[1:], ("d", 0, "c0", None)]) == ["assignments", "case without split", "split counts"]
    assert rules(made, [*data, ("d", 0, "c0", "test")]) == ["assignments", "case in several splits", "component crosses splits", "split counts"]
    assert rules(made.union(made), data) == ["repeated"] and rules(made.limit(0), data) == ["no manifest"]
    assert rules(made, data, rows([("d", "other")], "dataset_id string, dataset_sha256 string")) == ["dataset_sha256"]
    assert rules(made, data, rows([("e", "h")], "dataset_id string, dataset_sha256 string")) == ["no dataset", "no manifest"]


def test_groups_stay_whole_above_a_union_of_tables_that_are_coalesced_apart(spark):
    rows = spark.range(40_000).select((F.col("id") % 400).alias("document_id"), F.md5(F.col("id").cast("string")).alias("t"))
    large = rows.repartition("document_id").groupBy("document_id").agg(F.array_join(F.collect_list("t"), "").alias("t"))
    small = rows.where("t < '1'").groupBy("document_id").agg(F.min("t").alias("t"))
    settings = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = groups.stream_groups(large.union(small), "document_id", "t", lambda key, group: [(key, len(group["t"]))], "document_id long, n int").collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    both = {r["document_id"] for r in small.select("document_id").collect()}
    assert sorted(map(tuple, found)) == [(d, 1 + (d in both)) for d in range(400)]

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions.groups import stream_groups
from tessera.functions import text as T
from tessera.functions.order import dense_order
from tessera.operators import headings as H
from tessera.operators import hierarchy as Y
from tessera.operators import lines as L
from tessera.operators import units as U


def one(rows, column, value, kind="string"):
    return rows([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("text", ["a\r\nb\rc\n", "", "\n", "a\x0bb\x0cc\x1cd\u0085e f", "a\n\nb", "x"])
def test_split_lines_as_python(rows, text):
    assert one(rows, T.split_lines, text) == text.splitlines()


def test_small_text_functions(rows):
    assert one(rows, T.collapse_spaces, " a  b\tc\x1d ") == "a b c"
    assert one(rows, T.count_words, "a b c\n") == 3
    assert one(rows, T.normalize_newlines, None) == ""
    assert one(rows, T.media_type, "Application/PDF; x=1") == "application/pdf"
    assert one(rows, T.normalized_question, "  GROẞ  und\tStraße ") == "gross und strasse"
    assert one(rows, T.join_wrapped, ["risk-", "based  use", "Now"], "array<string>") == "risk-based use Now"
    assert one(rows, lambda c: T.join_dehyphenated(c, ("context-specific",)), ["manage-", "ment of context-", "specific"], "array<string>") == "management of context-specific"
    assert one(rows, T.logical_source_key, "a:b:part-002") == "a:b" and one(rows, T.logical_source_key, "a:b") is None
    assert set(one(rows, T.content_tokens, "What is the well-known AI risk, a risk?")) == {"well-known", "ai", "risk"}
    assert rows([(["a", "b", "c"],)], "w array<string>").select(T.contains_in_order(F.col("w"), F.array(F.lit("a"), F.lit("c"))), T.contains_in_order(F.col("w"), F.array(F.lit("c"), F.lit("a")))).first() == (True, False)


def test_dense_order(rows):
    keys = random.Random(1).sample(range(1000), 50)
    out = dense_order(rows([(k,) for k in keys], "k long").repartition(7), "k")
    assert [r[0] for r in out.orderBy("accepted_order").collect()] == sorted(keys)
    assert sorted(r[1] for r in out.collect()) == list(range(50))


def pages(rows, *texts):
    return rows([("d", f"d:page-{i:04d}", i, t) for i, t in enumerate(texts, 1)], "document_id string, page_id string, page_number int, text string")


def test_line_table_and_neighbours(rows):
    df = L.line_table(pages(rows, "a\n\n b \n", "", "c"))
    got = [(r["page_number"], r["line_number"], r["line_pos"], r["text"]) for r in df.orderBy("line_pos").collect()]
    assert got == [(1, 1, 0, "a"), (1, 2, 1, ""), (1, 3, 2, " b "), (3, 1, 3, "c")]
    near = [(r["previous_line"], r["next_line"]) for r in L.neighbours(df).orderBy("line_pos").collect()]
    assert near == [("", "b"), ("a", "b"), ("a", ""), ("", "")]
    assert L.page_violations(pages(rows, "a", "b")).isEmpty()
    assert L.page_violations(rows([("d", "d:page-0002", 2), ("e", "e:page-0009", 1)], "document_id string, page_id string, page_number int")).count() == 2


def test_islands_and_order(rows):
    df = rows([("d", p) for p in (0, 1, 2, 5, 6, 9)], "document_id string, line_pos long")
    assert sorted((r["start_pos"], r["end_pos"], r["line_count"]) for r in L.islands(df, "document_id").collect()) == [(0, 2, 3), (5, 6, 2), (9, 9, 1)]
    bad = rows([("d", 1, 1, 1), ("d", 2, 1, 1), ("d", 3, 1, 2)], "document_id string, n int, page int, line int")
    assert [r["n"] for r in L.order_violations(bad, "document_id", "page", "line", given="n").collect()] == [2]


def test_boundaries(rows):
    cases = [
        ("It ends.", "Next", False, "after_strong_terminal"), ("It ends.", "lower", True, None), ("It ends.", "https://x", True, None), ("list", "(a) item", False, "before_structured_start"),
        ("list:", "(a) item", True, None), ("plain", "Next", True, "at_blank_paragraph_gap"), ("plain", "Next", False, None), ("plain", None, False, "end_of_source_unit"), ("by", "J. Smith", False, None),
    ]
    df = rows([(i, *c) for i, c in enumerate(cases)], "i int, t string, n string, g boolean, want string")
    for r in df.withColumn("got", L.boundary_reason(F.col("t"), F.col("n"), F.col("g"))).collect():
        assert r["got"] == r["want"], r


def test_ledger_precedence(rows):
    lines = rows([("d", i, t) for i, t in enumerate(["body", "head", "foot", "", "front", "?"])], "document_id string, line_pos long, text string")
    owned = rows([("d", 0, "content", "u1"), ("d", 0, "heading", "h"), ("d", 1, "heading", "h1"), ("d", 1, "content", "u9"), ("d", 4, "frontmatter", "f")], "document_id string, line_pos long, kind string, owner_id string")
    reasons = rows([("d", 2, 2, "late"), ("d", 2, 1, "first"), ("d", 0, 1, "never")], "document_id string, line_pos long, priority int, reason string")
    got = {r["line_pos"]: (r["classification"], r["reason"], r["owner_id"]) for r in L.ledger(lines, owned, reasons).collect()}
    assert got == {0: ("content", None, "u1"), 1: ("content", None, "u9"), 2: ("excluded", "first", None), 3: ("blank", None, None), 4: ("frontmatter", None, "f"), 5: ("unassigned", None, None)}
    assert L.ledger_violations(L.ledger(lines, owned, reasons)).first()["rule"] == "no owner"


def test_furniture_as_the_sql_has_it(spark, rows, tmp_path):
    texts = [
        None, "", "\n", "a\n\n", "x" * 20 + "\n" + "x" * 21, "a long line that ends here\r\nand one more long line\r", "long enough for a line\u2028and one more", "one\x0btwo\x0cthree\x85 and some more",
        "\u00a0\n \n", "\u3000", "\t \n\f", "\x0b", "\x1c\x1d", "a" * 12 + "\u00a0", "a" * 12 + "\x85", "licen\u017fed under", "Licensed\u00a0under", " licensed \t under x", "a|b", "\u00e9" * 13, "\n".join(["y" * 25, "z"] * 2100),
    ]
    data = [*enumerate(texts), (None, "n" * 30 + "\n|"), (None, "|\nshort"), (7, "y" * 30 + "\nshort"), (7, "")]
    rows(data, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in entry.queries()["furniture_ledger"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(db.execute(entry.oracle_sql()["furniture_ledger"]).fetchall(), key=key)


ACT = "CHAPTER I\nGeneral provisions\nArticle 1\nSubject\n1. Text of it.\n12\nANNEX II\nList of\nacts\nArticle 9\nmore"
STANDARD = "1. First Part\ntext\n1.1 Second Part\nGOVERN 1.1: Legal require-\nments are\nunderstood.\nAppendix A\nGlossary of terms\n12\n3. A long item about things: with a colon and more than eighty-five characters in all of its text"


def test_headings_of_acts(rows):
    lines = L.line_table(pages(rows, ACT))
    found = H.candidates(lines, H.ACT)
    out = {r["marker_text"]: r for r in H.reconstruct(lines, found, H.ACT).collect()}
    assert set(out) == {"CHAPTER I", "Article 1", "ANNEX II"}
    assert out["CHAPTER I"]["full_heading"] == "CHAPTER I General provisions"
    assert out["ANNEX II"]["full_heading"] == "ANNEX II List of acts Article 9" and out["ANNEX II"]["source_line_numbers"] == [7, 8, 9, 10]
    assert out["Article 1"]["heading_id"] == "d:page-0001:line-0003"


def test_headings_of_standards(rows):
    lines = L.line_table(pages(rows, STANDARD, "Contents\n1. First Part"))
    out = {r["marker_text"]: r["full_heading"] for r in H.reconstruct(lines, H.candidates(lines, H.STANDARD), H.STANDARD).collect()}
    assert out == {"1. First Part": "1. First Part", "1.1 Second Part": "1.1 Second Part", "GOVERN 1.1: Legal require-": "GOVERN 1.1: Legal requirements are understood.", "Appendix A": "Appendix A Glossary of terms"}


def test_act_tree(rows):
    kinds = ["chapter", "section", "article", "chapter", "article", "annex", "section", "article"]
    df = rows([("d", i, f"h{i}", k) for i, k in enumerate(kinds)], "document_id string, line_pos long, heading_id string, candidate_type string")
    out = Y.act_parents(df)
    assert [r["parent_id"] for r in out.orderBy("line_pos").collect()] == [None, "h0", "h1", None, "h3", None, "h5", None]
    assert [r["heading_id"] for r in Y.act_violations(out).collect()] == ["h7"]


def test_depth_tree_and_spans(rows):
    depths = [1, 2, 3, 2, 1, 3]
    df = rows([("d", i, f"h{i}", d) for i, d in enumerate(depths)], "document_id string, line_pos long, heading_id string, depth int")
    assert [r["parent_id"] for r in Y.depth_parents(df).orderBy("line_pos").collect()] == [None, "h0", "h1", "h0", None, None]
    spans = Y.spans(df.withColumn("start_pos", F.col("line_pos") * 2).withColumn("end_pos", F.col("line_pos") * 2), rows([("d", 13)], "document_id string, line_count long"))
    assert [(r["direct_start"], r["direct_stop"], r["subtree_stop"]) for r in spans.orderBy("start_pos").collect()] == [(1, 2, 8), (3, 4, 6), (5, 6, 6), (7, 8, 8), (9, 10, 13), (11, 13, 13)]
    lines = rows([("d", i, 1 + i // 7, "" if i == 1 else "t") for i in range(13)], "document_id string, line_pos long, page_number int, text string")
    got = {r["heading_id"]: tuple(r)[2:] for r in Y.span_metrics(spans, lines).collect()}
    assert got["h0"] == (1, 0, False, True, False) and got["h5"] == (2, 2, False, False, False)
    assert Y.containment_violations(spans, rows([("h2", "h1"), ("h3", "h1")], "heading_id string, ancestor_id string")).collect() == [("h3", "h1")]


def test_paths_and_tree_checks(rows):
    nodes = rows([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C")], "node_id string, parent_id string, name string")
    out = Y.paths(nodes)
    assert {(r["node_id"], r["depth"], "/".join(r["path"])) for r in out.collect()} == {("a", 0, "A"), ("b", 1, "A/B"), ("c", 2, "A/B/C")}
    good = out.join(nodes.select("node_id", "parent_id"), "node_id")
    assert Y.violations(good).isEmpty()
    assert {r["rule"] for r in Y.violations(good.withColumn("depth", F.lit(0))).collect()} == {"depth"}


def test_synthetic_parents(rows):
    df = rows([("d", 1, "GOVERN 1.1: x"), ("d", 2, "GOVERN 1.2: y"), ("d", 3, "MAP 2: z"), ("d", 4, "MAP 2.1: w")], "document_id string, line_pos long, full_heading string")
    got = {r["node_id"]: (r["parent_id"], r["line_pos"]) for r in Y.synthetic_parents(df).collect()}
    assert got == {"synthetic:d:rmf-function:govern": (None, 1), "synthetic:d:rmf-function:map": (None, 3), "synthetic:d:rmf-category:govern:1": ("synthetic:d:rmf-function:govern", 1)}


def brute_partition(ends, tokens, hard, target):
    best = None
    for k in range(len(ends)):
        for mids in itertools.combinations(range(len(ends) - 1), k):
            cuts = [*mids, len(ends) - 1]
            sizes = [tokens(0 if i == 0 else ends[cuts[i - 1]][0] + 1, ends[c][0]) for i, c in enumerate(cuts)]
            if max(sizes) <= hard:
                cost = (len(cuts), sum(ends[c][1] for c in cuts), sum(abs(target - s) for s in sizes))
                best = min(best, cost) if best else cost
    return best


def test_partition_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        sizes = [rng.randint(1, 9) for _ in range(n)]
        tokens = lambda a, b, s=sizes: sum(s[a : b + 1])
        ends = [(i, rng.random() < 0.4) for i in range(n) if i == n - 1 or rng.random() < 0.7]
        path, want = U.best_partition(ends, tokens, 14, 10), brute_partition(ends, tokens, 14, 10)
        if want is None:
            assert path is None
            continue
        got = [tokens(0 if i == 0 else ends[path[i - 1]][0] + 1, ends[p][0]) for i, p in enumerate(path)]
        assert (len(path), sum(ends[p][1] for p in path), sum(abs(10 - g) for g in got)) == want


def test_greedy_cuts():
    s = "after_strong_terminal"
    assert U.greedy_cuts([3, 3], [None, "end_of_source_unit"], 0, 10, 5) == ([(0, 1, 6, "end_of_source_unit")], None)
    assert U.greedy_cuts([4, 4, 4, 4], [s, s, s, "end_of_source_unit"], 0, 10, 6)[0] == [(0, 1, 8, s), (2, 3, 8, "end_of_source_unit")]
    assert U.greedy_cuts([4, 4, 4, 4], [s, None, s, "end_of_source_unit"], 0, 10, 6)[0][0] == (0, 0, 4, s)
    assert U.greedy_cuts([4, 4, 4], [None, None, "end_of_source_unit"], 0, 10, 6)[1] == "no_corrected_safe_boundary"
    assert U.greedy_cuts([40, 1], [s, "end_of_source_unit"], 0, 10, 6)[1] == "single_line_over_budget"
    assert U.greedy_cuts([1], [None], 10, 10, 6)[1] == "context_exhausts_hard_budget"
    assert U.greedy_cuts([], [])[1] == "no_coordinates"


def test_packing_covers_every_line(rows):
    rng = random.Random(5)
    data = [(f"s{k}", i, rng.randint(1, 30), rng.choice([None, "after_strong_terminal"])) for k in range(4) for i in range(40)]
    out = U.greedy_pack(rows(data, "source_id string, line_order long, words long, reason string").repartition(3), 0, 200, 120)
    for k in range(4):
        mine = sorted((r["part_number"], r["first_order"], r["last_order"]) for r in out.where(F.col("source_id") == f"s{k}").collect() if not r["failure"])
        assert mine[0][1] == 0 and all(a[2] + 1 == b[1] for a, b in itertools.pairwise(mine))


def test_entries_and_texts(rows):
    lines = rows([("s", i, w, t) for i, (w, t) in enumerate([(5, "[1] a"), (4, "b"), (6, "[2] c"), (3, "[3] d")])], "source_id string, line_order long, words long, text string")
    packed = U.pack_entries(U.reference_entries(lines, F.col("text").startswith("[")), 15, 12)
    assert sorted((r["entry"], r["words"], r["pack"]) for r in packed.collect()) == [(1, 9, 1), (2, 6, 1), (3, 3, 2)]
    body = rows([("s", 0, 1, 4, " a "), ("s", 1, 1, 6, "b"), ("s", 2, 2, 9, "c")], "source_id string, line_order long, page_number int, line_pos long, text string")
    got = U.passage_texts(rows([("s", 1, 0, 2)], "source_id string, passage_number int, first_order long, last_order long"), body, F.lit("L")).first()
    assert got["citation_text"] == "a\n\nb\nc" and got["retrieval_text"] == "L\n\na\n\nb\nc"
    units = rows([("k", 1, "heading_body", "d"), ("k", 3, "heading_body", "d")], "logical_source_key string, part_number int, unit_kind string, document_id string")
    assert U.part_violations(units).first()["rule"] == "parts with a gap"


def test_long_chains_keep_every_node(rows):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, str(i)) for i in range(12)]
    nodes = rows([*chain, ("a", "b", "x"), ("b", "a", "x"), ("lost", "none", "x"), ("n3", "n7", "again")], "node_id string, parent_id string, name string")
    out = Y.paths(nodes)
    got = {r["node_id"]: (r["depth"], r["path"]) for r in out.where("node_id <> 'n3'").collect()}
    assert got["n11"] == (11, [str(i) for i in range(12)]) and len(got) == 11
    assert {r["node_id"] for r in Y.unreached(nodes, out).collect()} == {"a", "b", "lost"}
    deep = rows([("d", i, f"h{i}", i + 1) for i in range(12)] + [("d", 12, "h12", 14), ("d", 13, "h13", 12)], "document_id string, line_pos int, heading_id string, depth int")
    assert [r["parent_id"] for r in Y.depth_parents(deep).orderBy("line_pos").collect()] == [None, *[f"h{i}" for i in range(11)], None, "h10"]


def test_groups_stream_whole_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).selectExpr("CASE WHEN id % 11 = 0 THEN NULL ELSE id % 11 END AS k", "200 - id AS o")
        out = stream_groups(df, "k", "o", lambda k, c: [(k, len(c["o"]), c["o"] == sorted(c["o"]))], "k long, n int, sorted boolean").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert sorted((-1 if r["k"] is None else r["k"], r["n"]) for r in out) == [(-1 if k == 0 else k, len(range(k, 200, 11))) for k in range(11)]
    assert all(r["sorted"] for r in out)

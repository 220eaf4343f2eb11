import pytest
from pyspark.sql import functions as F

from tessera.operators import governance as G
from tessera.operators import lines as L
from tessera.operators import units as U
from tessera.plans import baselines
from tessera.sources import sinks


def test_footnotes_and_reference_starts(rows):
    df = rows([("d", 1, i + 1, i, t) for i, t in enumerate(["as shown.12", "", "12 See the act.", "3 Other"])], "document_id string, page_number int, line_number int, line_pos long, text string")
    assert sorted((r["number"], r["linked"]) for r in L.footnotes(df).collect()) == [(3, False), (12, True)]
    t = rows([("(1) Directive 95/46",), ("(2) The aim",), ("Directive",)], "t string")
    assert [r[0] for r in t.select(L.reference_start(F.col("t"), ["directive"])).collect()] == [True, False, False]


def test_sources_units_and_coverage(rows):
    nodes = rows([("a", "d", [], "A"), ("b", "d", ["a"], " "), ("c", "d", ["a"], "C")], "node_id string, document_id string, ancestor_ids array<string>, full_heading string")
    content = rows([("b", 1), ("b", 2)], "node_id string, line_pos long")
    found = U.logical_sources(nodes, content)
    assert {(r["source_key"], r["unit_kind"], r["label"]) for r in found.collect()} == {("b", "heading_body", "b"), ("c", "heading_only", "C")}
    lines = rows([("b", 0, 4, "after_strong_terminal"), ("b", 1, 4, "end_of_source_unit")], "source_id string, line_order long, words long, reason string")
    pieces = U.greedy_pack(lines, 0, 6, 4)
    units = U.materialize_units(pieces, found)
    assert sorted((r["unit_id"], r["part_count"]) for r in units.collect()) == [("candidate-v2:d:b:part-001", 2), ("candidate-v2:d:b:part-002", 2)]
    assert U.coverage_violations(pieces, lines).isEmpty() and U.part_violations(units).isEmpty()
    assert U.coverage_violations(pieces.where("part_number = 1"), lines).first()["rule"] == "lines"


def test_adjudication_alignment_and_enumerations(rows):
    needed = rows([(1, True), (2, False)], "case_id int, disagrees boolean")
    done = rows([(1, "sufficient", [], [], False, None), (3, "insufficient", ["x"], ["c"], True, "s")], "case_id int, final_status string, final_codes array<string>, categories array<string>, guide_change boolean, guide_summary string")
    assert {tuple(r) for r in G.adjudication_violations(done, needed).collect()} == {(1, "no category"), (2, "missing"), (3, "not needed")}
    a, b = rows([(1, 1), (2, 2)], "case_id int, position int"), rows([(1, 1), (2, 3), (4, 4)], "case_id int, position int")
    assert {tuple(r) for r in G.alignment_violations(a, b).collect()} == {(2, "position"), (4, "missing")}
    assert {tuple(r) for r in G.enumeration_violations(done, {"final_status": ["sufficient"], "categories": ["d"]}).collect()} == {(3, "final_status"), (3, "categories")}


def test_baseline_is_published_once(rows, spark, tmp_path):
    passages = rows([(1, "red red blue"), (2, "red green")], "passage_id long, text string")
    questions, gold = rows([(7, "blue")], "query_id long, text string"), rows([(7, 1, 2)], "query_id long, passage_id long, grade int")
    out = str(tmp_path / "bm25")
    assert baselines.bm25(passages, questions, gold, out).first()["mean_recall_at_1"] == 1.0
    assert spark.read.json(out).first()["result_id"] == "bm25"
    with pytest.raises(sinks.OutputExists):
        baselines.bm25(passages, questions, gold, out)

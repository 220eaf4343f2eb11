import hashlib
import io
import itertools
import json
import threading
import urllib.error
import urllib.request
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera import server
from tessera.functions import text as T
from tessera.functions import wordpiece
from tessera.operators import artifacts as R
from tessera.operators import atoms as K
from tessera.operators import contracts as C
from tessera.operators import governance as G
from tessera.operators import hybrid
from tessera.operators import units as U
from tessera.sources import files

LINES = "source_id string, line_order long, text string, reason string"
BASELINE = {
    "schema_version": "1.0", "feature_names": list(C.FEATURES),
    "training": {"feature_means": [0.0] * 5, "feature_scales": [1.0] * 5, "coefficients": [0.5] * 5, "intercept": 0, "selected_threshold": 0.4},
}


def test_lines_split_at_anchors(rows):
    lines = rows([("s", 0, "One. Two. Three", None), ("s", 1, None, "end_of_source_unit"), ("t", 0, "é😀. x", "end_of_source_unit")], LINES)
    anchors = rows([("s", 0, 5), ("s", 0, 10), ("s", 0, 10), ("s", 0, 99), ("s", 0, 0), ("t", 0, 4), ("u", 0, 1)], "source_id string, line_order long, split_offset int")
    got = [tuple(r) for r in K.split_lines(lines, anchors).orderBy("source_id", "line_order", "start_char").collect()]
    assert got == [
        ("s", 0, 0, 5, "One. ", K.IN_LINE), ("s", 0, 5, 10, "Two. ", K.IN_LINE), ("s", 0, 10, 15, "Three", None), ("s", 1, 0, 0, "", K.LAST), ("t", 0, 0, 4, "é😀. ", K.IN_LINE), ("t", 0, 4, 5, "x", K.LAST),
    ]
    assert K.split_lines(lines).count() == 3 and K.split_lines(lines.limit(0), anchors).isEmpty()


def test_anchors_are_checked(rows):
    lines = rows([("s", 0, "One. Two", None)], LINES)
    made = [("s", 0, 5, ". ", "Two"), ("s", 1, 5, ". ", "Two"), ("s", 0, 8, ". ", ""), ("s", 0, 4, "One,", "Two"), ("s", 0, 3, "One", "!"), ("s", 0, 2, "n", "e"), ("s", 0, 2, "n", "e")]
    found = K.anchor_violations(rows(made, "source_id string, line_order long, split_offset int, left_suffix string, right_prefix string"), lines)
    assert {tuple(r)[1:] for r in found.collect()} == {(1, 5, "no such line"), (0, 8, "offset"), (0, 4, "left context"), (0, 3, "right context"), (0, 2, "repeated")}


def _cheapest(texts, order, reasons, hard, target):
    """Every partition of atoms at allowed ends, the cheapest first; of equal ones the one whose last piece starts earliest."""

    def words(a, b):
        whole = {}
        for i in range(a, b + 1):
            whole[order[i]] = whole.get(order[i], "") + texts[i]
        return sum(len(t.split()) for t in whole.values())

    best, last = None, len(texts) - 1
    inner = [i for i in range(last) if reasons[i]]
    for n in range(len(inner) + 1):
        for some in itertools.combinations(inner, n):
            ends = [*some, last]
            sizes = [words(a, b) for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]
            if max(sizes) <= hard:
                cost = (len(ends), sum(reasons[e] == K.IN_LINE for e in ends), sum(abs(target - s) for s in sizes))
                if best is None or cost < best[0]:
                    best = cost, sizes
    return best


@pytest.mark.parametrize("seed", range(3))
def test_partition_against_every_partition(rows, seed):
    import random

    rng = random.Random(seed)
    lines, anchors, whole = [], [], {}
    for s in "abcdef":
        for i in range(rng.randint(1, 5)):
            text = " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 9)))
            lines.append((s, i, text, rng.choice([None, "after_strong_terminal"])))
            whole.setdefault(s, []).append(lines[-1])
            anchors += [(s, i, rng.randint(0, len(text))) for _ in range(rng.randint(0, 2))]
        lines[-1] = (*lines[-1][:3], K.LAST)
    atoms = K.split_lines(rows(lines, LINES), rows(anchors, "source_id string, line_order long, split_offset int"))
    by_source = {}
    for r in atoms.orderBy("source_id", "line_order", "start_char").collect():
        by_source.setdefault(r["source_id"], []).append(r)
    got = {}
    for r in K.partition(atoms, None, 9, 7).orderBy("source_id", "passage_number").collect():
        got.setdefault(r["source_id"], []).append(r)
    counted = K.partition(atoms, lambda: lambda t: len(t.split()), 9, 7)
    assert sorted(map(str, counted.collect())) == sorted(str(r) for p in got.values() for r in p)
    for s, group in by_source.items():
        want = _cheapest([r["text"] for r in group], [r["line_order"] for r in group], [r["reason"] for r in group], 9, 7)
        if want is None:
            assert [r["passage_number"] for r in got[s]] == [None]
            continue
        pieces = got[s]
        assert max(r["tokens"] for r in pieces) <= 9 and (pieces[-1]["last_order"], pieces[-1]["end_char"]) == (group[-1]["line_order"], group[-1]["end_char"])
        assert (len(pieces), sum(r["boundary_after"] == K.IN_LINE for r in pieces), sum(abs(7 - r["tokens"]) for r in pieces)) == want[0]


def test_ends_of_entries(rows):
    lines = rows([("s", i, t, None) for i, t in enumerate(["Title", "[1] A", "b", "[2] C"])], LINES)
    entries = U.reference_entries(lines, F.col("text").startswith("["))
    got = K.entry_ends(K.split_lines(lines), entries).orderBy("line_order").collect()
    assert [(r["entry"], r["reason"]) for r in got] == [(0, None), (1, None), (1, K.ENTRY), (2, K.LAST)]


def test_word_pieces_by_longest_match(rows, tmp_path):
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "risk", "##s", "##y", "a", "##b", "##bc", ".", "un"]
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(pieces) + "\n")

    def by_hand(text):
        out = []
        for word in text.lower().replace(".", " . ").split():
            at, found = 0, []
            while at < len(word):
                n = next((n for n in range(len(word), at, -1) if ("##" if at else "") + word[at:n] in pieces), None)
                if n is None:
                    found = [1]
                    break
                found.append(pieces.index(("##" if at else "") + word[at:n]))
                at = n
            out += found
        return out

    texts = ["Risks risky. ABC ab", "unknown", "", None, "abcb a.b"]
    df = rows([(t,) for t in texts], "t string").select(wordpiece.token_ids(F.col("t"), str(path)).alias("ids"), wordpiece.count_tokens(F.col("t"), str(path), True).alias("n"))
    got = [tuple(r) for r in df.collect()]
    assert [r[0] for r in got] == [None if t is None else by_hand(t) for t in texts]
    assert [r[1] for r in got if r[0] is not None] == [len(r[0]) + 2 for r in got if r[0] is not None]
    lines = rows([("s", 0, "risks risks", "at_blank_paragraph_gap"), ("s", 1, "risks", K.LAST)], LINES)
    assert [r["tokens"] for r in U.partition_passages(lines, wordpiece.counter(str(path)), 4, 4).orderBy("passage_number").collect()] == [4, 2]
    content = path.read_bytes()
    assert C.vocabulary_problems(content, hashlib.sha256(content).hexdigest(), {"[UNK]": 1}, 13) == []
    assert C.vocabulary_problems(content + b"a\n", "0", {"[UNK]": 2, "x": 99}, 13) == ["sha256", "14 pieces, not 13", "a piece is repeated", "[UNK] is not piece 2", "x is not piece 99"]


def test_evidence_is_the_accepted_passage(rows):
    schema = "passage_id string, document_id string, label string, citation_text string"
    passages = rows([("p", "d", "l", "t"), ("q", "d", None, "u")], schema)
    cited = rows([(1, "p", "d", "l", "t"), (2, "p", "e", "l", " "), (2, "p", "d", "l", "t"), (3, "x", "d", "l", "t"), (3, "q", "d", "l", "u"), (4, None, "d", "l", "t")], "case_id int, " + schema)
    got = {tuple(r) for r in C.evidence_violations(cited, passages, rows([(1,), (9,)], "case_id int")).collect()}
    assert got == {(2, "p", "document_id differs"), (2, "p", "citation_text blank"), (2, "p", "cited twice"), (3, "x", "no such passage"), (3, "q", "label differs"), (4, None, "no passage"), (9, None, "no evidence")}


def test_published_baselines(rows, tmp_path):
    assert C.baseline_problems(BASELINE, {"schema_version": "1.0"}) == []
    (tmp_path / "m.json").write_text(json.dumps(BASELINE))
    assert cli.read_model(str(tmp_path / "m.json")).threshold == 0.4
    broken = {"schema_version": "2", "feature_names": [], "training": {**BASELINE["training"], "feature_scales": [0.0] * 5, "coefficients": [float("nan")] * 5, "intercept": True, "selected_threshold": 1.5}}
    assert C.baseline_problems(broken, {"schema_version": "1.0"}) == ["schema_version is not '1.0'", "feature_names", "a scale is not above 0", "training.coefficients", "training.intercept", "the threshold is outside 0..1"]
    with pytest.raises(G.ContractViolation):
        C.model_of(broken)
    assert "no training" in C.baseline_problems({}, {})


def test_files_versions_and_sessions(tmp_path):
    file = tmp_path / "m.onnx"
    file.write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert C.file_problems(file, 3, good) == [] and len(C.file_problems(file, 4, good)) == len(C.file_problems(file, 3, "0")) == len(C.file_problems(tmp_path / "x", 3, good)) == 1
    assert C.version_problems({"a": "1"}, {"a": "1", "b": "2"}) == ["b None, not 2"]
    end = lambda name, kind, shape: SimpleNamespace(name=name, type=kind, shape=shape)
    made = SimpleNamespace(get_providers=lambda: ["cpu"], get_inputs=lambda: [end("ids", "tensor(int64)", ["b", "s"])], get_outputs=lambda: [end("out", "tensor(float)", ["b", "s", 384])])
    wanted = C.Interface(("cpu",), (("ids", "tensor(int64)", 2),), (("out", "tensor(float)", 3),), (384,))
    assert C.session_problems(made, wanted) == [] and C.session_problems(object(), wanted) == ["not an inference session"]
    assert len(C.session_problems(made, C.Interface(("gpu",), (), (), (5,)))) == 4


def test_reports_of_two_annotators(rows):
    schema = "case_id int, annotator_id string, evidence_status string, response_action string, reason_codes array<string>, uncertainty boolean"
    records = rows([(1, "b", "sufficient", "answer", [], False), (1, "a", "insufficient", "abstain", ["x"], True), (2, "a", "insufficient", "abstain", ["x", "y"], False), (2, "b", "insufficient", "abstain", ["y", "x"], False), (3, "a", "sufficient", "answer", [], False)], schema)
    pairs = G.annotator_pairs(records, ("evidence_status", "response_action", "reason_codes", "uncertainty"))
    assert {tuple(r) for r in G.pair_violations(records).collect()} == {(3, "records")}
    report = R.agreement_report(pairs, {"report_id": "r"}).first().asDict(recursive=True)
    assert (report["report_id"], report["annotator_ids"], report["case_count"]) == ("r", ["a", "b"], 2) and report["status_agreement"]["raw_agreement"] == 0.5
    assert [c["code"] for c in report["reason_code_agreement"]["per_code"]] == ["x", "y"] and report["reason_code_agreement"]["exact_match_rate"] == 0.5
    metadata = rows([(1, ["s"], ["e"]), (2, ["s", "t"], ["e"])], "case_id int, question_structure_codes array<string>, evidence_structure_codes array<string>")
    got = R.structure_report(pairs, metadata, {"report_id": "r"}).first().asDict(recursive=True)
    assert [(c["structure_code"], c["case_count"], c["disagreement_case_count"], c["uncertainty_case_count"]) for c in got["question_structure_counts"]] == [("s", 2, 1, 1), ("t", 1, 0, 0)]
    assert got["case_count"] == 2 and got["evidence_structure_counts"][0]["evidence_status_disagreement_count"] == 1


def test_http_service():
    asked = []
    running = server.server(lambda q, n: asked.append((q, n)) or {"action": "abstain", "q": q}, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    base = "http://%s:%d" % running.server_address[:2]

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body), timeout=10) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    post = lambda x: call("/api/query", json.dumps(x).encode())
    try:
        assert call("/")[0] == 200 and json.loads(call("/api/health")[1])["status"] == "ok" and call("/x")[0] == 404 and call("/x", b"{}")[0] == 404
        assert json.loads(post({"question": " é? "})[1])["q"] == "é?" and asked == [("é?", 5)]
        for bad in ({"question": ""}, {"question": "a" * 2001}, {"question": "a", "limit": 0}, {"question": "a", "limit": 11}, {"question": "a", "limit": True}, {}, []):
            assert post(bad)[0] == 400
        assert call("/api/query", b"\xff")[0] == 400 and call("/api/query", b" " * (server.MAX_BODY + 1))[0] == 413 and call("/api/query", b"")[0] == 413
    finally:
        running.shutdown()
        running.server_close()
    with pytest.raises(ValueError):
        server.server(lambda q, n: {}, port=70000)


def test_service_answers_one_question(rows):
    passages = rows([(1, "Risk controls must apply to systems.", "Risk controls must apply to systems.", "A", "leaf", "k")], "passage_id long, text string, citation_text string, label string, unit_kind string, logical_source_key string")
    got = server.asker(passages, C.model_of(BASELINE))("Which risk controls apply?", 5)
    assert got["question"] == "Which risk controls apply?" and got["action"] in ("answer", "abstain") and got["selected_passage_count"] == 1


def test_casefold_is_pythons(rows):
    texts = ["Straße  ΣΑΣ ", "İstanbul", "ŉ ǰ ﬁ Ꭰ", "Plain TEXT", "", None, "ẞ\tÀ"]
    got = [r[0] for r in rows([(t,) for t in texts], "t string").select(T.normalized_question(F.col("t"))).collect()]
    assert got == [None if t is None else " ".join(t.casefold().split()) for t in texts]


def test_counts_order_and_bound_rows(rows):
    cases = rows([("q", "d", "insufficient"), ("q", "d", "sufficient"), ("r", "d", None), ("r", "e", "sufficient"), ("s", None, "insufficient")], "query_id string, document_id string, evidence_status string")
    assert {tuple(r) for r in G.group_counts(cases).collect()} == {("q", "d", 2, 1), ("r", None, 2, 0), ("s", None, 1, 1)}
    stored = hybrid.stored(rows([("q", 1), ("q", 2), ("q", 3)], "query_id string, passage_id int"), rows([(1, 9), (3, 4)], "passage_id int, accepted_order int"))
    assert [r["passage_id"] for r in stored.orderBy("position").collect()] == [3, 1, 2]
    pin = G.binding(cases, ["query_id"]).first()["sha256"]
    assert G.bound(cases, ["query_id"], pin).count() == 5
    with pytest.raises(G.ContractViolation):
        G.bound(cases.limit(4), ["query_id"], pin)


def test_download_is_guarded(tmp_path):
    class Response(io.BytesIO):
        def __init__(self, body, url="https://a.org/x.pdf", **headers):
            super().__init__(body)
            self.url, self.headers = url, {"Content-Type": "application/pdf; charset=x", **headers}

        def geturl(self):
            return self.url

    def get(response, url="https://a.org/x", **how):
        return files.download(url, str(tmp_path / "x.pdf"), ["a.org"], SimpleNamespace(open=lambda u, timeout: response), **how)

    body = b"%PDF-1.7 " + b"x" * 100_000
    for bad in (Response(b"<html>"), Response(b""), Response(body, "https://b.org/x"), Response(body, "http://a.org/x"), Response(body, **{"Content-Length": "99999999"}), Response(body, **{"Content-Type": "text/html"})):
        with pytest.raises(ValueError):
            get(bad)
    with pytest.raises(ValueError):
        get(Response(body), limit=70_000)
    with pytest.raises(ValueError):
        get(Response(body), "https://b.org/x")
    with pytest.raises(ValueError):
        files._Redirects(["a.org"]).redirect_request(urllib.request.Request("https://a.org/x"), None, 302, "", {}, "https://b.org/x")
    assert list(tmp_path.iterdir()) == []
    assert get(Response(body))["sha256"] == hashlib.sha256(body).hexdigest() and (tmp_path / "x.pdf").read_bytes() == body


def test_page_records_from_a_guarded_reader(rows):
    page = lambda t: SimpleNamespace(extract_text=lambda: t)
    reader = lambda content: SimpleNamespace(is_encrypted=content == b"locked", decrypt=lambda password: 0, pages=[page("A\r\nb"), page(None)])
    found = [("d", bytearray(b"open"))]
    pages = files.extract_pages(rows(found, "document_id string, content binary"), files.guarded(reader), "lib", "2")
    documents = rows([("d", *["x"] * len(files.DOCUMENT_FIELDS))], "document_id string, " + ", ".join(f"{c} string" for c in files.DOCUMENT_FIELDS))
    receipts = rows([("d", "d.pdf", "h", "2024-01-01")], "document_id string, filename string, sha256 string, retrieved_date string")
    got = files.page_records(pages, documents, receipts, "c", "1").orderBy("page_number").collect()
    assert len(got[0]) == 27 and [(r["text"], r["is_empty"], r["character_count"], r["source_filename"], r["extractor"]) for r in got] == [("A\nb", False, 3, "d.pdf", "lib"), ("", True, 0, "d.pdf", "lib")]
    with pytest.raises(ValueError, match="encrypted"):
        files.guarded(reader)()(b"locked")

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import lines as L
from tessera.sources import files, jsonl, sinks
from tessera.streaming import questions


def test_jsonl_is_strict(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in jsonl.read_jsonl(spark, str(path), "a int, b string").collect()) == [1, 2]
    with pytest.raises(jsonl.SourceError, match="blank"):
        jsonl.read_jsonl(spark, str(path), "a int, b string", blank_lines=False)
    with pytest.raises(jsonl.SourceError, match="known fields"):
        jsonl.read_jsonl(spark, str(path), "a int")
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(jsonl.SourceError, match="empty"):
        jsonl.read_jsonl(spark, str(tmp_path / "e.jsonl"), "a int", allow_empty=False)
    (tmp_path / "o.json").write_text('{\n "a": 3\n}')
    assert jsonl.read_json_object(spark, str(tmp_path / "o.json"), "a int").first()["a"] == 3


def test_receipts_and_pages(spark, rows, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-one\ftwo\r\nx")
    (folder / "b.pdf").write_bytes(b"nope")
    got = files.read_files(spark, str(folder))
    digest = hashlib.sha256(b"%PDF-one\ftwo\r\nx").hexdigest()
    receipts = rows([("a.pdf", 15, digest), ("b.pdf", 4, hashlib.sha256(b"nope").hexdigest()), ("c.pdf", 1, "")], "filename string, size_bytes long, sha256 string")
    assert {(r[0], r[1]) for r in files.receipt_violations(got, receipts).collect()} == {("b.pdf", "not a PDF"), ("c.pdf", "missing")}

    def extractor():
        return lambda content: content.decode().split("\f")

    pages = files.extract_pages(got.where("filename = 'a.pdf'").withColumn("document_id", F.lit("a")), extractor)
    assert [(r["page_id"], r["text"]) for r in pages.orderBy("page_number").collect()] == [("a:page-0001", "%PDF-one"), ("a:page-0002", "two\nx")]
    assert L.line_table(pages).count() == 3
    assert files.page_totals(pages).where("document_id IS NULL").first()["character_count"] == 13
    html = rows([("<p>a &lt; b</p><script>x</script><b>c</b>",)], "h string").select(files.html_text("h")).first()[0]
    assert html.split() == ["a", "<", "b", "c"]
    fetched = rows([("d", "https://a.org/1", "https://b.org/1", "application/pdf; q=1")], "document_id string, download_url string, resolved_url string, content_type string")
    assert [r["rule"] for r in files.fetch_violations(fetched, ["a.org"]).collect()] == ["host"]


def test_publishing_never_overwrites(spark, rows, tmp_path):
    df, out = rows([(1,), (2,)], "a int"), str(tmp_path / "out" / "x")
    sinks.publish(df, out)
    assert spark.read.json(out).count() == 2
    with pytest.raises(sinks.OutputExists):
        sinks.publish(df, out)
    with pytest.raises(sinks.OutputExists):
        sinks.publish_all(spark, {str(tmp_path / "new"): (df, "json"), out: (df, "json")})
    assert not (tmp_path / "new").exists()
    sinks.publish_object(spark, {"b": "é", "a": 1}, str(tmp_path / "o.json"), sort_keys=True)
    assert (tmp_path / "o.json").read_text() == json.dumps({"b": "é", "a": 1}, indent=2, ensure_ascii=False, sort_keys=True) + "\n"
    with pytest.raises(sinks.OutputExists):
        sinks.publish_object(spark, {}, str(tmp_path / "o.json"))
    sinks.publish_report(df, str(tmp_path / "r"), "Counts", "a")
    assert spark.read.text(str(tmp_path / "r")).count() == 4


def test_stream_of_questions(spark, rows, tmp_path):
    from tessera.operators.sufficiency import Model

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"query_id": 1, "text": "risk"}\n')
    long = "risk " * 40
    passages = rows([(1, long, long, "A", "body", "k")], "passage_id long, text string, citation_text string, label string, unit_kind string, logical_source_key string")
    stream = spark.readStream.schema("query_id long, text string").json(str(tmp_path / "in"))
    q = questions.answer_stream(stream, passages, Model((0.0,) * 5, 9.0, (0.0,) * 5, (1.0,) * 5), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["action"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["answer"]

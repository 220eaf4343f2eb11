"""Queries of cuts within lines and of contracts, over tables with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.checkpoints import cut
from ..operators import atoms as K
from ..operators import blinding as B
from ..operators import chains as H
from ..operators import contracts as C
from ..operators import governance as G
from ..operators import hybrid
from ..operators import hierarchy as Y
from ..operators import splits as X
from ..operators import units as U
from . import adapters as A
from .structure import _FILLED, _LINES, _REASON, _packable

#: Parts of two regions, from a nation's number on.
PARTS = {"1": [(2, "part-1"), (17, "part-2")], "3": [(7, "part-1")]}
STATUSES, CODES = ["sufficient", "insufficient"], ["a", "b", "c"]


def _anchors(spark, sf):
    """After every line's first sentence."""
    at = F.instr("text", ". ") + 1
    rows = _packable(spark, sf).where((F.instr("text", ". ") > 0) & (at < F.length("text")))
    return rows.select("source_id", "line_order", at.alias("split_offset"), "text")


def line_atoms(spark, sf):
    rows = K.split_lines(_packable(spark, sf), _anchors(spark, sf))
    return rows.select("source_id", "line_order", "start_char", "end_char", F.md5("text").alias("text_md5"), "reason")


def atom_partition(spark, sf):
    return K.partition(K.split_lines(_packable(spark, sf), _anchors(spark, sf)))


def anchor_violations(spark, sf):
    """Anchors of which some have moved, lost their line or changed their context."""
    n = F.col("line_order")
    rows = _anchors(spark, sf).withColumn("left_suffix", F.when(n % 5 == 1, "?").otherwise(". ")).withColumn("right_prefix", F.col("text").substr(F.col("split_offset") + 1, F.lit(3)))
    rows = rows.withColumn("split_offset", F.when(n % 7 == 1, 0).otherwise(F.col("split_offset"))).withColumn("line_order", F.when(n % 11 == 1, n + 1_000_000).otherwise(n))
    return K.anchor_violations(rows.withColumn("right_prefix", F.when(n % 3 == 1, "\u0001").otherwise(F.col("right_prefix"))), _packable(spark, sf))


def evidence_fields(spark, sf):
    k, docs = F.col("doc_id"), A.table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    passages = docs.select(k.alias("passage_id"), F.col("source").alias("document_id"), F.col("lang").alias("label"), F.col("text").alias("citation_text"))
    cited = docs.select(
        F.floor(k / 3).alias("case_id"), F.when(k % 13 == 1, -1).when((k % 23 == 2) & (k % 3 != 0), k - 1).otherwise(k).alias("passage_id"),
        F.when(k % 19 == 1, " ").otherwise(F.col("source")).alias("document_id"), F.when(k % 11 == 1, "xx").otherwise(F.col("lang")).alias("label"),
        F.when(k % 17 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("citation_text"),
    )
    cases = docs.select(F.floor(k / 3).alias("case_id")).union(docs.select(-k)).distinct()
    return C.evidence_violations(cited, passages, cases)


def heading_nodes(spark, sf):
    k, rows = F.col("c_custkey"), A.table(spark, sf, "customer").select("c_custkey")
    made, null = k % 7 == 0, F.lit(None).cast("int")
    heading = F.when(made | (k % 11 == 1), F.lit(None)).when(k % 13 == 1, F.format_string("h%d", k - 1)).otherwise(F.format_string("h%d", k))
    nodes = rows.select(
        F.when(k % 31 == 1, "c0").otherwise(F.format_string("c%d", k)).alias("node_id"), F.when(made, "synthetic").when(k % 29 == 1, "other").otherwise("source").alias("node_kind"),
        F.when(k % 19 == 1, 0).otherwise(2).alias("depth"), heading.alias("heading_id"), F.when(made & (k % 17 == 0), F.format_string("p%d", k)).alias("page_id"),
        *[null.alias(c) for c in ("page_number", "start_line_number", "end_line_number")],
    )
    return C.heading_node_violations(nodes, rows.where(~made & (k % 23 != 1)).select(F.format_string("h%d", k).alias("heading_id")))


def _records(spark, sf):
    """Two annotators' records of every customer; some have one, three or twice the same annotator's."""
    k, who = F.col("c_custkey"), F.col("who")
    rows = A.table(spark, sf, "customer").select("c_custkey", F.explode(F.when(k % 17 == 1, F.array(F.lit(1))).when(k % 19 == 1, F.array(F.lit(1), F.lit(2), F.lit(3))).when(k % 23 == 1, F.array(F.lit(2), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("who"))
    bad = (k * who) % 3 == 1
    return rows.select(
        k.alias("case_id"), F.format_string("a%d", who).alias("annotator_id"), F.when(bad, "insufficient").otherwise("sufficient").alias("evidence_status"), F.when(bad & (k % 5 > 0), "abstain").otherwise("answer").alias("response_action"),
        F.when(bad, F.array(F.lit("a"), F.when(k % 2 == 0, "b").otherwise("c"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"), ((k + who) % 10 == 0).alias("uncertainty"),
    )


def _log(spark, sf):
    """Events as a chain for each user, with a record lost, changed, slipped in beside another, or twice."""
    e = F.col("event_id")
    rows = A.table(spark, sf, "events").select("user_id", "event_id", F.format_string("%d|%s", e, F.col("event_type")).alias("content"))
    log = cut(H.seal(rows, "user_id", ["event_id"], "content"))  # read three times
    n = F.split_part("content", F.lit("|"), F.lit(1)).cast("long")
    changed = log.where(n % 101 != 7).withColumn("content", F.when(n % 103 == 11, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    beside = log.where(n % 107 == 13).withColumn("content", F.concat("content", F.lit("?")))
    beside = beside.withColumn("hash", H.record_hash(F.col("user_id"), F.col("place"), F.col("previous_hash"), F.col("content")))
    return changed.union(beside).union(log.where((n % 109 == 17) & (n % 101 != 7) & (n % 103 != 11)))


def log_violations(spark, sf):
    return H.chain_violations(_log(spark, sf), "user_id").withColumnRenamed("chain", "user_id")


def _round(spark, sf):
    """Customers as annotators of a round for each nation, orders of their steps, with faults."""
    k, s = F.col("c_custkey"), F.col("step")
    who = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("round_id"), F.col("c_custkey").alias("annotator_id"), T.sha256(F.concat(F.lit("batch"), F.col("c_nationkey").cast("string"))).alias("batch_sha256"), "c_custkey")
    rows = who.select("round_id", "annotator_id", "batch_sha256", "c_custkey", F.posexplode(F.array(*map(F.lit, H.STEPS))).alias("i", "step"))
    own = lambda i: T.sha256(F.concat_ws(":", k, i))
    rows = rows.where(~((k % 11 == 1) & (s == "receipt")))
    events = rows.select(
        "round_id", (k + F.when((k % 23 == 1) & (s == "assignment"), 10_000_000).otherwise(0)).alias("annotator_id"), "step", (F.col("i") * 10 - F.when((k % 13 == 1) & (s == "submission"), 15).otherwise(0)).alias("at"),
        F.when((k % 17 == 1) & (s == "attestation"), "x").otherwise(F.col("batch_sha256")).alias("batch_sha256"), own(F.col("i") - F.when((k % 19 == 1) & (s == "submission"), 2).otherwise(1)).alias("subject_sha256"),
        own(F.col("i")).alias("own_sha256"), ((s == "attestation") & (k % 7 != 1)).alias("independent"), "c_custkey",
    )
    events = events.union(events.where((k % 29 == 1) & (s == "submission")))
    return events.drop("c_custkey"), who.select("round_id", "annotator_id", "batch_sha256")


def round_completion(spark, sf):
    return H.completion_violations(*_round(spark, sf))


def _batches(spark, sf):
    """Conversations as records with their turns nested in them; some turns carry what annotators must not see."""
    c, t = F.col("conv_id"), F.col("turn")
    reviewer = F.when((c + t) % 9 == 1, F.concat(F.lit(',"reviewer_id":'), t.cast("string"))).otherwise("")
    note = F.when((c + t) % 14 == 2, ',"notes":[{"Silver_Label":"x"},{"n":1}]').otherwise("")
    one = F.concat(F.lit('{"turn":'), t.cast("string"), F.lit(',"role":"'), F.col("role"), F.lit('"'), reviewer, note, F.lit("}"))
    rows = A.table(spark, sf, "conversations").groupBy(c.alias("case_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", one.alias("j")))), lambda x: x["j"]), ",").alias("turns"))
    split = F.when(F.col("case_id") % 12 == 3, '"split_name":"test",').otherwise("")
    return rows.select("case_id", F.when(F.col("case_id") % 40 == 7, "{broken").otherwise(F.concat(F.lit("{"), split, F.lit('"case":{"evidence":['), "turns", F.lit("]}}"))).alias("record"))


def split_manifests(spark, sf):
    """Nations as datasets whose customers are split by segment; manifests and assignments with faults."""
    n, k = F.col("dataset_id"), F.col("case_id")
    part = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) for x in (v, i)]), F.col("component"))
    rows = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset_id"), F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("component"))
    rows = rows.withColumn("split_name", F.when(part % 3 == 0, "development").when(part % 3 == 1, "validation").otherwise("test"))
    datasets = rows.select("dataset_id").distinct().withColumn("dataset_sha256", T.sha256(n.cast("string")))
    found = X.manifests(rows, datasets).where(n % 13 != 4)
    found = found.select(
        n, F.when(n % 11 == 1, "x").otherwise(F.col("dataset_sha256")).alias("dataset_sha256"), F.when(n % 8 == 5, "0.9").otherwise(F.col("algorithm_version")).alias("algorithm_version"), (F.col("component_count") + F.when(n % 7 == 1, 1).otherwise(0)).alias("component_count"),
        F.when(n % 6 == 2, F.map_filter("split_case_counts", lambda s, _: s != "test")).when(n % 5 == 1, F.transform_values("split_case_counts", lambda s, c: c + F.when(s == "test", 1).otherwise(0))).otherwise(F.col("split_case_counts")).alias("split_case_counts"), "assignments_sha256",
    )
    found = found.union(found.where(n % 10 == 8)).union(found.where(n == 0).withColumn("dataset_id", F.lit(-1).cast(dict(found.dtypes)["dataset_id"])))
    first = rows.groupBy("dataset_id").agg(F.min("case_id").alias("first"))
    moved = rows.join(first, "dataset_id").withColumn("split_name", F.when((n % 9 == 3) & (k == F.col("first")), F.lit(None)).otherwise(F.col("split_name"))).drop("first")
    again = rows.join(first, "dataset_id").where((n % 12 == 7) & (k == F.col("first"))).withColumn("split_name", F.when(F.col("split_name") == "test", "development").otherwise("test")).drop("first")
    return X.violations(found, moved.unionByName(again), datasets)


FORBIDDEN = ("reviewer_id", "silver_label", "split_name")


def blinding_leaks(spark, sf):
    return B.leaks(_batches(spark, sf), "record", FORBIDDEN)


FIELDS = ("evidence_status", "response_action", "reason_codes", "uncertainty")


def annotator_pairs(spark, sf):
    pairs = G.annotator_pairs(_records(spark, sf), FIELDS)
    return pairs.select(*[F.array_join(c, ",").alias(c) if c.endswith("codes") else F.col(c) for c in pairs.columns])


def pair_violations(spark, sf):
    return G.pair_violations(_records(spark, sf))


def _metadata(spark, sf):
    rows = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    k = F.col("case_id")
    return rows.select("case_id", F.when(k % 3 == 0, F.array(F.lit("a"))).when(k % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("c"), F.lit("c"))).alias("question_structure_codes"))


def structure_counts(spark, sf):
    return G.structure_counts(G.annotator_pairs(_records(spark, sf), FIELDS), _metadata(spark, sf), "question_structure_codes")


def analysis_metadata(spark, sf):
    k, rows = F.col("case_id"), _metadata(spark, sf)
    faulty = rows.withColumn("question_structure_codes", F.when(k % 7 == 1, F.array().cast("array<string>")).when(k % 11 == 1, F.array(F.lit("z"))).otherwise(F.col("question_structure_codes")))
    faulty = faulty.where("case_id % 13 <> 1").withColumn("case_id", F.when(k % 17 == 1, -k).otherwise(k))
    return C.metadata_violations(faulty.union(faulty.where("case_id % 19 = 1")), rows, {"question_structure_codes": CODES})


def source_spans(spark, sf):
    k = F.col("n_nationkey")
    rows = A.table(spark, sf, "nation").select(k.alias("node_id"), F.col("n_regionkey").alias("document_id"), F.when(k % 3 == 0, "synthetic").otherwise("source").alias("node_kind"))
    return Y.source_spans(rows, 1)


def structural_context(spark, sf):
    context = U.structural_context(F.col("n_regionkey").cast("string"), F.col("n_nationkey"), PARTS)
    return A.table(spark, sf, "nation").select("n_nationkey", F.array_join(context, ",").alias("context"))


def group_counts(spark, sf):
    """Documents as cases of their language; some have no source."""
    rows = A.table(spark, sf, "documents")
    k = F.col("doc_id")
    source = F.when(k % 97 != 1, F.col("source"))
    return G.group_counts(rows.select(F.concat_ws(":", "lang", "source", (k % 50).cast("string")).alias("query_id"), source.alias("document_id"), F.when(k % 3 == 0, "insufficient").otherwise("sufficient").alias("evidence_status")))


def storage_order(spark, sf):
    """Customers as candidates of their nation, stored by their names from the end."""
    rows = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("passage_id"))
    return hybrid.stored(rows, rows.where("passage_id % 7 <> 1").select("passage_id", F.pmod(-F.col("passage_id"), F.lit(100)).alias("accepted_order")))


QUERIES = {
    f.__name__: f
    for f in (group_counts, storage_order, line_atoms, atom_partition, anchor_violations, evidence_fields, heading_nodes, annotator_pairs, pair_violations, structure_counts, analysis_metadata, source_spans, structural_context,
              log_violations, round_completion, blinding_leaks, split_manifests)
}

_PACKABLE = f"""{_LINES}, f AS (SELECT document_id, line_pos, text, lead(text) OVER w AS next_text, coalesce(lead(line_pos) OVER w - line_pos > 1, false) AS gap FROM l {_FILLED} WINDOW w AS (PARTITION BY document_id ORDER BY line_pos)),
r AS (SELECT CAST(document_id AS VARCHAR) AS source_id, line_pos AS line_order, text, length(text) AS n, strpos(text, '. ') + 1 AS place, strpos(text, '. ') > 0 AND strpos(text, '. ') + 1 < length(text) AS cut, {_REASON} AS reason FROM f)"""
_RECORDS = """u AS (SELECT c_custkey AS k, unnest(CASE WHEN c_custkey % 17 = 1 THEN [1] WHEN c_custkey % 19 = 1 THEN [1, 2, 3] WHEN c_custkey % 23 = 1 THEN [2, 2] ELSE [1, 2] END) AS who FROM customer),
v AS (SELECT *, (k * who) % 3 = 1 AS bad FROM u),
rec AS (SELECT k AS case_id, 'a' || who AS annotator_id, CASE WHEN bad THEN 'insufficient' ELSE 'sufficient' END AS evidence_status, CASE WHEN bad AND k % 5 > 0 THEN 'abstain' ELSE 'answer' END AS response_action,
  CASE WHEN bad THEN CASE WHEN k % 2 = 0 THEN 'a,b' ELSE 'a,c' END ELSE '' END AS reason_codes, (k + who) % 10 = 0 AS uncertainty FROM v),
ok AS (SELECT case_id FROM rec GROUP BY case_id HAVING count(*) = 2 AND count(DISTINCT annotator_id) = 2),
pr AS (SELECT a.case_id, """ + ", ".join(f"{s}.{c} AS {n}_{c}" for s, n in (("a", "first"), ("b", "second")) for c in ("annotator_id", *FIELDS)) + """ FROM ok JOIN rec a USING (case_id) JOIN rec b ON b.case_id = a.case_id AND a.annotator_id < b.annotator_id)"""
_METADATA = "m AS (SELECT c_custkey AS case_id, CASE c_custkey % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['b', 'a'] ELSE ['c', 'c'] END AS codes FROM customer)"
_DIFFER = {c: f"first_{c} <> second_{c}" for c in FIELDS[:3]}
_ANY, _UNSURE = "(" + " OR ".join(_DIFFER.values()) + ")", "(first_uncertainty OR second_uncertainty)"

ORACLE = {
    "group_counts": """SELECT lang || ':' || source || ':' || (doc_id % 50) AS query_id, CASE WHEN count(*) FILTER (doc_id % 97 <> 1) = count(*) THEN min(source) END AS document_id, count(*) AS case_count, count(*) FILTER (doc_id % 3 = 0) AS insufficient_count FROM documents GROUP BY 1""",
    "storage_order": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY accepted_order NULLS LAST, passage_id) AS position FROM (SELECT c_nationkey AS query_id, c_custkey AS passage_id, CASE WHEN c_custkey % 7 <> 1 THEN (100 - c_custkey % 100) % 100 END AS accepted_order FROM customer)""",
    "line_atoms": f"""WITH {_PACKABLE} SELECT source_id, line_order, 0 AS start_char, CASE WHEN cut THEN place ELSE n END AS end_char, md5(CASE WHEN cut THEN text[1:place] ELSE text END) AS text_md5, CASE WHEN cut THEN 'after_sentence_in_line' ELSE reason END AS reason FROM r
UNION ALL SELECT source_id, line_order, place, n, md5(text[place + 1:]), reason FROM r WHERE cut""",
    "anchor_violations": f"""WITH {_PACKABLE}, c AS (SELECT source_id, CASE WHEN line_order % 11 = 1 THEN line_order + 1000000 ELSE line_order END AS line_order, CASE WHEN line_order % 7 = 1 THEN 0 ELSE place END AS split_offset, line_order AS o FROM r WHERE cut)
SELECT source_id, line_order, split_offset, CASE WHEN o % 11 = 1 THEN 'no such line' WHEN o % 7 = 1 THEN 'offset' WHEN o % 5 = 1 THEN 'left context' ELSE 'right context' END AS rule FROM c WHERE o % 11 = 1 OR o % 7 = 1 OR o % 5 = 1 OR o % 3 = 1""",
    "evidence_fields": r"""WITH e AS (SELECT doc_id // 3 AS case_id, CASE WHEN doc_id % 13 = 1 THEN -1 WHEN doc_id % 23 = 2 AND doc_id % 3 <> 0 THEN doc_id - 1 ELSE doc_id END AS passage_id, CASE WHEN doc_id % 19 = 1 THEN ' ' ELSE source END AS d, CASE WHEN doc_id % 11 = 1 THEN 'xx' ELSE lang END AS l,
  CASE WHEN doc_id % 17 = 1 THEN text || '.' ELSE text END AS t FROM documents),
j AS (SELECT e.*, p.doc_id AS p, p.source, p.lang, p.text FROM e LEFT JOIN documents p ON p.doc_id = e.passage_id),
x AS (SELECT case_id, passage_id, CASE WHEN p IS NULL THEN 'no such passage' END AS rule FROM j
UNION ALL SELECT case_id, passage_id, CASE WHEN d IS NULL OR regexp_matches(d, '^\s*$') THEN 'document_id blank' WHEN p IS NOT NULL AND d IS DISTINCT FROM source THEN 'document_id differs' END FROM j
UNION ALL SELECT case_id, passage_id, CASE WHEN l IS NULL OR regexp_matches(l, '^\s*$') THEN 'label blank' WHEN p IS NOT NULL AND l IS DISTINCT FROM lang THEN 'label differs' END FROM j
UNION ALL SELECT case_id, passage_id, CASE WHEN t IS NULL OR regexp_matches(t, '^\s*$') THEN 'citation_text blank' WHEN p IS NOT NULL AND t IS DISTINCT FROM text THEN 'citation_text differs' END FROM j
UNION ALL SELECT case_id, passage_id, 'cited twice' FROM e GROUP BY case_id, passage_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT -doc_id, CAST(NULL AS BIGINT), 'no evidence' FROM documents WHERE -doc_id NOT IN (SELECT case_id FROM e))
SELECT * FROM x WHERE rule IS NOT NULL""",
    "heading_nodes": """WITH n AS (SELECT CASE WHEN c_custkey % 31 = 1 THEN 'c0' ELSE 'c' || c_custkey END AS id, CASE WHEN c_custkey % 7 = 0 THEN 'synthetic' WHEN c_custkey % 29 = 1 THEN 'other' ELSE 'source' END AS kind, c_custkey % 19 = 1 AS shallow,
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 1 THEN NULL WHEN c_custkey % 13 = 1 THEN 'h' || (c_custkey - 1) ELSE 'h' || c_custkey END AS h, c_custkey % 119 = 0 AS page FROM customer),
h AS (SELECT 'h' || c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 23 <> 1), s AS (SELECT h AS id, count(*) AS c FROM n WHERE kind = 'source' AND h IS NOT NULL GROUP BY h)
SELECT id, 'kind' AS rule FROM n WHERE kind = 'other' UNION ALL SELECT id, 'depth' FROM n WHERE shallow UNION ALL SELECT id, 'no heading' FROM n WHERE kind = 'source' AND h IS NULL UNION ALL SELECT id, 'synthetic with page_id' FROM n WHERE page
UNION ALL SELECT id, 'heading without node' FROM h WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, 'no such heading' FROM s WHERE id NOT IN (SELECT id FROM h) UNION ALL SELECT id, 'heading of several nodes' FROM s WHERE c > 1
UNION ALL SELECT id, 'node repeated' FROM n GROUP BY id HAVING count(*) > 1""",
    "annotator_pairs": f"WITH {_RECORDS} SELECT * FROM pr",
    "pair_violations": f"WITH {_RECORDS} SELECT case_id, CASE WHEN count(*) <> 2 THEN 'records' ELSE 'one annotator' END AS rule FROM rec GROUP BY case_id HAVING count(*) <> 2 OR count(DISTINCT annotator_id) = 1",
    "structure_counts": f"""WITH {_RECORDS}, {_METADATA}, c AS (SELECT DISTINCT case_id, unnest(codes) AS structure_code FROM m)
SELECT structure_code, count(*) AS case_count, count(*) FILTER ({_ANY}) AS disagreement_case_count, count(*) FILTER ({_UNSURE}) AS uncertainty_case_count, count(*) FILTER ({_ANY} OR {_UNSURE}) AS requires_adjudication_count,
  count(*) FILTER ({_DIFFER["evidence_status"]}) AS evidence_status_disagreement_count, count(*) FILTER ({_DIFFER["response_action"]}) AS response_action_disagreement_count, count(*) FILTER ({_DIFFER["reason_codes"]}) AS reason_codes_disagreement_count
FROM pr JOIN c USING (case_id) GROUP BY structure_code""",
    "analysis_metadata": f"""WITH {_METADATA}, f AS (SELECT CASE WHEN case_id % 17 = 1 THEN -case_id ELSE case_id END AS case_id, CASE WHEN case_id % 7 = 1 THEN [] WHEN case_id % 11 = 1 THEN ['z'] ELSE codes END AS codes FROM m WHERE case_id % 13 <> 1),
a AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE case_id % 19 = 1)
SELECT case_id, 'question_structure_codes empty' AS rule FROM a WHERE len(codes) = 0 UNION ALL SELECT case_id, 'question_structure_codes unknown' FROM a WHERE list_contains(codes, 'z')
UNION ALL SELECT case_id, 'question_structure_codes repeated' FROM a WHERE len(list_distinct(codes)) < len(codes) UNION ALL SELECT case_id, 'no such case' FROM a WHERE case_id NOT IN (SELECT case_id FROM m)
UNION ALL SELECT case_id, 'missing' FROM m WHERE case_id NOT IN (SELECT case_id FROM a) UNION ALL SELECT case_id, 'repeated' FROM a GROUP BY case_id HAVING count(*) > 1""",
    "source_spans": "SELECT n_nationkey AS node_id, n_regionkey AS document_id, 'source' AS node_kind FROM nation WHERE n_regionkey = 1 AND n_nationkey % 3 <> 0",
    "structural_context": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 AND n_nationkey >= 17 THEN 'part-2' WHEN n_regionkey = 1 AND n_nationkey >= 2 OR n_regionkey = 3 AND n_nationkey >= 7 THEN 'part-1' ELSE '' END AS context FROM nation",
    "log_violations": """WITH RECURSIVE e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, event_id AS n, event_id || '|' || event_type AS c FROM events),
h AS (SELECT u, p, n, c, repeat('0', 64) AS prev, sha256(u || chr(31) || p || chr(31) || repeat('0', 64) || chr(31) || c) AS hash FROM e WHERE p = 0
  UNION ALL SELECT e.u, e.p, e.n, e.c, h.hash, sha256(e.u || chr(31) || e.p || chr(31) || h.hash || chr(31) || e.c) FROM h JOIN e ON e.u = h.u AND e.p = h.p + 1),
g AS (SELECT u, p, prev, hash FROM h WHERE n % 101 <> 7 UNION ALL SELECT u, p, prev, sha256(u || chr(31) || p || chr(31) || prev || chr(31) || c || '?') FROM h WHERE n % 107 = 13
  UNION ALL SELECT u, p, prev, hash FROM h WHERE n % 109 = 17 AND n % 101 <> 7 AND n % 103 <> 11),
o AS MATERIALIZED (SELECT *, count(*) AS k FROM g GROUP BY ALL)
SELECT u AS user_id, p AS place, 'content' AS rule FROM h WHERE n % 101 <> 7 AND n % 103 = 11 UNION ALL SELECT u, p, 'repeated' FROM o WHERE k > 1
UNION ALL SELECT u, p, 'gap' FROM o WHERE prev <> repeat('0', 64) AND NOT EXISTS (SELECT 1 FROM o x WHERE x.u = o.u AND x.hash = o.prev)
UNION ALL SELECT u, p, 'fork' FROM (SELECT *, count(*) OVER (PARTITION BY u, prev) AS heirs FROM o) WHERE heirs > 1""",
    "round_completion": """WITH k AS (SELECT c_nationkey AS round_id, c_custkey AS annotator_id, c_custkey AS k FROM customer), v AS (SELECT round_id, annotator_id + CASE r WHEN 'unexpected' THEN 10000000 ELSE 0 END AS annotator_id, r AS rule FROM (
  SELECT *, unnest(['missing', 'unexpected', 'repeated', 'order', 'batch', 'binding', 'attestation']) AS r FROM k)
  WHERE CASE r WHEN 'missing' THEN k % 11 = 1 OR k % 23 = 1 WHEN 'unexpected' THEN k % 23 = 1 WHEN 'repeated' THEN k % 29 = 1 WHEN 'order' THEN k % 13 = 1 AND k % 23 <> 1 WHEN 'batch' THEN k % 17 = 1
    WHEN 'binding' THEN k % 19 = 1 AND k % 23 <> 1 ELSE k % 7 = 1 END) SELECT * FROM v""",
    "blinding_leaks": """WITH t AS (SELECT conv_id AS c, turn, '{"turn":' || turn || ',"role":"' || role || '"' || CASE WHEN (conv_id + turn) % 9 = 1 THEN ',"reviewer_id":' || turn ELSE '' END
  || CASE WHEN (conv_id + turn) % 14 = 2 THEN ',"notes":[{"Silver_Label":"x"},{"n":1}]' ELSE '' END || '}' AS j FROM conversations),
r AS (SELECT c, c % 40 = 7 AS broken, '{' || CASE WHEN c % 12 = 3 THEN '"split_name":"test",' ELSE '' END || '"case":{"evidence":[' || string_agg(j, ',' ORDER BY turn) || ']}}' AS record FROM t GROUP BY c)
SELECT c AS case_id, fullkey AS path FROM r, json_tree(r.record) AS x WHERE NOT broken AND lower(x.key) IN ('reviewer_id', 'silver_label', 'split_name') UNION ALL SELECT c, '$' FROM r WHERE broken""",
    "split_manifests": """WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, c_mktsegment AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
d AS (SELECT n, count(DISTINCT s) AS parts, count(*) FILTER (s IN ('AUTOMOBILE', 'HOUSEHOLD')) AS dev, count(*) FILTER (s IN ('BUILDING', 'MACHINERY')) AS val, count(*) FILTER (s = 'FURNITURE') AS test FROM c GROUP BY n),
v AS (SELECT n, unnest(['no manifest', 'repeated', 'dataset_sha256', 'algorithm_version', 'component_count', 'split names', 'split counts', 'assignments', 'case in several splits', 'case without split', 'component crosses splits']) AS rule,
  dev > 0 AND val > 0 AND test > 0 AS whole FROM d)
SELECT n AS dataset_id, rule FROM v WHERE CASE rule WHEN 'no manifest' THEN n % 13 = 4 WHEN 'repeated' THEN n % 10 = 8 AND n % 13 <> 4 WHEN 'dataset_sha256' THEN n % 11 = 1 AND n % 13 <> 4 WHEN 'algorithm_version' THEN n % 8 = 5 AND n % 13 <> 4
  WHEN 'component_count' THEN n % 7 = 1 AND n % 13 <> 4 WHEN 'split names' THEN (n % 6 = 2 OR NOT whole) AND n % 13 <> 4 WHEN 'split counts' THEN whole AND n % 6 <> 2 AND (n % 5 = 1 OR n % 9 = 3 OR n % 12 = 7) AND n % 13 <> 4
  WHEN 'assignments' THEN (n % 9 = 3 OR n % 12 = 7) AND n % 13 <> 4 WHEN 'case in several splits' THEN n % 12 = 7 AND n % 9 <> 3 WHEN 'case without split' THEN n % 9 = 3 AND n % 12 <> 7 ELSE n % 12 = 7 END
UNION ALL SELECT -1, 'no dataset'""",
}

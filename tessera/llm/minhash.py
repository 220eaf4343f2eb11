"""Operator 1: near-duplicates by circulant MinHash.

A document is the set of its distinct word shingles, as 64-bit hashes. Two
permutations of the 32-bit numbers give the whole signature: the first places
each shingle, and the k-th coordinate is the least value that the second
permutation takes on the places shifted circularly by k. Bands of coordinates
name buckets; documents that share one are candidates, and a link needs the
exact Jaccard similarity of the full sets.

Large groups never become all pairs. Equal sets are one class from the start.
In a bucket a pivot is compared with every member of another component, links
merge components, and the pivot retires, for everything in the bucket has met
it. Buckets whose members are all in one component are done. The members of
the others are dealt anew, by shingles: two sets can only be linked if they
share one of their first few in an order that is the same for all, and the
order puts rare shingles first, so texts that merely share a frequent passage
part. Where the first shared shingle stands in both bounds what they can share
at all, and pairs below the needed overlap are left. Among the others the same
goes on, with eight times as many pivots each round. So no
pair of different components that could be linked is left out, and a group of
near-copies costs about as many comparisons as it has members.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: At a Jaccard similarity of 0.8, 50 bands of 7 miss a pair with probability 8e-6.
BANDS, ROWS = 50, 7
WIDTH, PERCENT = 5, 80
#: Words whose hashes one Python worker keeps.
MAX_CACHED_WORDS = 150_000
#: Pivots of the first round, and their growth from round to round.
PIVOTS, PIVOT_GROWTH = 1, 8
#: Parts of a bucket whose pivots are chosen apart first.
SALTS = 16
#: Counters of shingles, by hash, that tell rare from frequent; their number is fixed.
SLOTS = 1 << 20
#: Places of a signature that are shifted together; bounds memory for long texts.
CHUNK = 2048

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_M3, _M4 = np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
KEY_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


class _WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __init__(self, _key: str = "") -> None:
        pass

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z are lower-cased.

    A text with fewer words than ``width`` has its whole sequence as one
    shingle; one without words, or null, has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(common.kept("minhash", "", _WordHashes).__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, np.uint64(k)) * _M4
    for j in range(k):
        total = _mix(total + h[j : len(words) - k + 1 + j] * _M1)
    return np.unique(total)


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=t)
    x ^= t
    x *= np.uint32(0xC2B2AE35)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signature(found: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a set that isn't empty."""
    places = (_mix(found ^ _M4) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), CHUNK):
        np.minimum(out, _permute(places[None, at : at + CHUNK] + shifts).min(axis=1), out=out)
    return out


def _keys(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _M1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sizes, a, b, flat, ends = [], [], [], [], [0]
                for text in part.column(1):
                    found = shingles(text.as_py(), width)
                    sizes.append(len(found))
                    a.append(int(_mix(found ^ _M1).sum().view(np.int64)) if len(found) else 0)
                    b.append(int(_mix(found ^ _M3).sum().view(np.int64)) if len(found) else 0)
                    if len(found):
                        sig = signature(found, bands * rows).reshape(bands, rows).astype(np.uint64)
                        acc = salt.copy()
                        for r in range(rows):
                            acc = _mix(acc * _M1 + sig[:, r])
                        flat.append(acc.view(np.int64))
                    ends.append(ends[-1] + (bands if len(found) else 0))
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                columns = [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), listed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(doc: int, text: bytes) -> np.ndarray:
            if doc in recent:
                recent.move_to_end(doc)
            else:
                recent[doc] = shingles(text, width)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[doc]

        for batch in batches:
            left, right, linked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                x, y = of(a, batch.column(2)[i].as_py()), of(b, batch.column(3)[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _slots(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (shingles(text.as_py(), width) % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["slot", "n"])

    return run


def _first_shingles(shared, width: int, percent: int):
    """Of each text the ``n - ceil(percent * n / 100) + 1`` rarest shingles, one of which any linked text shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, size, found, place = [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), width)
                order = np.lexsort((s, shared.value[(s % np.uint64(SLOTS)).astype(np.int64)]))
                first = s[order[: len(s) + (-percent * len(s) // 100) + 1]]
                doc.append(np.full(len(first), d, np.int64))
                size.append(np.full(len(first), len(s), np.int64))
                found.append(first.view(np.int64))
                place.append(np.arange(len(first)))
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, doc, size, place)], ["bucket", "doc_id", "n", "place"])

    return run


def _deal_by_shingles(live: DataFrame, texts: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """The documents of ``live`` in new buckets, one for each shingle that several of them have among their first."""
    docs = common.materialize(texts.join(common.maybe_broadcast(live.select("doc_id").distinct()), "doc_id", "left_semi"), "minhash-texts")
    counts = np.zeros(SLOTS, np.int64)
    found = docs.select("text").mapInArrow(common.frugal(_slots(width)), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    del found
    shared = live.sparkSession.sparkContext.broadcast(counts)
    found = common.materialize(docs.select("doc_id", "text").mapInArrow(common.frugal(_first_shingles(shared, width, percent)), "bucket long, doc_id long, n long, place long"), "minhash-first")
    several = common.materialize(found.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "minhash-buckets")
    found = found.join(several, "bucket").join(labels, "doc_id")
    return common.materialize(found.select("bucket", "doc_id", "n", "place", "comp", "size"), "minhash-live")


def merge(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's least.

    Every node points to its least neighbour, pointers are contracted, and
    what remains of the edges goes on; the nodes at least halve each time.
    """
    edges, roots = common.materialize(edges.where("a <> b").distinct(), "edges"), None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).where("low < node")
        point = common.materialize(point, "pointers")
        if roots is None:
            roots = point.select("node", F.col("low").alias("root"))
        else:
            moved = roots.join(point.select(F.col("node").alias("root"), "low"), "root", "left").select("node", F.coalesce("low", "root").alias("root"))
            fresh = point.join(roots.select("node"), "node", "left_anti").select("node", F.col("low").alias("root"))
            roots = common.materialize(moved.union(fresh), "roots")
        to = lambda c: point.select(F.col("node").alias(c), F.col("low").alias(f"{c}_low"))
        edges = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
        edges = edges.select(F.coalesce("a_low", "a").alias("a"), F.coalesce("b_low", "b").alias("b")).where("a <> b").distinct()
        edges = common.materialize(edges, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def _relabel(rows: DataFrame, roots: DataFrame) -> DataFrame:
    moved = rows.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left")
    return moved.withColumn("comp", F.coalesce("root", "comp")).select(*rows.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * |A n B| >= percent * |A u B|``;
    ``component_id`` is the least id reachable over links. Null, empty and
    wordless texts have no shingles and link with nothing. Sets count as equal
    if their sizes and two sums of 64-bit hashes agree. Rows that share an id
    count as one document with the least of their texts; a null id is alone.
    An empty table gives no row.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    keys = common.materialize(source.mapInArrow(common.frugal(_keys(width, bands, rows)), KEY_SCHEMA), "minhash-keys")
    if not keys.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        one = common.materialize(source.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")).union(source.where("doc_id IS NULL")), "minhash-one")
        found = near_duplicates(one, width=width, percent=percent, bands=bands, rows=rows)
        again = keys.where("doc_id IS NOT NULL").select("doc_id").join(found.where("doc_id IS NOT NULL"), "doc_id")
        return again.union(found.where("doc_id IS NULL"))
    full = keys.where("n_shingles > 0 AND doc_id IS NOT NULL")
    group = ["set_a", "set_b", "n_shingles"]
    classes = common.materialize(full.groupBy(*group).agg(F.min("doc_id").alias("class_id")), "minhash-classes")
    heads = full.join(classes.withColumnRenamed("class_id", "doc_id"), [*group, "doc_id"], "left_semi")
    slots = heads.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = common.materialize(slots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "minhash-buckets")
    live = common.materialize(slots.join(shared, "bucket").select("bucket", "doc_id", F.col("n_shingles").alias("n"), F.lit(0).cast("long").alias("place"), F.col("doc_id").alias("comp"), "size"), "minhash-live")
    labels = common.materialize(live.select("doc_id", "comp").distinct(), "minhash-labels")
    texts = common.materialize(source.join(common.maybe_broadcast(labels.select("doc_id")), "doc_id", "left_semi"), "minhash-texts")
    failed, pivots, turn = None, PIVOTS, 0
    while True:
        # the pivot of a round with one comes with the bucket it is open in, so rows meet both at once
        one = pivots == 1
        first = [F.min(F.struct(F.col("doc_id").alias("id"), "n", "place", "comp")).alias("p")] if one else []
        open_ = live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("size"), F.count("*").alias("now"), *first).where("lo < hi")
        open_ = common.materialize(open_.select("bucket", "size", "now", *([F.col(f"p.{c}").alias(f"p_{c}") for c in ("id", "n", "place", "comp")] if one else [])), "minhash-open")
        if open_.isEmpty():
            break
        live = common.join_parts(live, open_, "bucket", "size").withColumn("size", F.col("now")).drop("now")
        live = common.materialize(live, "minhash-live")
        turn += 1
        if turn == 2:
            live, pivots = _deal_by_shingles(live, texts, labels, width, percent), PIVOTS
            continue
        met = live
        if not one:
            # first within parts of a bucket, so no task holds a large one
            within = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id"))
            chosen = live.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("rank", within).where(F.col("rank") <= pivots)
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))
            chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= pivots)
            chosen = common.materialize(chosen.select("bucket", "size", F.col("doc_id").alias("p_id"), F.col("n").alias("p_n"), F.col("place").alias("p_place"), F.col("comp").alias("p_comp")), "minhash-pivots")
            met = common.join_parts(live, chosen, "bucket", "size")
        near = (F.col("comp") != F.col("p_comp")) & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n"))
        near = near & ((100 + percent) * F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place")) >= percent * (F.col("n") + F.col("p_n")))
        pairs = met.where(near).select(F.least("doc_id", "p_id").alias("a"), F.greatest("doc_id", "p_id").alias("b")).distinct()
        if failed is not None:
            pairs = pairs.join(failed, ["a", "b"], "left_anti")
        pairs = common.materialize(pairs, "minhash-pairs")
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        judged = common.materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(common.frugal(_confirm(width, percent)), "a long, b long, linked boolean"), "minhash-judged")
        missed = judged.where(~F.col("linked")).select("a", "b")
        failed = missed if failed is None else failed.union(missed)
        comp = lambda c: labels.select(F.col("doc_id").alias(c), F.col("comp").alias(f"{c}_comp"))
        links = judged.where("linked").join(comp("a"), "a").join(comp("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        roots = merge(links)
        labels = common.materialize(_relabel(labels, roots), "minhash-labels")
        if one:
            left = live.where("doc_id <> p_id").drop("p_id", "p_n", "p_place", "p_comp")
        else:
            left = live.join(common.maybe_broadcast(chosen.select("bucket", F.col("p_id").alias("doc_id")), common.FEW_ROWS), ["bucket", "doc_id"], "left_anti")
        live = common.materialize(_relabel(left, roots), "minhash-live")
        pivots *= PIVOT_GROWTH
    out = keys.select("doc_id", *group).join(classes, group, "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = common.materialize(out, "minhash-classed").join(labels.select(F.col("doc_id").alias("class_id"), "comp"), "class_id", "left")
    component = F.coalesce("comp", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "class_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component; its columns stay.

    Rows that share an id count as one document and stay or go together.
    """
    gone = near_duplicates(docs, id_col, text_col, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct()
    gone = common.maybe_broadcast(common.materialize(gone, "minhash-gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone_id"], "left_anti")


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` by two-word shingles and a similarity of 0.8."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")

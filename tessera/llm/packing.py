"""Operator 5: best-fit packing by patterns and non-negative least squares.

Documents become pieces of at most ``capacity`` ids; how many pieces have each
length is a histogram of at most ``capacity`` entries, whatever the corpus'
size. On it, patterns of few documents that fill a sequence exactly are
enumerated, repeat counts are fitted to the histogram by non-negative least
squares and rounded, and what remains is packed best fit, longest first. The
plan is a table of runs: of the pieces with one length, ranks [from, to) go to
consecutive sequences at one offset. Its size is bounded by the capacity too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
END_ID = 0
#: Splits of what a length leaves that are tried for three and for four documents.
SPLITS = 12
NNLS_STEPS = 300

PIECE_SCHEMA = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, part_rank long"


def enumerate_patterns(present: np.ndarray, capacity: int, splits: int = SPLITS) -> list[tuple[int, ...]]:
    """Sets of one to four present lengths with sum ``capacity``.

    All of one and two documents; of three and four, for each longest length
    up to ``splits`` evenly spread choices of the second.
    """
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    found: set[tuple[int, ...]] = {(capacity,)} if has[capacity] else set()
    for a in present[::-1].tolist():
        rest = capacity - a
        if not 0 < rest:
            continue
        if rest <= a and has[rest]:
            found.add((a, rest))
        second = present[(present <= min(a, rest - 1)) & (2 * present >= rest)]
        second = second[has[rest - second]]
        for b in second[np.unique(np.linspace(0, len(second) - 1, splits).astype(int))].tolist() if len(second) else []:
            found.add((a, b, rest - b))
        seconds = present[(present <= min(a, rest - 2)) & (3 * present >= rest)]
        for b in seconds[np.unique(np.linspace(0, len(seconds) - 1, splits).astype(int))].tolist() if len(seconds) else []:
            last = rest - b
            third = present[(present <= min(b, last - 1)) & (2 * present >= last)]
            third = third[has[last - third]]
            if len(third):
                c = int(third[len(third) // 2])
                found.add((a, b, c, last - c))
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Non-negative repeat counts that bring the patterns' lengths near the histogram.

    Multiplicative least-squares steps keep every count at or above zero and
    touch only the few entries that each pattern has. A length's square error
    weighs by the length, for what is long is hard to place afterwards.
    """
    if not patterns:
        return np.zeros(0)
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.concatenate([np.array(p) for p in patterns])
    target, weight = histogram.astype(float), np.arange(len(histogram), dtype=float)
    gain = np.bincount(column, (weight * target)[row], len(patterns))
    x = np.full(len(patterns), max(1e-9, target.sum() / max(1, len(row))))
    for _ in range(steps):
        made = np.bincount(row, x[column], len(target))
        x *= gain / np.maximum(np.bincount(column, (weight * made)[row], len(patterns)), 1e-12)
    return x


def plan_sequences(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats that use every piece of the histogram exactly once."""
    left = np.asarray(histogram, np.int64).copy()
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    repeats = np.rint(fit_repeats(patterns, left)).astype(np.int64)
    plan = []
    for k in np.argsort(-repeats, kind="stable").tolist():
        if repeats[k] <= 0:
            break
        lengths, each = np.unique(patterns[k], return_counts=True)
        n = int(min(repeats[k], (left[lengths] // each).min()))
        if n > 0:
            left[lengths] -= n * each
            plan.append((patterns[k], n))
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        use: dict[int, int] = {top: 1}
        gap = capacity - top
        at = min(gap, top)
        while gap and at:
            fits = np.flatnonzero(left[1 : at + 1] > 0)
            if not len(fits):
                break
            at = int(fits[-1]) + 1
            take = int(min(gap // at, left[at] - use.get(at, 0)))
            if take > 0:
                use[at] = use.get(at, 0) + take
                gap -= take * at
            at = min(gap, at - 1)
        n = int(min(left[v] // k for v, k in use.items()))
        for v, k in use.items():
            left[v] -= n * k
        plan.append((tuple(v for v, k in sorted(use.items(), reverse=True) for _ in range(k)), n))


def plan_runs(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = common.kept("tokens", path, tokens.WordEncoder)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            done = 0
            for ids, counts in enc.encode_column(batch.column(1), end_id):
                each = -(-counts // capacity)  # pieces of each document
                doc = np.repeat(np.arange(len(counts)), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [(np.full(len(doc), part), pa.int32()), (batch.column(0).slice(done, len(counts)).take(pa.array(doc)), pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int32()), (crc, pa.int64()), (rank, pa.int64())]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in columns], ["part", "doc_id", "piece", "start", "length", "ids_crc32", "part_rank"])
                done += len(counts)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there.

    A null or empty text is the end id alone; repeated rows are packed each;
    an empty table gives no row. Ranks within a length are local to a part
    plus what earlier parts hold, so no task ever holds all pieces of one
    length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pieces = common.materialize(rows.mapInArrow(common.frugal(_pieces(vocabulary or tokens.vocabulary_path(), end_id, capacity)), PIECE_SCHEMA), "pieces")
    counts = common.materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    runs = plan_runs(plan_sequences(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("part_rank"))
    shared = spark.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        plan = shared.value
        key = (plan[:, 0] << 44) + plan[:, 1]
        at = np.searchsorted(key, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": plan[at, 2] + rank.to_numpy() - plan[at, 1], "offset": plan[at, 3]})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset")


def op5_pattern_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 ids."""
    return pack(common.table(spark, sf_dir, "documents"))

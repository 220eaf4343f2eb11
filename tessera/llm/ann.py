"""Operator 10: approximate nearest neighbours by IVF-PQ with exact reranking.

Coarse centroids cut the space into cells; a vector's residual to its centroid
is product-quantised. The model is fitted on a bounded sample, the index holds
every vector. A query visits its nearest cells; in each it scores all codes
from one table of asymmetric distances, keeps a shortlist, and computes exact
distances for that from the original vectors. How many cells a query visits is
measured: the fewest that reach ``target_recall`` against brute force within
the sample, whose neighbours are farther apart than those of the whole table.

A cell is cut into blocks of bounded size, so a cell with a third of all rows
is many tasks. A block's codes are read once and its queries stream past them;
vectors travel only to the pairs that are reranked. Rows are in order of their
ids and all sorts are stable, so ties go to the smaller id, also among any
number of equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from . import common

#: Vectors on which centroids, code books and the number of probes are fitted.
SAMPLE_ROWS = 20_000
MAX_CELLS = 1024
SUBSPACES, CODES = 32, 256
#: Rows of a block, queries that one task lets pass it, and rough distances in memory at a time.
BLOCK_ROWS, BLOCK_QUERIES, DISTANCES = 32_768, 65_536, 1 << 21
#: Rows that a query takes from each block, and reranks exactly in all.
SHORTLIST, RERANK = 48, 384
TARGET_RECALL = 0.975
STEPS = 8

INDEX_SCHEMA = "row long, cell int, vec_id long, vector array<double>, codes binary"
#: A block's rows come first (codes), then its queries (components).
_MET = "cell int, block int, turn int, asks boolean, id long, vec_id long, data binary"


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances less a term that is the same for all centroids."""
    return (centroids**2).sum(axis=1)[None] - 2 * x @ centroids.T


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = STEPS) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(steps):
        near = _nearest(x, centroids).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        used = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[used]
        centroids[used] = np.add.reduceat(x[order], starts, axis=0) / counts[used, None]
    return centroids


@dataclass
class IvfPq:
    """A fitted model; small, and independent of the table's size."""

    centroids: np.ndarray
    splits: list[np.ndarray]
    books: list[np.ndarray]
    probes: int

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, target_recall: float = TARGET_RECALL, seed: int = 7) -> IvfPq:
        """Fit on a sample ``x`` of a table with ``rows`` rows."""
        cells = max(1, min(MAX_CELLS, int(rows**0.5), len(x)))
        centroids = kmeans(x, cells, seed)
        near = _nearest(x, centroids).argmin(axis=1)
        residual = x - centroids[near]
        splits = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        books = [kmeans(residual[:, s], CODES, seed + 1 + j) for j, s in enumerate(splits)]
        queries = x[:: max(1, len(x) // 400)][:400]
        distance = _nearest(queries, x)
        neighbours = np.argpartition(distance, min(10, len(x) - 1), axis=1)[:, :11]
        order = _nearest(queries, centroids).argsort(axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        needed = np.sort(np.take_along_axis(rank, near[neighbours], axis=1).ravel())
        probes = int(needed[min(len(needed) - 1, int(np.ceil(target_recall * len(needed))))]) + 1
        return cls(centroids, list(splits), books, min(probes, cells))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centroids).argmin(axis=1)
        residual = x - self.centroids[cell]
        codes = np.stack([_nearest(residual[:, s], b).argmin(axis=1) for s, b in zip(self.splits, self.books, strict=True)], axis=1)
        return cell, codes.astype(np.uint8)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cells that each query visits, nearest first."""
        return np.argsort(_nearest(x, self.centroids), axis=1, kind="stable")[:, : self.probes]

    def asymmetric(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of one cell."""
        rest = queries - self.centroids[cell]
        total = np.zeros((len(queries), len(codes)))
        for j, (s, book) in enumerate(zip(self.splits, self.books, strict=True)):
            table = ((rest[:, None, s] - book[None]) ** 2).sum(axis=2)
            total += table[:, codes[:, j]]
        return total


def usable(vector) -> F.Column:
    """Whether a vector takes part: not null or zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                cell, codes = model.encode(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary())], ["row", "cell", "vec_id", "vector", "codes"])

    return run


def _visits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                cells = pa.array(model.cells(x).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in x], pa.binary()), cells], ["query", "query_id", "vector", "data", "cells"])

    return run


def _binary_matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _shortest(rough: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's ``n`` least finite distances; of equal ones the first rows."""
    n = min(n, rough.shape[1])
    bound = np.partition(rough, n - 1, axis=1)[:, n - 1]
    at = []
    for i, b in enumerate(bound):
        near = np.flatnonzero((rough[i] <= b) & np.isfinite(rough[i]))
        at.append(near[np.argsort(rough[i, near], kind="stable")[:n]])
    return np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at)


def _shortlists(shared, shortlist: int):
    """Each block's queries with the rows whose coded vectors are nearest; rows come sorted by block, rows before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, parts, block = shared.value, None, [], None
        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(starts, starts[1:], strict=False):
                if held != (key := tuple(keys[a, :3])):
                    held, parts, block = key, [], None
                if not keys[a, 3]:
                    parts.append(batch.slice(a, b - a))
                    continue
                if block is None and parts:
                    whole = pa.Table.from_batches(parts).combine_chunks()
                    block = whole["id"].to_numpy(), whole["vec_id"].to_numpy(), _binary_matrix(whole["data"], np.uint8)
                    parts = []
                if block is None:
                    continue
                rows, ids, codes = block
                step = max(1, DISTANCES // len(rows))
                for lo in range(a, b, step):
                    some = batch.slice(lo, min(step, b - lo))
                    rough = model.asymmetric(_binary_matrix(some.column(6), np.float64), int(held[0]), codes)
                    rough[ids[None] == some.column(5).to_numpy()[:, None]] = np.inf
                    i, j = _shortest(rough, shortlist)
                    yield pa.RecordBatch.from_arrays([some.column(4).take(pa.array(i)), pa.array(rows[j]), pa.array(ids[j]), pa.array(rough[i, j])], ["query", "row", "vec_id", "rough"])

    return run


def fit(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, target_recall: float = TARGET_RECALL) -> tuple[IvfPq | None, int]:
    """A model for usable ``vectors`` (vec_id, vector), and their number of components.

    The sample is the rows with the least hash of their id. Where numbers of
    components differ, the sample's most frequent one counts.
    """
    rows = vectors.count()
    sample = common.hash_sample(vectors, sample_rows, "vec_id").toPandas()["vector"]
    if not len(sample):
        return None, 0
    size = int(sample.map(len).mode().iloc[0])
    x = np.stack(sample[sample.map(len) == size].to_numpy()).astype(np.float64)
    return IvfPq.fit(x, rows, target_recall), size


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shortlist: int = SHORTLIST, sample_rows: int = SAMPLE_ROWS, target_recall: float = TARGET_RECALL, rerank: int = RERANK) -> DataFrame:
    """The ``k`` nearest ``rows`` of each of ``queries``: query_id, rank, vec_id, score.

    A row is no neighbour of the query with its id. Unusable vectors and those
    with another number of components than most take no part on either side;
    a query without candidates gives no row. Repeated rows are found as often
    as they stand. Ties go to the smaller id.
    """
    spark = rows.sparkSession
    shape = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    good, asked = shape(rows), shape(queries)
    model, size = fit(good, sample_rows, target_recall)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(model)
    numbered = lambda df, name: df.where(F.size("vector") == size).select(F.monotonically_increasing_id().alias(name), "vec_id", "vector")
    index = common.materialize(numbered(good, "row").mapInArrow(_index(shared), INDEX_SCHEMA), "ann-index")
    asked = numbered(asked, "query").mapInArrow(_visits(shared), "query long, query_id long, vector array<double>, data binary, cells array<int>")
    asked = common.materialize(asked, "ann-queries")
    visits = asked.select("query", "query_id", "data", F.explode("cells").alias("cell"))
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    turns = visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_QUERIES)).cast("int").alias("turns"))
    cells = F.broadcast(common.materialize(parts.join(turns, "cell"), "ann-cells"))  # at most MAX_CELLS rows
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = index.select("row", "cell", "vec_id", "codes").join(cells, "cell")
    placed = placed.select("cell", spread("row", "blocks").alias("block"), each("turns").alias("turn"), F.lit(False).alias("asks"), F.col("row").alias("id"), "vec_id", F.col("codes").alias("data"))
    visits = visits.join(cells, "cell").select("cell", each("blocks").alias("block"), spread("query", "turns").alias("turn"), F.lit(True).alias("asks"), F.col("query").alias("id"), F.col("query_id").alias("vec_id"), "data")
    met = placed.union(visits).to(_parse_datatype_string(_MET)).repartition("cell", "block", "turn").sortWithinPartitions("cell", "block", "turn", "asks", "vec_id", "id")
    found = met.mapInArrow(_shortlists(shared, max(k, shortlist)), "query long, row long, vec_id long, rough double")
    nearest = F.row_number().over(Window.partitionBy("query").orderBy("rough", "vec_id", "row"))
    found = common.materialize(found.withColumn("n", nearest).where(F.col("n") <= max(k, rerank)).select("query", "row"), "ann-shortlists")
    pairs = found.join(index.select("row", "vec_id", "vector"), "row").join(asked.select("query", "query_id", F.col("vector").alias("asked")), "query")
    squares = F.zip_with("vector", "asked", lambda a, b: (a - b) * (a - b))
    scored = pairs.select("query_id", "vec_id", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("score")).where(F.col("score") < float("inf"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ivf_pq(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth row of ``embeddings``."""
    rows = common.table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"))

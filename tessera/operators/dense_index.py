"""A stored index for exact vector search: blocks of neighbours with a centre and a radius.

A segment's vectors are dealt to the nearest of some of them and cut into
blocks of bounded size, so a cell with a third of all rows is many blocks. No
product of a query with a vector of a block is above its product with the
centre plus the query's length times the radius. A search scores each query's
most promising blocks first; the k-th product found bounds the result from
below, and only blocks that can reach it are read. The result is exact.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, scratch_path
from ..functions.order import dense_order
from ..sources import sinks
from . import dense
from .governance import enforce

#: Vectors that cells are made around, at most, and rows of a block.
PIVOTS, BLOCK_ROWS = 1024, 512
#: Blocks that give a query its first bound.
FIRST_BLOCKS = 2
#: Products are compared to twelve digits; bounds leave more room than sums of them can err.
SLACK = 1e-9

_BLOCKS = "cell int, salt int, n int, centre array<double>, radius double, ids array<long>, data binary"
_MET = "cell int, salt int, asks boolean, query long, ids array<long>, data binary"


@dataclass(frozen=True)
class Segment:
    path: str
    rows: int


@dataclass(frozen=True)
class State:
    version: int
    dimension: int
    segments: tuple[Segment, ...]


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (dense._matrix(batch.column(1)) @ pivots.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["passage_id", "v", "cell"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of rows that come sorted by cell, salt and id."""
    held: tuple | None = None
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []

    def done() -> pa.RecordBatch:
        x, names = np.concatenate(rows), np.concatenate(ids)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        values = [held[0]], [held[1]], [len(x)], [centre.tolist()], [radius], [names.tolist()], [x.tobytes()]
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["cell", "salt", "n", "centre", "radius", "ids", "data"])

    for batch in batches:
        cells, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (salts[1:] != salts[:-1])) + 1).tolist(), len(cells)] if len(cells) else [0]
        for a, b in zip(starts, starts[1:], strict=False):
            key = int(cells[a]), int(salts[a])
            if held != key:
                if rows:
                    yield done()
                held, ids, rows = key, [], []
            ids.append(batch.column(2).slice(a, b - a).to_numpy())
            rows.append(dense._matrix(batch.column(3).slice(a, b - a)))
    if rows:
        yield done()


def _bounds(names: np.ndarray, queries: np.ndarray, least: np.ndarray | None, first: int):
    """(query, cell, salt, segment, most) of the ``first`` most promising blocks of a batch, or of all that reach ``least``."""
    lengths = np.sqrt((queries**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centres, radii = dense._matrix(batch.column(3)), batch.column(4).to_numpy()
            for lo in range(0, len(names), dense.BLOCK):
                most = queries[lo : lo + dense.BLOCK] @ centres.T + lengths[lo : lo + dense.BLOCK, None] * radii[None] + SLACK
                if least is None:
                    at = np.argsort(-most, axis=1, kind="stable")[:, :first]
                    i, j = np.repeat(np.arange(len(most)), at.shape[1]), at.ravel()
                else:
                    i, j = np.nonzero(most >= least[lo : lo + dense.BLOCK, None])
                yield pa.RecordBatch.from_arrays([pa.array(names[lo + i]), *(c.take(pa.array(j)) for c in batch.columns[:3]), pa.array(most[i, j])], ["query", "cell", "salt", "segment", "most"])

    return run


def _scores(k: int):
    """The best ``k`` of each block for each of its queries; a block's row comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, rows = None, None, None
        for batch in batches:
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                here = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = np.frombuffer(batch.column(5)[i].as_py(), np.float64)
                if not asks[i]:
                    names = np.array(batch.column(4)[i].as_py(), np.int64)
                    key, rows = here, data.reshape(len(names), -1)
                elif here == key:
                    found = rows @ data
                    top = np.lexsort((names, -np.round(found, 12)))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(3)[i].as_py()] * len(top), pa.int64()), pa.array(names[top]), pa.array(found[top])], ["query", "passage_id", "score"])

    return run


class Index:
    """The index below ``root``; a version is one published file."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, dimension: int) -> Index:
        """An index without vectors; fails if there is one at ``root``."""
        if isinstance(dimension, bool) or not isinstance(dimension, int) or dimension < 1:
            raise ValueError("dimension must be a positive integer")
        index = cls(spark, root)
        index._publish(State(0, dimension, ()))
        return index

    def _publish(self, state: State) -> None:
        record = {"version": state.version, "dimension": state.dimension, "segments": [asdict(s) for s in state.segments]}
        sinks.publish_object(self.spark, record, f"{self.root}/versions/v{state.version:010d}.json")

    def state(self, version: int | None = None) -> State:
        found = sinks.read_version(self.spark, f"{self.root}/versions", version)
        return State(found["version"], found["dimension"], tuple(Segment(**s) for s in found["segments"]))

    def add(self, vectors: DataFrame, vector_col: str = "embedding") -> State:
        """Index ``vectors`` (passage_id, long, and a vector of length 1) as a new segment; ids must be new."""
        state = self.state()
        enforce(dense.violations(vectors, vector_col), "vectors")
        size = F.size(vector_col) != state.dimension
        enforce(vectors.where(size).select("passage_id", F.lit("dimension").alias("rule")), "vectors")
        twice = vectors.groupBy("passage_id").agg(F.count("*").alias("n")).where("n > 1 OR passage_id IS NULL").select("passage_id", F.lit("passage_id").alias("rule"))
        enforce(twice, "vectors")
        if state.segments:
            known = self._blocks(state).select(F.explode("ids").alias("passage_id"))
            enforce(vectors.join(known, "passage_id", "left_semi").select("passage_id", F.lit("passage_id indexed before").alias("rule")), "vectors")
        rows = vectors.select(F.col("passage_id").cast("long").alias("passage_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
        n = rows.count()
        if not n:
            return state
        cells = max(1, min(PIVOTS, int(n**0.5)))
        chosen = rows.orderBy(F.xxhash64("passage_id"), "passage_id").limit(cells).toArrow()  # at most PIVOTS rows
        near = cut(rows.mapInArrow(_assign(dense._matrix(chosen.column("v").combine_chunks())), "passage_id long, v array<double>, cell int"))
        sizes = F.broadcast(near.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("parts")))  # at most PIVOTS rows
        placed = near.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("passage_id"), F.col("parts")).cast("int").alias("salt"), "passage_id", "v")
        path = f"{self.root}/segments/{sinks.new_name()}"
        placed.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "passage_id").mapInArrow(_blocks, _BLOCKS).write.parquet(path)
        state = replace(state, version=state.version + 1, segments=(*state.segments, Segment(path, n)))
        self._publish(state)
        return state

    def _blocks(self, state: State) -> DataFrame:
        tables = [self.spark.read.schema(_BLOCKS).parquet(s.path).withColumn("segment", F.lit(i)) for i, s in enumerate(state.segments)]
        return functools.reduce(DataFrame.unionByName, tables)

    def blocks(self, state: State | None = None) -> DataFrame:
        """segment, cell, salt, n, centre, radius of each block; vectors aren't read."""
        return self._blocks(state or self.state()).select("segment", "cell", "salt", "n", "centre", "radius")

    def _found(self, state: State, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """query, passage_id, score: the best ``k`` of each of the blocks in ``pairs`` for its query."""
        parts = []
        for i in range(len(state.segments)):
            mine = pairs.where(F.col("segment") == i).select("cell", "salt", "query")
            wanted = mine.select("cell", "salt").distinct()
            stored = self.spark.read.schema(_BLOCKS).parquet(state.segments[i].path).join(wanted, ["cell", "salt"], "left_semi")
            stored = stored.select("cell", "salt", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("query"), "ids", "data")
            asks = mine.join(F.broadcast(asked), "query").select("cell", "salt", F.lit(True).alias("asks"), "query", F.lit(None).cast("array<long>").alias("ids"), "data")
            met = stored.union(asks).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "asks", "query")
            parts.append(met.mapInArrow(_scores(k), "query long, passage_id long, score double"))
        return functools.reduce(DataFrame.unionByName, parts)

    def _some(self, state: State, rows: pa.Table, k: int) -> tuple[DataFrame, DataFrame]:
        """Results of one scan's queries by number, and the blocks that were read for them."""
        names, x = rows.column("n").to_numpy(), dense._matrix(rows.column("v").combine_chunks())
        asked = self.spark.createDataFrame([(int(n), v.tobytes()) for n, v in zip(names, x, strict=True)], "query long, data binary")
        headers = self.blocks(state).select("cell", "salt", "segment", "centre", "radius")
        schema = "query long, cell int, salt int, segment int, most double"
        order = Window.partitionBy("query").orderBy(F.desc("most"), "segment", "cell", "salt")
        first = headers.mapInArrow(_bounds(names, x, None, FIRST_BLOCKS), schema).withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST_BLOCKS)
        best = Window.partitionBy("query").orderBy(F.desc("score"))
        bound = self._found(state, cut(first), asked, k).withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query", "score").toArrow()  # a row a query
        least = np.full(len(names), -np.inf)
        least[np.searchsorted(names, bound.column("query").to_numpy())] = bound.column("score").to_numpy()
        read = cut(headers.mapInArrow(_bounds(names, x, least, 0), schema))
        return self._found(state, read, asked, k), read

    def search(self, queries: DataFrame, k: int = 10, vector_col: str = "embedding", version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """query_id, passage_id, score, rank as :func:`dense.rank` gives them, and query_id with blocks_read.

        Queries are numbered and taken in scans of bounded size. Those whose
        vector is null or holds a null give no row.
        """
        if isinstance(k, bool) or not isinstance(k, int) or k < 1:
            raise ValueError("k must be a positive integer")
        state = self.state(version)
        if not state.segments:
            raise ValueError("the index has no vectors")
        whole = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull())
        asked = cut(dense_order(queries.where(whole).select("query_id", F.transform(vector_col, lambda x: x.cast("double")).alias("v")), "query_id", name="n"))
        most, found, read = dense.BLOCK * dense.SCAN_BLOCKS, [], []
        for lo in range(0, asked.count(), most):
            rows = asked.where(F.col("n").between(lo, lo + most - 1)).orderBy("n").select("n", "v").toArrow()
            some, blocks = self._some(state, rows, k)
            found.append(some)
            read.append(blocks)
        if not found:
            return self.spark.createDataFrame([], "query_id long, passage_id long, score double, rank int"), self.spark.createDataFrame([], "query_id long, blocks_read long")
        names = asked.select(F.col("n").alias("query"), "query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "passage_id")
        best = functools.reduce(DataFrame.unionByName, found).join(names, "query").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        counted = functools.reduce(DataFrame.unionByName, read).join(names, "query").groupBy("query_id").agg(F.count("*").alias("blocks_read"))
        return best.select("query_id", "passage_id", "score", "rank"), counted


def build(vectors: DataFrame, dimension: int, root: str | None = None, vector_col: str = "embedding") -> Index:
    """An index of ``vectors`` at ``root``, by default in the folder of scratch tables."""
    index = Index.create(vectors.sparkSession, root or scratch_path(vectors.sparkSession, "dense"), dimension)
    index.add(vectors, vector_col)
    return index

"""Operator 13: whitening of vectors by a tiled covariance.

Pairs of dimensions are dealt to square tiles. Vectors travel as column
blocks: those of one block of rows that a tile needs meet in one place, are
multiplied there, and products are summed by tile. The driver holds what
depends on the number of dimensions only: it assembles the tiles and
decomposes the matrix.

Components are integers and are centred by the rounded mean before they are
multiplied; what rounding left is taken off exactly at the end. So sums are
exact, however rows are dealt, and each entry of the covariance is the double
nearest to its true value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Dimensions of a tile's side.
TILE = 32
#: Integers up to this are exact in floating point, and so are products' sums up to it.
EXACT = 1 << 53


@dataclass
class Whitening:
    """Number of rows, sums, the unit eigenvectors as columns by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """Means, rounded to integers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _column_sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, object)
        for batch in batches:
            n, sums = n + batch.num_rows, sums + _matrix(batch.column(0), size).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0))], ["place", "n", "total"])

    return run


def _column_blocks(centre: np.ndarray, tile: int):
    """Each tile's column blocks of each block of rows; a tile on the diagonal needs one."""
    edges = list(range(0, len(centre), tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for turn, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), len(centre)) - centre
            x = x.astype(np.int32) if np.abs(x).max(initial=0) < 1 << 31 else x
            data = [np.ascontiguousarray(x[:, a : a + tile]).tobytes() for a in edges]
            for i in range(len(edges)):
                rows = [(i, j, first + turn, side, len(x), x.itemsize, data[k]) for j in range(i, len(edges)) for side, k in enumerate((i, j) if i < j else (i,))]
                kinds = pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["tile_row", "tile_column", "row_block", "side", "rows", "width", "data"])

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` of integers, exactly, as Python integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most * len(a) < EXACT:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)
    if most < EXACT and len(a) > 1:
        half = len(a) // 2
        return product(a[:half], b[:half]) + product(a[half:], b[half:])
    return a.astype(object).T @ b.astype(object)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tile's sum of products over a partition's blocks of rows, which come sorted by tile, block and side."""
    tile, left, total = None, None, None

    def done() -> pa.RecordBatch:
        values = pa.array([list(map(Decimal, total.ravel()))], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays([pa.array([tile[0]], pa.int32()), pa.array([tile[1]], pa.int32()), values], ["tile_row", "tile_column", "products"])

    for batch in batches:
        for i, j, side, rows, width, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
            if tile != (i, j):
                if total is not None:
                    yield done()
                tile, total = (i, j), None
            block = np.frombuffer(data, f"i{width}").reshape(rows, -1)
            if i != j and side == 0:
                left = block
                continue
            found = product(block if i == j else left, block)
            total = found if total is None else total + found
    if total is not None:
        yield done()


def fit(vectors: DataFrame, size: int, tile: int = TILE) -> Whitening:
    """The whitening of ``vectors`` (x, an array of ``size`` longs), which must have rows."""
    sums = vectors.select("x").mapInArrow(_column_sums(size), "place int, n long, total decimal(38,0)")
    found = sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("place").toArrow().to_pylist()  # a row a dimension
    n, totals = found[0]["n"], [int(r["total"]) for r in found]
    model = Whitening(n, totals, np.zeros(0), np.zeros((size, 0)), 0.0)
    centre = model.centre
    blocks = vectors.select("x").mapInArrow(_column_blocks(centre, tile), "tile_row int, tile_column int, row_block long, side int, rows int, width int, data binary")
    met = blocks.repartition("tile_row", "tile_column", "row_block").sortWithinPartitions("tile_row", "tile_column", "row_block", "side")
    products = met.mapInArrow(_multiply, "tile_row int, tile_column int, products array<decimal(38,0)>")
    each = products.select("tile_row", "tile_column", F.posexplode("products").alias("place", "value"))
    summed = each.groupBy("tile_row", "tile_column", "place").agg(F.sum("value").alias("value"))
    with common.short_batches(vectors.sparkSession):
        tiles = summed.toArrow()  # as many rows as pairs of dimensions
    rest = [t - n * int(c) for t, c in zip(totals, centre, strict=True)]
    matrix = np.zeros((size, size))
    for i, j, place, value in zip(*(c.to_pylist() for c in tiles.columns), strict=True):
        width = min(tile, size - j * tile)
        a, b = i * tile + place // width, j * tile + place % width
        matrix[a, b] = matrix[b, a] = (n * int(value) - rest[a] * rest[b]) / (n * n)
    values, columns = np.linalg.eigh(matrix)
    values, columns = values[::-1], columns[:, ::-1]
    signs = np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(size)])
    return Whitening(n, totals, values, columns * signs, float(np.trace(matrix)))


def _project(model: Whitening, scales: np.ndarray, vectors: np.ndarray):
    centre = model.centre
    rest = [s - model.n * int(c) for s, c in zip(model.sums, centre, strict=True)]
    mean = np.array([r / model.n for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(1), len(centre)) - centre
            most = model.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
            if most * most * len(centre) < 1 << 63:
                deviation = ((model.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1)
            else:
                deviation = ((model.n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
            whitened = ((y - mean) @ vectors) / scales
            flat = pa.array(whitened.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * vectors.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(int(d)) for d in deviation], pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    return run


def _identity_error(rows: DataFrame, size: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` less the identity."""
    if not size:
        return 0.0
    w = [F.col("whitened")[k] for k in range(size)]
    means = rows.agg(*[F.avg(c) for c in w]).first()
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    found = rows.agg(*[F.avg((w[a] - F.lit(means[a])) * (w[b] - F.lit(means[b]))) for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component, and the model.

    Rows with a null vector, or one with null or non-finite components, are
    left out, and so are those with another number of components than most
    (of two, the smaller). Rows with a null id stay, repeated rows count as
    often as they stand. With fewer dimensions than ``components`` there are
    as many components. A component whose eigenvalue is zero but for rounding
    has a null ``whitened`` and no part in ``identity_error``; if all are,
    ``explained`` is null too. ``deviation`` is a decimal of 38 digits. An
    empty table gives no row and no model.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vector = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    usable = rows.where(common.finite(F.col(vector_col)) & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("x"))
    usable = common.materialize(usable, "whiten-vectors")
    size = common.usual_size(usable, "x")
    if not size:
        return spark.createDataFrame([], schema), None
    usable = usable.where(F.size("x") == size)
    model = fit(usable, size, tile)
    values = model.eigenvalues[:components]
    zero = values <= model.eigenvalues[0] * size * np.finfo(float).eps
    scales, columns = np.sqrt(np.where(zero, 1.0, values)), model.vectors[:, : len(values)]
    known = int((~zero).sum())
    placed = common.materialize(usable.mapInArrow(_project(model, scales, columns), "vec_id long, deviation decimal(38,0), whitened array<double>"), "whitened")
    error = _identity_error(placed, known)
    explained = F.array(*[F.lit(None if model.trace <= 0 else float(v / model.trace)).cast("double") for v in np.where(zero, 0.0, values)])
    each = placed.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "value"))
    out = each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.when(F.col("place") < known, F.col("value")).alias("whitened"), explained[F.col("place")].alias("explained"), F.lit(float(error)).alias("identity_error"))
    return out, model


def op13_tiled_whitening(spark, sf_dir: str) -> DataFrame:
    """All ``embeddings``, whitened; a deviation that no long can hold is null."""
    out, _ = whiten(common.table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))

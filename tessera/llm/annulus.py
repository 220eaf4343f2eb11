"""Operator 11: vector code compression with annular norm pruning.

A vector is cut into parts, and each part is replaced by the index of the
nearest entry of its position's codebook. An entry that is nearer to a point
than some distance has a norm within that distance of the point's norm. So a
codebook's entries are sorted by norm, the entries next to the point in that
order give a first distance, two binary searches give the interval of norms
that this distance allows, its ends included, and only the entries of that
annulus are evaluated exactly.

Components are integers, so distances, sums and means are exact and results
depend on neither partitions nor their order. A round of the fit is one job in
which each task hands on one row of sums for each entry and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Integers beyond this are refused: sums of squared differences have to fit a long.
MAX_COMPONENT = 1 << 27
#: Relative slack of norms and distances in floating point; it only widens an annulus.
SLACK = 1e-9


class Codebook:
    """One position's entries in the order of their norms."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def _squared(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((points - self.entries[at]) ** 2).sum(axis=1)

    def annulus(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the interval of places, end excluded, that may hold a nearest entry."""
        norm = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
        after = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        best = np.minimum(self._squared(points, after), self._squared(points, np.maximum(after - 1, 0)))
        reach = np.sqrt(best.astype(np.float64))
        reach += SLACK * (reach + norm + 1)
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry; ties go to the lower index."""
        low, high = self.annulus(points)
        sizes = high - low
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(points)), sizes)
        at = np.arange(len(row)) - starts[row] + low[row]
        squared = self._squared(points[row], at)
        least = np.minimum.reduceat(squared, starts)
        index = np.where(squared == least[row], self.order[at], len(self.order))
        return np.minimum.reduceat(index, starts), least


def _integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """Components as integers, exact for powers of two as ``scale``."""
    found = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), size)
    if found.size and np.abs(found).max() >= MAX_COMPONENT:
        raise ValueError(f"a component times {scale} is not within {MAX_COMPONENT}")
    return found.astype(np.int64)


def _splits(size: int, parts: int) -> list[slice]:
    """Consecutive parts; the first ones are longer by one where ``parts`` does not divide ``size``."""
    edges = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(size), parts))])
    return [slice(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]


def _sums(books: list[np.ndarray], splits: list[slice], scale: int):
    """Each task's sums of components and numbers of rows by part and entry; place -1 has the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b) for b in books]
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column(0), splits[-1].stop, scale)
            for s, book, sums in zip(splits, codebooks, total, strict=True):
                index, _ = book.nearest(x[:, s])
                np.add.at(sums, index, np.column_stack([x[:, s], np.ones(len(x), np.int64)]))
        part = np.concatenate([np.full(t.size, j) for j, t in enumerate(total)])
        entry = np.concatenate([np.repeat(np.arange(len(t)), t.shape[1]) for t in total])
        place = np.concatenate([np.tile(np.append(np.arange(t.shape[1] - 1), -1), len(t)) for t in total])
        value = np.concatenate([t.ravel() for t in total])
        used = value != 0
        yield pa.RecordBatch.from_arrays([pa.array(a[used], k) for a, k in ((part, pa.int32()), (entry, pa.int32()), (place, pa.int32()), (value, pa.int64()))], ["part", "entry", "place", "value"])

    return run


def _encode(books: list[np.ndarray], splits: list[slice], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column(0), splits[-1].stop, scale)
                found = [book.nearest(x[:, s]) for s, book in zip(splits, codebooks, strict=True)]
                codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def fit(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks of ``vectors`` (vector, vec_id), all of ``size`` components.

    The first entries are the parts of the rows with the smallest ids (null
    last; of rows that repeat an id, those with the smaller vector). An entry
    that no part is nearest to stays as it is.
    """
    splits = _splits(size, parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column(0).combine_chunks()
    x = _integers(first, size, scale)
    books = [x[:, s].copy() for s in splits]
    for _ in range(rounds):
        sums = vectors.select("vector").mapInArrow(_sums(books, splits, scale), "part int, entry int, place int, value long")
        found = sums.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).toArrow()  # a row an entry and component
        part, entry, place, value = (c.to_numpy() for c in found.columns)
        for j, book in enumerate(books):
            new = np.zeros((len(book), book.shape[1] + 1), np.int64)
            new[entry[part == j], place[part == j]] = value[part == j]
            used = new[:, -1] > 0
            book[used] = new[used, :-1] // new[used, -1:]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries as decimal numbers, parted by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([b[i] for i, b in zip(bytes.fromhex(code), books, strict=True)])


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, code, error, label_error, codebooks_sha256) of each usable row, and the codebooks.

    Rows with a null vector, or one with null or non-finite components, are
    left out, and so are those with another number of components than most
    (of two, the smaller). Rows with a null id or a null label stay; null is a
    label of its own. Repeated rows are each coded. With fewer rows than
    entries the codebooks are as short. An empty table gives no row. At most
    256 entries, for a code has two hex digits a part.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    schema = "vec_id long, label string, code string, error long"
    vectors = rows.select(F.col(vector_col).alias("vector"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label")).where(common.finite(F.col("vector")))
    vectors = common.materialize(vectors, "codes-vectors")
    size = common.usual_size(vectors, "vector")
    vectors = vectors.where(F.size("vector") == size)
    if vectors.isEmpty():
        books: list[np.ndarray] = []
        coded = rows.sparkSession.createDataFrame([], schema)
    else:
        books = fit(vectors, size, parts, entries, rounds, scale)
        coded = common.materialize(vectors.mapInArrow(_encode(books, _splits(size, parts), scale), schema), "codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows"))
    labels = common.materialize(labels, "codes-labels")
    out = common.join_groups(coded.withColumnRenamed("label", "_label"), labels.withColumnRenamed("label", "_label"), "_label", "_rows")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books


def _oracle() -> str:
    """The same in DuckDB: a round is one table of assignments and one of entries."""
    width = 64 // PARTS
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, j, x[j * {width} + 1 : j * {width} + {width}] AS x FROM v, range({PARTS}) AS r(j))",
        f"b0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, x FROM p QUALIFY k < {ENTRIES})",
    ]
    squared = " + ".join(f"(p.x[{i}] - b.x[{i}]) * (p.x[{i}] - b.x[{i}])" for i in range(1, width + 1))
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, j, x, m.d AS d, m.k AS k FROM (SELECT p.vec_id, p.label, p.j, p.x, min({{'d': {squared}, 'k': b.k}}) AS m FROM p JOIN b{r} b USING (j) GROUP BY ALL))")
        if r < ROUNDS:
            means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, width + 1))
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.j, b.k, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT j, k, [{means}] AS x FROM a{r} GROUP BY j, k) n USING (j, k))")
    steps.append(f"c AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, k)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"


ORACLE_SQL = _oracle()


def op11_annular_codes(spark, sf_dir: str) -> DataFrame:
    """The codes and errors of all ``embeddings``."""
    return compress(common.table(spark, sf_dir, "embeddings"))[0]

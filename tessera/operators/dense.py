"""Vector ranking: checks, normalisation, exact top-k, and embedding by a plugged-in encoder."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.best import CELLS, Best
from ..functions.checkpoints import cut
from ..functions.order import dense_order

#: Queries that meet a batch of passages at once, and blocks that one scan takes.
BLOCK, SCAN_BLOCKS = 4096, 16
UNIT_TOLERANCE = 1e-5
#: Scores are compared to so many digits.
DIGITS = 12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The vector at length 1; null if it is zero or not finite."""
    n = norm(v)
    ok = (n > 0) & (n < float("inf")) & ~F.isnan(n)
    return F.when(ok, F.transform(v, lambda x: x.cast("double") / n))


def violations(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "passage_id") -> DataFrame:
    """id and rule of rows that an index can't take: null, not finite, not of length 1, another dimension."""
    v = F.col(vector_col)
    size = vectors.agg(F.mode(F.size(v)).alias("d"))
    bad = F.when(v.isNull(), "null").when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "not finite").when(F.abs(norm(v) - 1) > UNIT_TOLERANCE, "not of length 1").when(F.size(v) != F.col("d"), "dimension")
    return vectors.crossJoin(F.broadcast(size)).select(F.col(id_col), bad.alias("rule")).where("rule IS NOT NULL")


def rank(passages: DataFrame, queries: DataFrame, k: int = 10, vector_col: str = "embedding") -> DataFrame:
    """query_id, passage_id, score, rank by the dot product of all pairs.

    Exact search has no join key: queries are numbered and dealt into blocks,
    each block meets some passages at a time in a matrix product, of at most
    ``CELLS`` cells, and only the best ``k`` of a task leave it. One scan of the passages takes at most
    ``SCAN_BLOCKS`` blocks of ``BLOCK`` queries, which are broadcast; further
    queries take further scans. Rows whose vector is null or holds a null take
    no part on either side; :func:`violations` lists them.
    """
    whole = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull())
    passages, queries = passages.where(whole), queries.where(whole)
    asked = cut(dense_order(queries.select("query_id", F.col(vector_col).alias("v")), "query_id", name="n"))
    most = BLOCK * SCAN_BLOCKS
    parts = []
    for lo in range(0, asked.count(), most):
        rows = asked.where(F.col("n").between(lo, lo + most - 1)).orderBy("n").select("query_id", "v").toArrow()
        parts.append(_scan(passages, rows.column("query_id").to_numpy(), _matrix(rows.column("v").combine_chunks()), k, vector_col))
    if not parts:
        return passages.sparkSession.createDataFrame([], "query_id long, passage_id long, score double, rank int")
    found = functools.reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "passage_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "passage_id", "score", "rank")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scan(passages: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, vector_col: str) -> DataFrame:
    """The best ``k`` of each task's passages for some queries."""
    shared = passages.sparkSession.sparkContext.broadcast((ids, vectors))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        found = [Best(len(names[lo : lo + BLOCK]), k, DIGITS) for lo in range(0, len(names), BLOCK)]
        step = max(1, CELLS // min(BLOCK, len(names)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                own, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for some, lo in zip(found, range(0, len(names), BLOCK), strict=True):
                    some.add(asked[lo : lo + BLOCK] @ rows.T, own)
        for some, lo in zip(found, range(0, len(names), BLOCK), strict=True):
            if (rows := some.rows()) is not None:
                columns = [names[lo : lo + BLOCK][rows[0]], rows[1], rows[2]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "passage_id", "score"])

    return passages.select("passage_id", F.col(vector_col).alias("v")).mapInArrow(best, "query_id long, passage_id long, score double")


def embed(rows: DataFrame, text_col: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32, prefix: str = "") -> DataFrame:
    """``rows`` with ``embedding``. ``encoder`` makes, once per worker, what turns texts into vectors.

    Queries pass their instruction as ``prefix``. A vector that is not finite or zero is an error.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in parts:
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                got = np.asarray(encode([prefix + t for t in texts.iloc[at : at + batch]]), np.float64)
                size = np.linalg.norm(got, axis=1, keepdims=True)
                if not np.isfinite(got).all() or (size == 0).any():
                    raise ValueError("an embedding is zero or not finite")
                out += (got / size).astype(np.float32).tolist()
            yield pd.Series(out)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text_col)))

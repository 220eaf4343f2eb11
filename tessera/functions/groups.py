"""Sequential work within each key's rows, streamed instead of a frame a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that are handed on together.
ROWS = 4096

Run = Callable[[object, dict[str, list]], list[tuple]]


def stream_groups(df: DataFrame, key: str, order: str | list[str], run: Run, schema: str | StructType) -> DataFrame:
    """``run(key, columns)`` for each key's rows in ``order``; its tuples are the rows of ``schema``.

    Rows are dealt by the key and sorted in their partition once, so a
    partition's groups pass through one Python function, each whole and one
    at a time. A null key is a group too.

    They are dealt by a hash of the key: a shuffle by the key itself is left
    out above a union of tables that are dealt so already, and adaptive
    execution then coalesces each of those on its own, which parts groups.
    """
    columns = df.columns
    at = columns.index(key)
    out = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*rows, strict=True)) if rows else [()] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(values, out, strict=True)], schema=out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] | None = None
        rows: list[tuple] = []
        for some in batches:
            got = [c.to_pylist() for c in some.columns]
            keys = got[at]
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(starts, starts[1:], strict=False):
                part = [c[a:b] for c in got]
                if held is not None and held[at][0] == part[at][0]:
                    for h, p in zip(held, part, strict=True):
                        h += p
                    continue
                if held is not None:
                    rows += run(held[at][0], dict(zip(columns, held, strict=True)))
                held = part
            if len(rows) >= ROWS:
                yield batch(rows)
                rows = []
        if held is not None:
            rows += run(held[at][0], dict(zip(columns, held, strict=True)))
        yield batch(rows)

    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *([order] if isinstance(order, str) else order)).mapInArrow(stream, schema)

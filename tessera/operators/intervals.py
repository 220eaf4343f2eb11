"""Spans over lines by sums and events, not by unrolling them.

A span's measures are the difference of two running sums, looked up at its
first and its last line. Who owns a line where spans overlap is found by a
sweep over their ends. Both cost rows of lines plus rows of spans, however
deeply spans are nested, and no task holds more of a document's lines than one
block of positions.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import stream_groups

#: Positions of a block, as a power of two.
BLOCK_BITS = 12


def block(position: Column) -> Column:
    return F.shiftright(position.cast("long"), BLOCK_BITS)


def running_sums(lines: DataFrame, measures: dict[str, Column], key: str = "document_id", position: str = "line_pos", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, position, ``keep`` and each of ``measures`` summed over the key's lines up to and with this one.

    A line's sum is that of its block so far plus those of all blocks before:
    one small row a block is all that a document puts together. A line's own
    value of a measure is in ``own_`` and its name.
    """
    names = list(measures)
    rows = lines.select(key, F.col(position).cast("long").alias(position), block(F.col(position)).alias("_block"), *keep, *[m.cast("long").alias(f"own_{n}") for n, m in measures.items()])
    totals = rows.groupBy(key, "_block").agg(*[F.sum(f"own_{n}").alias(n) for n in names])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names])
    within = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(f"own_{n}").over(within) for n in names}).join(totals, [key, "_block"])
    return rows.select(key, position, *keep, *[f"own_{n}" for n in names], *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names])


def span_sums(spans: DataFrame, lines: DataFrame, measures: dict[str, Column], start: str, stop: str, key: str = "document_id", position: str = "line_pos", edges: tuple[str, ...] = ()) -> DataFrame:
    """``spans`` with each of ``measures`` summed over their lines, 0 for empty spans, and first_ and last_ of ``edges``.

    Positions are dense in a document and stops exclusive. Of each measure the
    sum at the last line less that before the first counts: two lookups a span.
    """
    names = list(measures)
    sums = running_sums(lines, measures, key, position, edges)
    before = sums.select(key, F.col(position).alias("_start"), *[(F.col(n) - F.col(f"own_{n}")).alias(f"_low_{n}") for n in names], *[F.col(e).alias(f"first_{e}") for e in edges])
    upto = sums.select(key, F.col(position).alias("_last"), *[F.col(n).alias(f"_high_{n}") for n in names], *[F.col(e).alias(f"last_{e}") for e in edges])
    rows = spans.withColumn("_start", F.when(F.col(start) < F.col(stop), F.col(start).cast("long"))).withColumn("_last", F.when(F.col(start) < F.col(stop), F.col(stop).cast("long") - 1))
    rows = rows.join(before, [key, "_start"], "left").join(upto, [key, "_last"], "left")
    found = [F.coalesce(F.col(f"_high_{n}") - F.col(f"_low_{n}"), F.lit(0).cast("long")).alias(n) for n in names]
    return rows.select(*[F.col(c) for c in spans.columns], *found, *[f"{w}_{e}" for e in edges for w in ("first", "last")])


def segments(spans: DataFrame, key: str = "document_id", start: str = "start_pos", stop: str = "stop_pos", owner: str = "owner", rank: str = "rank") -> DataFrame:
    """key, start_pos, stop_pos, owner, rank, claims: disjoint stretches with the span that owns them.

    Of the spans over a stretch the one with the least rank owns it, then the
    one with the least owner; ``claims`` is how many of that rank lie over it.
    Empty spans own nothing. A document's ends pass through one heap.
    """
    def sweep(name: object, group: dict[str, list]) -> list[tuple]:
        out: list[tuple] = []
        heap: list[tuple] = []
        ends: dict[int, list] = {}  # of open spans by rank
        starts, stops, owners, ranks = (group[c] for c in (start, stop, owner, rank))
        points, at = sorted({*starts, *stops}), 0
        for low, high in zip(points, points[1:], strict=False):
            while at < len(starts) and starts[at] == low:
                heapq.heappush(heap, (ranks[at], owners[at], stops[at]))
                heapq.heappush(ends.setdefault(ranks[at], []), stops[at])
                at += 1
            while heap and heap[0][2] <= low:
                heapq.heappop(heap)
            if not heap:
                continue
            first, who, _ = heap[0]
            while ends[first][0] <= low:
                heapq.heappop(ends[first])
            row = (name, low, high, who, first, len(ends[first]))
            if out and out[-1][2] == low and out[-1][3:] == row[3:]:
                row = (name, out.pop()[1], *row[2:])
            out.append(row)
        return out

    rows = spans.where(F.col(start) < F.col(stop)).select(key, F.col(start).cast("long").alias(start), F.col(stop).cast("long").alias(stop), owner, F.col(rank).cast("int").alias(rank))
    kinds = dict(rows.dtypes)
    schema = f"`{key}` {kinds[key]}, start_pos long, stop_pos long, owner {kinds[owner]}, rank int, claims int"
    return stream_groups(rows, key, [start, stop], sweep, schema)


def place(lines: DataFrame, found: DataFrame, key: str = "document_id", position: str = "line_pos") -> DataFrame:
    """``lines`` with owner, rank and claims of the stretch that they lie in; null outside of all.

    ``found`` is what :func:`segments` gives. A stretch is cut where blocks
    end, and a line takes on the last stretch that began in its block, if it
    has not ended.
    """
    low, high, size = F.col("start_pos"), F.col("stop_pos"), 1 << BLOCK_BITS
    cut = found.withColumn("_block", F.explode(F.sequence(block(low), block(high - 1))))
    what = F.struct(high.alias("stop"), "owner", "rank", "claims")
    began = cut.select(key, "_block", F.greatest(low, F.col("_block") * size).alias("_at"), F.lit(0).alias("_kind"), what.alias("_what"), F.lit(None).cast(lines.select(F.struct(*lines.columns)).schema[0].dataType).alias("_row"))
    asks = lines.select(key, block(F.col(position)).alias("_block"), F.col(position).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(began.schema["_what"].dataType).alias("_what"), F.struct(*lines.columns).alias("_row"))
    last = F.last("_what", ignorenulls=True).over(Window.partitionBy(key, "_block").orderBy("_at", "_kind"))
    rows = began.union(asks).withColumn("_what", last).where("_kind = 1")
    inside = F.when(F.col("_what.stop") > F.col("_at"), F.col("_what"))
    return rows.select("_row.*", *[inside[c].alias(c) for c in ("owner", "rank", "claims")])

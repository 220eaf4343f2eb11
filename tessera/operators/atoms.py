"""Cuts within lines: atoms of a source, where they may end, and the fewest pieces over them.

A reviewed anchor names a place in one line of a source at which a sentence
ends. Lines without an anchor are one atom each.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import stream_groups

TARGET_TOKENS, HARD_TOKENS = 384, 445

#: Why a piece may end there.
IN_LINE, LAST, ENTRY = "after_sentence_in_line", "end_of_source_unit", "before_reference_entry"

KEY = ["source_id", "line_order"]


def split_lines(lines: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """source_id, line_order, start_char, end_char, text, reason of every atom.

    ``lines`` has source_id, line_order, text and reason, ``anchors``
    source_id, line_order and split_offset, any number a line. Offsets count
    characters; those outside a line cut nothing, and
    :func:`anchor_violations` lists them. A null text is an empty atom.
    """
    rows = lines.select(*KEY, F.coalesce("text", F.lit("")).alias("text"), "reason")
    size = F.length("text")
    if anchors is None:
        return rows.select(*KEY, F.lit(0).alias("start_char"), size.alias("end_char"), "text", "reason")
    cuts = anchors.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.col("split_offset").cast("int"))).alias("cuts"))
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda x: (x > 0) & (x < size))
    rows = rows.join(cuts, KEY, "left").withColumn("cuts", F.concat(inner, F.array(size)))
    rows = rows.select(*KEY, "text", "reason", F.size("cuts").alias("n"), "cuts", F.posexplode("cuts").alias("i", "end_char"))
    start = F.when(F.col("i") == 0, 0).otherwise(F.get("cuts", F.col("i") - 1))
    rows = rows.withColumn("start_char", start)
    reason = F.when(F.col("i") < F.col("n") - 1, IN_LINE).otherwise(F.col("reason"))
    return rows.select(*KEY, "start_char", "end_char", F.col("text").substr(F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("text"), reason.alias("reason"))


def anchor_violations(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """source_id, line_order, split_offset and rule of anchors that no longer fit their line.

    ``anchors`` also has left_suffix and right_prefix, the text around the cut.
    """
    at = [*KEY, "split_offset"]
    known = lines.select(*KEY, F.coalesce("text", F.lit("")).alias("_text"))
    rows = anchors.join(known, KEY, "left")
    offset, size = F.col("split_offset").cast("int"), F.length("_text")
    left, right = F.col("_text").substr(F.lit(1), offset), F.col("_text").substr(offset + 1, size)
    rule = (
        F.when(F.col("_text").isNull(), "no such line").when(offset.isNull() | (offset < 1) | (offset >= size), "offset")
        .when(~F.coalesce(left.endswith(F.col("left_suffix")), F.lit(False)), "left context").when(~F.coalesce(right.startswith(F.col("right_prefix")), F.lit(False)), "right context")
    )
    out = rows.select(*at, rule.alias("rule")).where("rule IS NOT NULL")
    return out.union(anchors.groupBy(*at).count().where("count > 1").select(*at, F.lit("repeated")))


def entry_ends(atoms: DataFrame, entries: DataFrame) -> DataFrame:
    """``atoms`` that may end only where a bibliography entry does, with ``entry``.

    ``entries`` has source_id, line_order and entry, as ``units.reference_entries``
    numbers them; lines before the first entry (0) belong to its piece.
    """
    rows = atoms.join(entries.select(*KEY, "entry"), KEY)
    following = F.lead("entry").over(Window.partitionBy("source_id").orderBy("line_order", "start_char"))
    reason = F.when(following.isNull(), LAST).when((F.col("entry") > 0) & (following != F.col("entry")), ENTRY)
    return rows.withColumn("reason", reason)


def best_partition(ends: list[tuple[int, bool]], tokens: Callable[[int, int], int], hard: int = HARD_TOKENS, target: int = TARGET_TOKENS) -> list[int] | None:
    """Positions in ``ends`` at which pieces end; ``None`` if no partition fits.

    ``ends`` are (atom, within a line) in order. The cost of a partition is
    (pieces, cuts within lines, sum of distances to the target); of equal
    costs the one whose last piece starts earliest counts. A piece's count
    must not fall as it grows to the left: the first that is over ``hard``
    ends the search.
    """
    best: list[tuple[tuple[int, int, int], int] | None] = []
    for j, (atom, inner) in enumerate(ends):
        found = None
        for i in range(j - 1, -2, -1):
            n = tokens(0 if i < 0 else ends[i][0] + 1, atom)
            if n > hard:
                break
            if i >= 0 and best[i] is None:
                continue
            a, b, c = (0, 0, 0) if i < 0 else best[i][0]
            cost = (a + 1, b + inner, c + abs(target - n))
            if found is None or cost <= found[0]:
                found = (cost, i)
        best.append(found)
    if not ends or best[-1] is None:
        return None
    path, at = [], len(ends) - 1
    while at >= 0:
        path.append(at)
        at = best[at][1]
    return path[::-1]


_PIECES = "source_id string, passage_number int, passage_count int, first_order long, start_char int, last_order long, end_char int, tokens long, boundary_after string"


def partition(atoms: DataFrame, counter: Callable[[], Callable[[str], int]] | None = None, hard: int = HARD_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """Each source's fewest pieces within ``hard`` tokens, with the offsets at which they start and end.

    Atoms of one line stand together as in the line, lines are stripped and
    joined by line breaks. ``counter`` makes a token counter once per worker;
    without one, words are counted. A source that can't be cut gets one row
    without numbers.
    """

    def run(key: str, group: dict[str, list]) -> list[tuple]:
        texts, order, reasons = group["text"], group["line_order"], group["reason"]
        if counter:
            count = counter()

            def tokens(a: int, b: int) -> int:
                whole = ["".join(texts[i] for i in some).strip() for _, some in itertools.groupby(range(a, b + 1), order.__getitem__)]
                return count("\n".join(whole))
        else:
            # a cut inside a word makes two words of it, but only for pieces that end there
            split = [i > 0 and order[i] == order[i - 1] and texts[i - 1][-1:].strip() != "" and texts[i][:1].strip() != "" for i in range(len(texts))]
            upto = [0, *itertools.accumulate(len(t.split()) - s for t, s in zip(texts, split, strict=True))]
            tokens = lambda a, b: upto[b + 1] - upto[a] + split[a]
        ends = [(i, r == IN_LINE) for i, r in enumerate(reasons) if r is not None]
        path = best_partition(ends, tokens, hard, target) if ends and ends[-1][0] == len(texts) - 1 else None
        if path is None:
            return [(key, *[None] * 8)]
        rows, at = [], 0
        for i, p in enumerate(path):
            end = ends[p][0]
            rows.append((key, i + 1, len(path), order[at], group["start_char"][at], order[end], group["end_char"][end], tokens(at, end), reasons[end]))
            at = end + 1
        return rows

    rows = atoms.select(F.col("source_id").cast("string").alias("source_id"), F.col("line_order").cast("long"), F.col("start_char").cast("int"), F.col("end_char").cast("int"), "text", "reason")
    return stream_groups(rows, "source_id", ["line_order", "start_char"], run, _PIECES)


def partition_passages(lines: DataFrame, counter: Callable[[], Callable[[str], int]] | None = None, hard: int = HARD_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """Each source's fewest pieces within ``hard`` tokens over safe boundaries.

    ``lines`` has source_id, line_order, text, reason. ``counter`` makes a
    token counter once per worker; without one, words are counted. A piece
    over ``hard`` tokens is tried no further to the left, for counts only grow.
    A source that can't be cut gets one row without numbers. For cuts within
    lines see :func:`partition`.
    """
    return partition(split_lines(lines), counter, hard, target).drop("start_char", "end_char")

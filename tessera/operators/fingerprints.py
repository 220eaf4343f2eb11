"""Proof that parts make up a whole in order, by hashes that combine.

A sequence's polynomial hash is the sum of its elements' hashes times powers
of a base by their places. It can be summed in any order and on any number of
tasks, and the hash of two sequences one after the other follows from theirs
and their lengths. So a source's parts are checked against its lines without
either being put together: lost, doubled, swapped and changed lines show.
Two moduli of some thirty bits make a false proof a matter of one in 10**18.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Primes below 2**31, and bases: products of residues stay below 2**62.
FIELDS = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))
#: Bits of a place; its powers are looked up by sixteens.
PLACE_BITS = 40


def _power(base: int, modulus: int, place: Column) -> Column:
    """``base ** place`` modulo ``modulus``: a product of looked-up powers, one for each four bits of the place."""
    out = F.lit(1).cast("long")
    for shift in range(0, PLACE_BITS, 4):
        table = F.array(*[F.lit(pow(base, d << shift, modulus)).cast("long") for d in range(16)])
        out = F.pmod(out * table[F.shiftright(place, shift).bitwiseAND(F.lit(15)).cast("int")], F.lit(modulus).cast("long"))
    return out


def _element(value: Column, modulus: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), value), F.lit(modulus - 1).cast("long")) + 1


def fingerprint(rows: DataFrame, by: list[str], place: Column, value: Column) -> DataFrame:
    """``by`` with length, hash_a and hash_b of each group's values at their places from 0.

    Partial sums are made before the shuffle, so a group of any size is one
    row a task.
    """
    sums = []
    for k, (modulus, base) in enumerate(FIELDS):
        term = F.pmod(_element(value, modulus, k) * _power(base, modulus, place), F.lit(modulus).cast("long"))
        sums.append(F.pmod(F.sum(term.cast("decimal(38,0)")), F.lit(modulus)).cast("long").alias(f"hash_{'ab'[k]}"))
    return rows.groupBy(*by).agg(F.count("*").alias("length"), *sums)


def combine(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """``by`` with length, hash_a and hash_b of all parts (length, hash_a, hash_b) one after another.

    A part's hash moves up by the lengths of those before it.
    """
    before = F.coalesce(F.sum("length").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows, sums = parts.withColumn("_before", before), []
    for k, (modulus, base) in enumerate(FIELDS):
        term = F.pmod(F.col(f"hash_{'ab'[k]}") * _power(base, modulus, F.col("_before")), F.lit(modulus).cast("long"))
        sums.append(F.pmod(F.sum(term.cast("decimal(38,0)")), F.lit(modulus)).cast("long").alias(f"hash_{'ab'[k]}"))
    return rows.groupBy(*by).agg(F.sum("length").cast("long").alias("length"), *sums)


def assembly_violations(lines: DataFrame, parts: DataFrame, part_lines: DataFrame) -> DataFrame:
    """source_id and rule of each source whose parts, one after another, aren't its lines.

    ``lines`` has source_id, line_order (dense from 0) and text; ``parts``
    source_id and part_number; ``part_lines`` source_id, part_number, place
    (dense from 0 in the part) and text: what the parts really hold. Rules:
    "no parts", "no source", "part without lines", "part repeated", "lines"
    (their number differs) and "order or text" (the number is right, but a
    line was changed, or two changed places).
    """
    text = F.coalesce("text", F.lit(""))
    want = fingerprint(lines, ["source_id"], F.col("line_order").cast("long"), text)
    known = parts.groupBy("source_id", "part_number").agg(F.count("*").alias("n"))
    repeated = known.where("n > 1").select("source_id", F.lit("part repeated").alias("rule")).distinct()
    held = fingerprint(part_lines, ["source_id", "part_number"], F.col("place").cast("long"), text)
    both = known.select("source_id", "part_number").join(held, ["source_id", "part_number"], "left")
    empty = both.where("length IS NULL").select("source_id", F.lit("part without lines").alias("rule")).distinct()
    have = combine(both.where("length IS NOT NULL"), ["source_id"], "part_number").withColumnsRenamed({"length": "n", "hash_a": "a", "hash_b": "b"})
    met = want.join(have, "source_id", "full_outer")
    rule = F.when(F.col("n").isNull(), "no parts").when(F.col("length").isNull(), "no source").when(F.col("n") != F.col("length"), "lines").when((F.col("a") != F.col("hash_a")) | (F.col("b") != F.col("hash_b")), "order or text")
    return met.select("source_id", rule.alias("rule")).where("rule IS NOT NULL").union(repeated).union(empty)

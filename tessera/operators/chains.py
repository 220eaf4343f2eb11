"""Logs whose records name their predecessor's hash, and what a round's log has to hold.

A record's hash covers its chain, its place, its predecessor's hash and its
content, so nobody can change, drop or slip in a record without breaking the
links after it. Links are checked by joins on hashes: records of one chain
need not meet, and a long chain is no harder than many short ones.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.checkpoints import cut
from ..functions.groups import stream_groups

#: What the first record of a chain names as its predecessor.
GENESIS = "0" * 64
SEPARATOR = "\x1f"


def record_hash(chain: Column, place: Column, previous: Column, content: Column) -> Column:
    """The hash that a record with these fields has."""
    return T.sha256(F.concat_ws(SEPARATOR, chain.cast("string"), place.cast("string"), previous, content))


def seal(rows: DataFrame, chain: str, order: list[str], content: str) -> DataFrame:
    """chain, place, content, previous_hash, hash of ``rows``, in ``order`` within their chain.

    Sealing is sequential by its nature: a chain's contents pass through one
    function, chain by chain. Checking is not.
    """
    rows = rows.select(chain, *[c for c in order if c != content], F.coalesce(F.col(content), F.lit("")).alias(content))

    def run(name: object, group: dict[str, list]) -> list[tuple]:
        out, previous = [], GENESIS
        for place, text in enumerate(group[content]):
            digest = hashlib.sha256(SEPARATOR.join((str(name), str(place), previous, text)).encode()).hexdigest()
            out.append((name, place, text, previous, digest))
            previous = digest
        return out

    return stream_groups(rows, chain, order, run, f"`{chain}` {dict(rows.dtypes)[chain]}, place long, content string, previous_hash string, hash string")


def chain_violations(records: DataFrame, chain: str = "chain") -> DataFrame:
    """chain, place, rule of each record of a log that cannot be trusted.

    ``records`` has chain, place, content, previous_hash and hash. Rules:
    "content" (the hash isn't that of the record), "gap" (no record of the
    chain has the predecessor's hash), "fork" (another record names the same
    predecessor), "place" (it does not follow its predecessor's place by one)
    and "repeated" (the record stands twice).
    """
    # the records are read and hashed once; what they are compared by is written without their content
    changed = F.col("hash") != record_hash(F.col(chain), F.col("place"), F.col("previous_hash"), F.col("content"))
    rows = records.select(F.col(chain).alias("chain"), "place", "previous_hash", "hash", F.coalesce(changed, F.lit(False)).cast("long").alias("changed"))
    once = cut(rows.groupBy("chain", "hash", "place", "previous_hash").agg(F.count("*").alias("n"), F.sum("changed").alias("changed")))
    changed = once.where("changed > 0").select("chain", "place", F.explode(F.array_repeat(F.lit("content"), F.col("changed").cast("int"))).alias("rule"))
    repeated = once.where("n > 1").select("chain", "place", F.lit("repeated").alias("rule"))
    known = once.groupBy("chain", "hash").agg(F.min("place").alias("_before"))
    met = once.join(known.withColumnRenamed("hash", "previous_hash"), ["chain", "previous_hash"], "left")
    first = F.col("previous_hash") == GENESIS
    rule = F.when(first, F.when(F.col("place") != 0, "place")).when(F.col("_before").isNull(), "gap").when(F.col("place") != F.col("_before") + 1, "place")
    linked = met.select("chain", "place", rule.alias("rule")).where("rule IS NOT NULL")
    heirs = once.groupBy("chain", "previous_hash").agg(F.count_distinct("hash").alias("n")).where("n > 1").drop("n")
    forked = once.join(heirs, ["chain", "previous_hash"], "left_semi").select("chain", "place", F.lit("fork").alias("rule"))
    return changed.union(repeated).union(linked).union(forked)


#: The records that an annotator's part of a round consists of, in this order.
STEPS = ("assignment", "submission", "receipt", "attestation")


def completion_violations(events: DataFrame, annotators: DataFrame, steps: tuple[str, ...] = STEPS, independent: str = "independent") -> DataFrame:
    """round_id, annotator_id, rule where a round isn't complete.

    ``events`` has round_id, annotator_id, step, at, batch_sha256,
    subject_sha256, own_sha256 and a boolean ``independent`` of attestations;
    ``annotators`` round_id, annotator_id and the round's batch_sha256. Each
    annotator has every step once ("missing", "repeated"), none before the one
    it rests on ("order"), each bound to the round's batch ("batch") and to the
    hash of the step before ("binding"), and attests independence
    ("attestation"). Nobody else takes part ("unexpected").
    """
    number = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(steps) for x in (s, i)]), F.col("step"))
    rows = events.withColumn("_step", number)
    keys = ["round_id", "annotator_id"]
    stranger = rows.join(annotators, keys, "left_anti").select(*keys, F.lit("unexpected").alias("rule")).distinct()
    known = rows.join(annotators.select(*keys, F.col("batch_sha256").alias("_batch")), keys)
    n = known.where("_step IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("_step").alias("d"))
    counted = annotators.join(n, keys, "left")
    missing = counted.where(F.coalesce("d", F.lit(0)) < len(steps)).select(*keys, F.lit("missing").alias("rule"))
    repeated = counted.where("n > d").select(*keys, F.lit("repeated").alias("rule"))
    # a step rests on the one before: one lookup by its number
    before = known.groupBy(*keys, (F.col("_step") + 1).alias("_step")).agg(F.min("at").alias("_at"), F.min("own_sha256").alias("_own"))
    met = known.where("_step IS NOT NULL").join(before, [*keys, "_step"], "left")
    faults = F.array_compact(F.array(
        F.when(F.col("at") < F.col("_at"), "order"), F.when(~F.col("batch_sha256").eqNullSafe(F.col("_batch")), "batch"),
        F.when(F.col("_own").isNotNull() & ~F.col("subject_sha256").eqNullSafe(F.col("_own")), "binding"),
        F.when((F.col("step") == steps[-1]) & ~F.coalesce(independent, F.lit(False)), "attestation"),
    ))
    found = met.select(*keys, F.explode(faults).alias("rule")).distinct()
    return stranger.union(missing).union(repeated).union(found)

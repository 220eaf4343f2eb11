"""Shared helpers of the training-data operators.

Words are maximal runs of bytes outside space, tab, newline, vertical tab,
form feed and carriage return; ``bytes.split()`` cuts at exactly these six.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"
#: A side of a join is broadcast only after its rows were counted and are at most this many.
MAX_BROADCAST_ROWS = 200_000


#: Rows of one Arrow batch between the JVM and Python while a table is written: texts may be long.
BATCH_ROWS = 1_000

_kept: dict[str, tuple[Hashable, Any]] = {}


def kept(owner: str, key: Hashable, make: Callable[[Any], Any]) -> Any:
    """``make(key)``, kept in this Python worker until another owner or key needs the room.

    Workers outlive their stage; so they hold one operator's words at a time.
    """
    if owner not in _kept or _kept[owner][0] != key:
        _kept.clear()
        _kept[owner] = key, make(key)
    return _kept[owner][1]


def give_back() -> None:
    """Return memory that this Python worker has freed to the system; allocators would keep it, and workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Batches after which a worker gives back what it has freed.
TURN = 8


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back after every ``TURN`` batches that it hands on and at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(run(batches), 1):
            yield batch
            del batch
            if n % TURN == 0:
                give_back()
        give_back()

    return wrapped


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` as ``value`` for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    return (spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_CHECKPOINT_DIR).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage as a checkpoint does, but keeps column pruning and
    filter pushdown. The rows survive the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with short_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written with :func:`materialize`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than it must to know."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df``, with a broadcast hint if its counted size allows that; else Spark shuffles it."""
    return F.broadcast(df) if small(df, limit) else df


#: Groups with more than one of so many parts of all rows are fewer than these.
HOT_GROUPS = 1000
#: Rows up to which a table that is joined again and again is broadcast: the driver holds each for a while.
FEW_ROWS = 20_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size_col: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row for each ``key``, null among them.

    ``size_col`` is the number of a group's rows. Groups with more than a
    thousandth of all rows are fewer than a thousand, so they are broadcast
    and their rows stay where they are. The others meet in a shuffle in which
    no key has more than that share. Rows without a group are left out.
    """
    total = groups.agg(F.sum(size_col)).first()[0] or 0
    groups = groups.withColumnRenamed(key, "_group")
    hot, same = F.col(size_col) * HOT_GROUPS > F.lit(total), F.col(key).eqNullSafe(F.col("_group"))
    large = F.broadcast(groups.where(hot))
    stay = rows.join(large, same)
    meet = rows.join(large.select("_group"), same, "left_anti").join(groups.where(~hot), same)
    return stay.union(meet).drop("_group")


#: Rows of a group that meet its rows of another table in one part.
PART_ROWS = 1000


def join_parts(rows: DataFrame, table: DataFrame, key: str, size_col: str) -> DataFrame:
    """``rows`` joined with ``table``, which has few rows a key, whatever share of the rows a key has.

    Both have ``size_col``, the same for all rows of a key: as many rows as
    ``rows`` has of it, or more. A small table is broadcast. Beyond that a
    key's rows are dealt over parts of about ``PART_ROWS``, each of which gets
    its own copy of what the table has; every row is read once.
    """
    if small(table, FEW_ROWS):
        return rows.join(F.broadcast(table.drop(size_col)), key)
    parts = F.floor(F.col(size_col) / PART_ROWS) + 1
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), parts))
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(size_col)
    return dealt.join(copies, [key, "_part"]).drop("_part")


def mark_groups(rows: DataFrame, groups: DataFrame, key: str, size_col: str) -> DataFrame:
    """``rows`` with ``hit``: whether ``groups``, which has every key of more than one row and their number, has theirs.

    Beyond what can be broadcast, rows of hot groups stay where they are, as
    in :func:`join_groups`, and no key that is shuffled has many rows.
    """
    yes, same = F.lit(True).alias("hit"), F.col(key) == F.col("_group")
    groups = groups.withColumnRenamed(key, "_group")
    mark = lambda left, right: left.join(right.select("_group", yes), same, "left").drop("_group").withColumn("hit", F.coalesce("hit", F.lit(False)))
    if small(groups):
        return mark(rows, F.broadcast(groups))
    total = groups.agg(F.sum(size_col)).first()[0]
    hot = F.col(size_col) * HOT_GROUPS > F.lit(total)
    large = F.broadcast(groups.where(hot).select("_group"))
    stay = rows.join(large, same, "left_semi").withColumn("hit", F.lit(True))
    return stay.unionByName(mark(rows.join(large, same, "left_anti"), groups.where(~hot)))


def finite(vector) -> Any:
    """Whether a vector is not null and holds neither nulls nor components that aren't finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def usual_size(rows: DataFrame, vector_col: str) -> int:
    """The most frequent number of components (of two, the smaller); 0 without rows."""
    first = rows.groupBy(F.size(vector_col).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return first["size"] if first else 0


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows of ``df``: those with the least hash of ``keys``.

    Rows are first filtered by a hash threshold that leaves a fifth more than
    asked, so the tasks together hand on about as many rows as are kept.
    """
    place = F.pmod(F.xxhash64(F.lit(5), *keys), F.lit(1 << 40))
    n = df.count()
    if n > 1.2 * rows:
        df = df.where(place < F.lit(int(1.2 * rows / n * (1 << 40))))
    return df.orderBy(place, *keys).limit(rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int):
    """crc32 of the column's text, modulo ``m``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)

"""Operator 7: size-tiered compaction of immutable shards under a manifest.

Each append writes its rows as small shards that never change. A shard's tier
is how often its size doubles ``FANOUT``-fold from the smallest tier on. When a
tier has ``FANOUT`` shards or more, each run of its shards, in the order in
which they arrived, becomes one file of at most about the target size and takes
its shards' place in that order; nothing is shuffled. The manifest lists the
live shards of one version. A version is committed by renaming a complete file
to a name that must not exist, so of two writers one fails and starts again,
and readers of an older version keep their files until
:meth:`ShardStore.expire` is called.

Rows are kept as they come: nulls, empty and long texts, repeated rows and any
columns. No row is lost or changed; the order of rows within a merged file is
not defined. An empty arrival makes no version.

Arrivals may differ in their columns. A version's schema has every column that
any arrival had; where an arrival had none it is null. A column that comes in
several types has the widest, if that holds all values; an arrival whose type
cannot be reconciled, or whose name differs in case only, is refused before it
writes anything.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from . import common

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 1 << 20
FANOUT = 4
#: Runs that one job merges; each is a task.
JOB_RUNS = 64
#: Seconds for which files that no version lists are left alone: a writer may be about to commit them.
GRACE_SECONDS = 86_400
#: Arrivals that the query deals its table to.
ARRIVALS = 3
#: Rows of a shard at its arrival, at most.
ARRIVAL_ROWS = 20_000


class VersionConflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Shard:
    """A live file: its path below the store, size, rows, and place in the order of arrival."""

    path: str
    bytes: int
    rows: int
    first: int
    last: int


def tier(size: int, smallest: int = SMALLEST_BYTES, fanout: int = FANOUT) -> int:
    """0 below ``smallest`` times ``fanout``, then one more for each further factor."""
    n, edge = 0, smallest * fanout
    while size >= edge:
        n, edge = n + 1, edge * fanout
    return n


#: A type holds all values of those before it.
_WIDENING = (
    (t.ByteType(), t.ShortType(), t.IntegerType(), t.LongType()),
    (t.ByteType(), t.ShortType(), t.IntegerType(), t.DoubleType()),
    (t.FloatType(), t.DoubleType()),
)


def union_schema(known: t.StructType | None, new: t.StructType) -> t.StructType:
    """All columns of both, all nullable, in order of arrival; ``ValueError`` if types or names can't be reconciled."""
    fields = {f.name: f.dataType for f in known or []}
    for f in new:
        same = next((n for n in fields if n.lower() == f.name.lower()), f.name)
        if same != f.name:
            raise ValueError(f"columns {same!r} and {f.name!r} differ in case only")
        pair = fields.get(f.name, f.dataType), f.dataType
        wide = next((w for w in _WIDENING if pair[0] in w and pair[1] in w), None)
        if pair[0] != pair[1] and wide is None:
            raise ValueError(f"column {f.name!r} is {pair[0].simpleString()} in the store and {pair[1].simpleString()} in the arrival")
        fields[f.name] = pair[0] if pair[0] == pair[1] else wide[max(wide.index(p) for p in pair)]
    return t.StructType([t.StructField(n, k, True) for n, k in fields.items()])


def plan_merges(shards: list[Shard], target: int = TARGET_BYTES, smallest: int = SMALLEST_BYTES, fanout: int = FANOUT) -> list[list[Shard]]:
    """Runs of one tier that are to be merged, each of about ``target`` bytes.

    Shards of half the target or more are done. A tier with fewer than
    ``fanout`` shards waits for more.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.first, s.path)):
        if 2 * s.bytes < target:
            tiers.setdefault(tier(s.bytes, smallest, fanout), []).append(s)
    runs: list[list[Shard]] = []
    for same in tiers.values():
        if len(same) < fanout:
            continue
        run: list[Shard] = []
        for s in same:
            if run and sum(x.bytes for x in run) + s.bytes > target:
                runs.append(run)
                run = []
            run.append(s)
        runs.append(run)
    return [r for r in runs if len(r) > 1]


class ShardStore:
    """Shards and manifests below one folder that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, smallest: int = SMALLEST_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.smallest, self.fanout = target, smallest, fanout
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """A version and its live shards; 0 and none before the first."""
        version, live, _ = self._state(version)
        return version, live

    def schema(self, version: int | None = None) -> t.StructType | None:
        """The columns of a version; ``None`` before the first."""
        return self._state(version)[2]

    def _state(self, version: int | None = None) -> tuple[int, list[Shard], t.StructType | None]:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, [], None
        stream = self._fs.open(self._path(f"manifests/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return version, [Shard(**s) for s in found["shards"]], t.StructType.fromJson(found["schema"])

    def _commit(self, base: int, shards: list[Shard], schema: t.StructType | None = None) -> int:
        """Make ``shards`` the version after ``base``, or raise :class:`VersionConflict`; without ``schema``, the last one stays."""
        schema = schema or self.schema() or t.StructType()
        version = base + 1
        text = json.dumps({"version": version, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]})
        draft, final = self._path(f"manifests/.{uuid.uuid4().hex}.tmp"), self._path(f"manifests/v{version:010d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if not self._fs.exists(final):
                raise
            raise VersionConflict(f"version {version} exists") from e
        return version

    def _files(self, folder: str) -> list[tuple[str, int, int]]:
        """Path, size and rows of each file with rows that one write left."""
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        counts = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()  # one row a file
        return sorted((f"{folder}/{r['name']}", files[r["name"]], r["n"]) for r in counts)

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Add ``rows`` as new shards; no rows make no version."""
        union_schema(self.schema(), rows.schema)
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", arrival_rows).parquet(f"{self.root}/{folder}")
        files = self._files(folder)
        while files:
            version, live, known = self._state()
            at = max((s.last for s in live), default=-1) + 1
            fresh = [Shard(p, size, n, at + i, at + i) for i, (p, size, n) in enumerate(files)]
            try:
                return self._commit(version, live + fresh, union_schema(known, rows.schema))
            except VersionConflict:
                continue
        return self.manifest()[0]

    def compact(self) -> bool:
        """Merge what is due once; whether anything was. A lost race leaves files that no version lists."""
        version, live, schema = self._state()
        runs = plan_merges(live, self.target, self.smallest, self.fanout)
        if not runs:
            return False
        merged: list[Shard] = []
        for lo in range(0, len(runs), JOB_RUNS):
            merged += self._merge(runs[lo : lo + JOB_RUNS], schema)
        gone = {s for run in runs for s in run}
        try:
            self._commit(version, [s for s in live if s not in gone] + merged, schema)
        except VersionConflict:
            for s in merged:
                self._fs.delete(self._path(s.path), False)
        return True

    def _merge(self, runs: list[list[Shard]], schema: t.StructType) -> list[Shard]:
        """One file for each run, written by one job with a task a run."""
        folder, rows = f"data/{uuid.uuid4().hex}", None
        for run in runs:
            part = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run]).coalesce(1)
            rows = part if rows is None else rows.union(part)
        with common.setting(self.spark, "spark.sql.unionOutputPartitioning", "false"):  # else single partitions become one
            rows.write.option("maxRecordsPerFile", 0).parquet(f"{self.root}/{folder}")
        out, files = [], self._files(folder)
        if len(files) != len(runs):
            raise RuntimeError(f"{len(runs)} runs made {len(files)} files")
        for path, size, n in files:
            run = runs[int(path.rsplit("/", 1)[1].split("-")[1])]  # files bear the number of their task
            out.append(Shard(path, size, n, run[0].first, run[-1].last))
        return out

    def compact_all(self) -> int:
        """Compact until nothing is due; the last version."""
        while self.compact():
            pass
        return self.manifest()[0]

    def expire(self, grace_seconds: float = GRACE_SECONDS) -> None:
        """Delete all versions but the last, and the files that only they list.

        Files that no version lists may be those of a writer that hasn't
        committed yet, so they go only when older than ``grace_seconds``.
        """
        version, live = self.manifest()
        keep, listed = {s.path for s in live}, set()
        for v in self.versions():
            if v < version:
                listed |= {s.path for s in self.manifest(v)[1]}
                self._fs.delete(self._path(f"manifests/v{v:010d}.json"), False)
        before = (time.time() - grace_seconds) * 1000
        for folder in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            name = f"data/{folder.getPath().getName()}"
            for f in self._fs.listStatus(folder.getPath()):
                path = f"{name}/{f.getPath().getName()}"
                if path not in keep and (path in listed or f.getModificationTime() < before):
                    self._fs.delete(f.getPath(), False)

    def read(self, version: int | None = None, path_col: str | None = None) -> DataFrame | None:
        """The rows of a version, and in ``path_col``, if given, their file's path; ``None`` before the first.

        ``path_col`` must not be the name of one of the table's own columns.
        """
        _, live, schema = self._state(version)
        if not live:
            return None
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in live])
        if path_col is None:
            return rows
        if path_col in rows.columns:
            raise ValueError(f"the rows have a column {path_col!r} of their own")
        return rows.withColumn(path_col, F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)$", 1))


def op7_tiered_shards(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` appended in several arrivals, each compacted, and read back.

    Per row: doc_id, its text's crc32 and bytes as the live shard holds them,
    the shard's number in the order of the manifest, its bytes, rows, tier and
    the manifest's version. An empty table gives no row.
    """
    store = ShardStore(spark, common.scratch_path(spark, "op7-store"))
    docs = common.table(spark, sf_dir, "documents")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        store.compact_all()
        store.expire()
    rows, (version, live) = store.read(path_col="_shard_path"), store.manifest()
    if rows is None:
        return spark.createDataFrame([], "doc_id long, text_crc32 long, text_bytes int, shard_no int, shard_bytes long, shard_rows long, tier int, version int")
    listed = [(s.path, i, s.bytes, s.rows, tier(s.bytes)) for i, s in enumerate(sorted(live, key=lambda s: (s.first, s.path)))]
    shards = spark.createDataFrame(listed, "_shard_path string, shard_no int, shard_bytes long, shard_rows long, tier int")
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), F.octet_length(text).alias("text_bytes"), "_shard_path")
    return rows.join(common.maybe_broadcast(shards), "_shard_path").drop("_shard_path").withColumn("version", F.lit(version))

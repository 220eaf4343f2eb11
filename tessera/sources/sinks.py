"""Writing without overwriting: an output appears whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class OutputExists(FileExistsError):
    """The output is there already."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Move ``source`` to ``target``, which must not exist, in one step."""
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    _, fs = _fs(spark, target)
    if fs.exists(dst):
        raise OutputExists(target)
    fs.mkdirs(dst.getParent())
    try:
        context.rename(src, dst, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        raise OutputExists(target) from e


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def new_name() -> str:
    """A name that no other output has."""
    return uuid.uuid4().hex


def publish(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write rows below a temporary name beside ``path`` and move them there."""
    publish_all(df.sparkSession, {path: (df, fmt)})


def publish_all(spark: SparkSession, outputs: dict[str, tuple[DataFrame, str]]) -> None:
    """Several outputs or none: all are written first, and what was moved is taken back on an error."""
    for path in outputs:
        p, fs = _fs(spark, path)
        if fs.exists(p):
            raise OutputExists(path)
    drafts, moved = {path: f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp" for path in outputs}, []
    try:
        for path, (df, fmt) in outputs.items():
            df.write.format(fmt).save(drafts[path])
        for path in outputs:
            _rename(spark, drafts[path], path)
            moved.append(path)
    except Exception:
        for path in [*moved, *drafts.values()]:
            p, fs = _fs(spark, path)
            fs.delete(p, True)
        raise


def publish_object(spark: SparkSession, value: dict, path: str, sort_keys: bool = False) -> None:
    """One JSON object, indented by two, with a line break at its end."""
    text = json.dumps(value, indent=2, ensure_ascii=False, sort_keys=sort_keys) + "\n"
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    _write_text(spark, draft, text)
    try:
        _rename(spark, draft, path)
    except Exception:
        p, fs = _fs(spark, draft)
        fs.delete(p, False)
        raise


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The object published as ``v<number>.json`` below ``folder``, by default the one with the largest number."""
    p, fs = _fs(spark, folder)
    if version is None:
        version = max(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
    stream = fs.open(_fs(spark, f"{folder}/v{version:010d}.json")[0])
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_report(df: DataFrame, path: str, title: str, by: str) -> None:
    """Counts of a column as text, most frequent first."""
    rows = df.groupBy(by).count().orderBy("count", by, ascending=[False, True])
    lines = rows.selectExpr(f"concat_ws(': ', coalesce(cast({by} AS string), '-'), cast(count AS string)) AS value")
    head = df.sparkSession.createDataFrame([(title,), ("",)], "value string")
    publish(head.union(lines).coalesce(1), path, "text")

"""JSON lines and single JSON objects with closed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SourceError(ValueError):
    """An input doesn't have the form that its reader promises."""


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, blank_lines: bool = True, allow_empty: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; a line that isn't an object of the schema is an error.

    Unknown fields are errors too. Blank lines are skipped, or errors if
    ``blank_lines`` is false.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path)
    if not blank_lines and not lines.where(F.trim("value") == "").isEmpty():
        raise SourceError(f"{path}: blank line")
    lines = lines.where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    extra = F.array_except(keys, F.array(*[F.lit(f.name) for f in wanted.fields]))
    bad = lines.where(keys.isNull() | (F.size(extra) > 0)).limit(1).collect()
    if bad:
        raise SourceError(f"{path}: not an object with known fields: {bad[0][0][:200]}")
    if not allow_empty and lines.isEmpty():
        raise SourceError(f"{path}: empty")
    return lines.select(F.from_json("value", wanted, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The one object of a file, as one row."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(wanted).json(path)
    if rows.count() != 1:
        raise SourceError(f"{path}: not one object")
    return rows

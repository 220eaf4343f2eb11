"""What a blinded record must not say, at any depth."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut


def leaks(rows: DataFrame, column: str, forbidden: Iterable[str], key: str = "case_id") -> DataFrame:
    """key and path of every field of ``column`` (JSON) that has a forbidden name, wherever it is nested.

    The records are walked as variants, a level at a time: each level's fields
    and elements are rows, and those that hold others are the next level.
    Names are compared in lower case. Paths are written as ``$.a[0].b``. A
    text that isn't JSON has the path ``$`` alone.
    """
    names = sorted({f.lower() for f in forbidden})
    parsed = rows.select(F.col(key).alias("id"), F.try_parse_json(column).alias("value"), F.col(column).isNotNull().alias("given"))
    found = parsed.where("given AND value IS NULL").select("id", F.lit("$").alias("path"))
    level = parsed.where("value IS NOT NULL").select("id", F.lit("$").alias("path"), "value")
    while True:
        level.createOrReplaceTempView("_blinding_level")
        fields = level.sparkSession.sql("SELECT id, path || CASE WHEN e.key IS NULL THEN '[' || e.pos || ']' ELSE '.' || e.key END AS path, e.key AS name, e.value AS value FROM _blinding_level, LATERAL variant_explode(value) AS e")
        kind = F.schema_of_variant("value")
        nested = fields.withColumn("nested", kind.startswith("OBJECT") | kind.startswith("ARRAY")).select("id", "path", "name", F.when(F.col("nested"), F.to_json("value")).alias("value"))
        fields = cut(nested)
        found = found.union(fields.where(F.lower("name").isin(names)).select("id", "path"))
        level = fields.where("value IS NOT NULL").select("id", "path", F.parse_json("value").alias("value"))
        if level.isEmpty():
            return found.select(F.col("id").alias(key), "path")

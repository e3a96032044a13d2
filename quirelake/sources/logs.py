"""Logs of one JSON object a line: damaged lines apart, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sort keys of a line: file by time and name, part of the file, line in the part.
AT = ["file_time", "file", "part", "line"]


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files with their place in the log (``AT``); no line is moved to find it.

    A part of a file is read by one task in order, so the running number that Spark gives
    the rows of a task orders its lines, and the start of the part orders the parts.
    """
    rows = spark.read.text(path)
    place = [F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part")]
    return rows.select("value", *place).withColumn("line", F.monotonically_increasing_id()).filter(F.trim("value") != "")


def parsed(lines: DataFrame, schema: T.StructType, required: list[str]) -> DataFrame:
    """``record`` of each line and ``reason`` why it is damaged (null for a good one): no JSON, or a required field missing or of another type."""
    loose = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    read = lines.withColumn("record", F.from_json("value", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    whole = F.try_parse_json("value")
    no_object = whole.isNull() | ~F.startswith(F.schema_of_variant(whole), F.lit("OBJECT"))
    lacking = F.lit(False)
    for name in required:
        lacking = lacking | F.col("record")[name].isNull()
    reason = F.when(no_object, "no_json").when(F.col("record.__corrupt").isNotNull() | lacking, "invalid")
    return read.withColumn("reason", reason).withColumn("record", F.struct(*[F.col(f"record.{f.name}") for f in schema.fields]))


def newest(spark: SparkSession, path: str, schema: T.StructType, required: list[str], most: int) -> DataFrame:
    """The ``most`` newest good records, newest first: a top-k over the log, not a sort of it."""
    good = parsed(log_lines(spark, path), schema, required).filter("reason IS NULL")
    return good.orderBy(*[F.desc(c) for c in AT]).limit(most).select("record.*")


def damaged(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """The damaged lines with their place and reason."""
    return parsed(log_lines(spark, path), schema, required).filter("reason IS NOT NULL").select(*AT, "value", "reason")

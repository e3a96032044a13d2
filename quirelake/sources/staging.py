"""Tables that a plan reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where the session names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="quirelake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read again: later plans start from the table, also after a lost executor."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/quirelake/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def in_order(rows: DataFrame, *keys) -> DataFrame:
    """``rows`` range-partitioned and sorted by ``keys``; the partitions keep their order through a checkpoint."""
    shared_folder(rows.sparkSession)
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint(eager=True)

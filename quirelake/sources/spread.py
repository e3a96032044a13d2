"""Enough partitions for work that is heavy for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt over all cores if they come in fewer partitions than there are cores.

    A small file of one row group is one task however large its texts are; an input
    that fills the cluster is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

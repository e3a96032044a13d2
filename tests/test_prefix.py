import random

import pytest
from pyspark.sql import functions as F

from quirelake.operators.prefix import running_totals
from quirelake.sources import staging


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_equals_a_window(spark, parts):
    """Groups that span partitions, single rows, nulls, and one group with most rows."""
    r = random.Random(parts)
    rows = [(r.choice(["a"] * 20 + ["b", "c", None, ""] + [f"g{i}" for i in range(9)]), i, r.choice([None, 0, 5, 2**40]), "x") for i in range(900)]
    table = spark.createDataFrame(rows, "g string, n int, size long, part string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = running_totals(table, group=F.col("g"), order=[F.col("n")], size=F.col("size"), total="total", number="number").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, sums, counts = {}, {}, {}
    for g, n, size, _ in sorted(rows, key=lambda x: x[1]):
        sums[g], counts[g] = sums.get(g, 0) + (size or 0), counts.get(g, 0) + 1
        want[n] = (g, sums[g], counts[g])
    assert {x.n: (x.g, x.total, x.number) for x in got} == want
    assert len(got) == len(rows) and all(x.part == "x" for x in got)


def test_no_window_and_an_empty_table(spark):
    table = spark.range(0).select(F.lit("g").alias("g"), F.col("id").alias("n"))
    got = running_totals(table, group=F.col("g"), order=[F.col("n")], size=F.lit(1), total="t")
    assert got.count() == 0 and "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_staged_tables_are_read_from_storage(spark):
    table = staging.staged(spark.range(7), "numbers")
    assert table.count() == 7 and "FileScan parquet" in table._jdf.queryExecution().executedPlan().toString()

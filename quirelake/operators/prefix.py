"""Running totals over groups of any size, without a window that holds a group in one task.

Rows are range-partitioned and sorted by group and order, so a group may lie in many
partitions.  Each partition reports what its last group sums to; those few numbers,
one row for each partition, give every partition the total its first group starts
from.  Then a running total needs its own partition only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import in_order

_SIZE, _GROUP = "__size", "__group"


def _bounds(groups: pa.Array) -> np.ndarray:
    """Places at which a new group begins, the first one included."""
    if len(groups) < 2:
        return np.zeros(len(groups), np.int64)
    before, after = groups[:-1], groups[1:]
    same = pc.fill_null(pc.equal(before, after), False).to_numpy(zero_copy_only=False) | (pc.is_null(before).to_numpy(zero_copy_only=False) & pc.is_null(after).to_numpy(zero_copy_only=False))
    return np.concatenate([[0], np.nonzero(~same)[0] + 1])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def running_totals(rows: DataFrame, *, group: Column, order: list[Column], size: Column, total: str, number: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``size`` (a long) up to and with each row in its group.

    ``number`` names a column for the row's number in its group, from 1.  Ties in
    ``order`` go by all columns' values in the sort, so give an order without ties.
    A null size counts 0; null groups are one group.
    """
    keyed = rows.withColumns({_GROUP: group.cast("string"), _SIZE: F.coalesce(size.cast("long"), F.lit(0))})
    ordered = in_order(keyed, F.col(_GROUP), *order)

    def last_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        summed = counted = 0
        one = True
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, sizes = _column(batch, _GROUP), _column(batch, _SIZE).to_numpy(zero_copy_only=False)
            at = int(_bounds(groups)[-1])
            names = groups[0].as_py(), groups[len(groups) - 1].as_py()
            if first is None:
                first, last = (names[0],), (names[0],)
            if at or last != (names[1],):
                summed, counted, one = 0, 0, False
            last = (names[1],)
            summed, counted = summed + int(sizes[at:].sum()), counted + len(sizes) - at
        if first:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array([summed], pa.int64()), pa.array([counted], pa.int64()), pa.array([one])],
                names=["part", "first", "last", "summed", "counted", "one"],
            )

    ends = ordered.select(_GROUP, _SIZE).mapInArrow(last_of, "part long, first string, last string, summed long, counted long, one boolean").collect()
    starts: dict[int, tuple[int, int]] = {}
    open_group, carried = None, (0, 0)
    for r in sorted(ends, key=lambda r: r["part"]):
        before = carried if open_group == (r["first"],) else (0, 0)
        starts[r["part"]] = before
        own = (r["summed"], r["counted"])
        carried = (before[0] + own[0], before[1] + own[1]) if r["one"] else own
        open_group = (r["last"],)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed, counted = starts.get(TaskContext.get().partitionId(), (0, 0))
        current: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, sizes = _column(batch, _GROUP), _column(batch, _SIZE).to_numpy(zero_copy_only=False)
            bounds = _bounds(groups)
            if current is not None and current != (groups[0].as_py(),):
                summed = counted = 0
            sums, places = np.cumsum(sizes), np.arange(1, len(sizes) + 1)
            lengths = np.diff(np.append(bounds, len(sizes)))
            base = np.concatenate([[0], sums])[bounds]
            base[0] -= summed
            offset = bounds.copy()
            offset[0] -= counted
            sums, places = sums - np.repeat(base, lengths), places - np.repeat(offset, lengths)
            summed, counted, current = int(sums[-1]), int(places[-1]), (groups[len(groups) - 1].as_py(),)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "__total", "__number"])

    schema = T.StructType([*ordered.schema.fields, T.StructField("__total", T.LongType()), T.StructField("__number", T.LongType())])
    found = ordered.mapInArrow(run, schema)
    named = [F.col("__total").alias(total)] + ([F.col("__number").alias(number)] if number else [])
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *named)

"""Contiguous shards of near-equal byte size.

Rows are range-partitioned and sorted by key.  Each partition reports one total;
prefix sums of those totals give every partition its global byte and row offset,
so the position of each row is known without ordering all rows in one task.
Cuts lie at equal byte targets: a row belongs to the shard that holds its middle
byte, so shard sizes differ by at most one row's size.

Defined cases: a null text counts 0 bytes; ``size`` is bytes + 1, so empty rows
also have a place; null keys come first; equal keys are ordered by size and
checksum, and rows equal in all three are interchangeable; an empty table gives
an empty result; a text of any length is one row and is never cut.  Shards follow
the key order only: groups of equal texts may be split by a cut.
Only one total per partition and one row per shard reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

SIZE, CRC, SHARD, SLOT = "__size", "__crc", "__shard", "__slot"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = rows = 0
    for batch in batches:
        size += pa.compute.sum(batch.column(0)).as_py() or 0
        rows += batch.num_rows
    if rows:
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "bytes": [size], "rows": [rows]})


class _Placer:
    """Adds shard and global row number to the rows of a partition."""

    def __init__(self, offsets: dict[int, tuple[int, int]], cuts: list[int]):
        self.offsets, self.cuts = offsets, np.array(cuts, np.int64)

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        start, row = self.offsets.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            size = batch.column(batch.schema.get_field_index(SIZE)).to_numpy(zero_copy_only=False)
            ends = start + np.cumsum(size)
            twice_middle = 2 * ends - size
            yield batch, np.searchsorted(self.cuts, twice_middle, side="right").astype(np.int32), row + np.arange(len(size))
            start, row = int(ends[-1]) if len(ends) else start, row + len(size)


def balanced_shards(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", payload: Sequence[str] = ()) -> DataFrame:
    """Assign every row of ``docs`` to one of ``shards`` contiguous shards.

    Returns the key, the ``payload`` columns and ``__size``, ``__crc``
    (crc32 of the UTF-8 bytes), ``__shard``, ``__slot`` (row number in the shard).
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = list(dict.fromkeys([key, *payload]))
    base = docs.select(*names, (F.octet_length(body).cast("long") + 1).alias(SIZE), F.crc32(body).alias(CRC))
    order = [F.col(key), F.col(SIZE), F.col(CRC)]
    runs = cut(base.repartitionByRange(*order).sortWithinPartitions(*order))

    offsets, size, rows = {}, 0, 0
    for part, n_bytes, n_rows in sorted(runs.select(SIZE).mapInArrow(_totals, "part long, bytes long, rows long").collect()):
        offsets[part] = (size, rows)
        size, rows = size + n_bytes, rows + n_rows
    placer = _Placer(offsets, [-(-2 * k * size // shards) for k in range(1, shards)])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard, row in placer.place(batches):
            ids, at = np.unique(shard, return_index=True)
            yield pa.RecordBatch.from_pydict({"shard": ids, "row": row[at]})

    first = dict(runs.select(SIZE).mapInArrow(firsts, "shard int, row long").groupBy("shard").agg(F.min("row")).collect())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_row = np.array([first.get(s, 0) for s in range(shards)], np.int64)
        for batch, shard, row in placer.place(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(row - base_row[shard])], names=[*batch.schema.names, SHARD, SLOT])

    schema = T.StructType([*runs.schema.fields, T.StructField(SHARD, T.IntegerType()), T.StructField(SLOT, T.LongType())])
    return runs.mapInArrow(placed, schema)


def write_shards(docs: DataFrame, path: str, shards: int, *, key: str = "doc_id", text: str = "text") -> None:
    """Write the rows of ``docs`` as Parquet under ``path/shard=K``, each in key order.

    Where ``docs`` has a column ``shard`` of its own, the folders are named ``shard_=K``.
    """
    folder = "shard"
    while folder in {c.lower() for c in docs.columns}:
        folder += "_"
    rows = balanced_shards(docs, shards, key=key, text=text, payload=docs.columns)
    rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(SHARD).alias(folder)).write.partitionBy(folder).parquet(path)

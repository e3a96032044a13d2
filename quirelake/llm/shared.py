"""What the operators have in common: shared storage, Arrow helpers, word access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``.  Only where the session
    names none (local runs, tests) is a folder of our own set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="quirelake-")
        context.setCheckpointDir(named)
        return "file://" + named if "://" not in named else named
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


class Scratch:
    """Parquet tables of one run in the shared folder; they outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/quirelake/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, hashes: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and read it again: cuts the lineage, keeps nothing in executors.

        For the columns ``hashes`` no dictionary is tried.
        """
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that keeps partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without building Python strings."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of ``column``, one row at least."""
    for batch in batches:
        text = batch.column(column)
        size = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end


class WordHashes(dict):
    """Cache of 64-bit word hashes; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser (splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

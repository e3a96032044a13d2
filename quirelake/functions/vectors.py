"""Vector functions: norms, cosine, hashed bags of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.spread import spread
from .bind import bound
from .text import hash_bucket


def norm(v: Column) -> Column:
    """Euclidean norm; 1 for a zero vector."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hashed_bow(table: DataFrame, key: str, text: str, size: int = 128) -> DataFrame:
    """Non-zero entries of unit-length hashed bags of blank-separated lower-case words."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    counts = spread(table.select(key, text)).select(key, F.explode(words).alias("w")).groupBy(key, hash_bucket(F.col("w"), size).alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def hashed_vectors(table: DataFrame, key: str, text: str, size: int = 128) -> DataFrame:
    """The same vectors as dense arrays (``vector``).

    A row's words are counted where it is read and each distinct word of a batch is hashed
    once, hence the Arrow function; what is shuffled is one array of counts a row.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    rows = spread(table.select(key, text)).select(key, words.alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            bucket = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % size for w in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            counts = np.bincount(row * size + bucket[coded.indices.to_numpy(zero_copy_only=False)], minlength=batch.num_rows * size).reshape(-1, size)
            some = np.nonzero(counts.any(axis=1))[0]
            flat = pa.array(counts[some].ravel(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * size, pa.int32()), flat)], names=[key, "n"])

    counted = rows.mapInArrow(count, f"`{key}` {rows.schema[key].dataType.simpleString()}, n array<int>")
    together = counted.groupBy(key).agg(F.collect_list("n").alias("all"))
    summed = F.aggregate("all", F.array_repeat(F.lit(0), size), lambda s, n: F.zip_with(s, n, lambda x, y: x + y))
    n = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(summed)
    norm_of = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return together.select(key, bound(n, lambda v: bound(norm_of(v), lambda length: F.transform(v, lambda x: x / length))).alias("vector"))

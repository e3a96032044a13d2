"""A persistent approximate index over vectors: cells by trained centroids, residual codes, versions.

The index is a folder of Parquet tables that any Spark session can read:

    centroids                  cell, vector; trained once, on a bounded sample
    rows/cell=K/...            item, document, version, scale, code, vector
    removed                    document, version

Vectors have length 1, so the inner product is the cosine.  A vector goes to the cell
of its nearest centroid; what it differs from it by is kept as one byte a component
(``code``, times ``scale``).  A search asks the ``probes`` nearest cells of each query,
which are partitions of the table, so others are not read.  There it ranks by codes,
keeps ``k * rerank`` candidates for each query and task, and ranks those anew by their
own vectors.

Writes are appends.  An upsert writes the new rows under the next version and removes
the document's older ones by a row in ``removed``; a removal writes only that row.
Readers leave out a row if its document was removed at a later version, so a search
beside a write sees the old rows or the new ones.  ``compacted`` writes an index anew
without the rows that are gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .retrieval import ranked

#: Vectors that the centroids are trained on, for each cell; rounds of training.
SAMPLE_PER_CELL, ROUNDS = 64, 12
#: Queries on which the number of probes is measured.
CALIBRATION_ROWS = 256
#: Queries sent to a task at once (their vectors and cells).
BLOCK_ROWS = 4096


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1.0, length)


def trained_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of length 1 by spherical k-means, from evenly spaced rows of the sample."""
    points = _units(sample)
    centroids = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        filled = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids[filled] = _units(sums[filled])
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """The index under ``path``; ``item`` and ``document`` are columns of what is written to it."""

    spark: SparkSession
    path: str
    item: str = "item"
    document: str = "document"

    @classmethod
    def create(cls, path: str, rows: DataFrame, *, cells: int, item: str, document: str, vector: str = "vector") -> VectorIndex:
        """Train the cells on a sample of ``rows`` and write all of them as version 1.

        The sample is the ``SAMPLE_PER_CELL * cells`` rows of smallest hash of their item.
        """
        index = cls(rows.sparkSession, path.rstrip("/"), item, document)
        usable = index._usable(rows, vector)
        sample = usable.orderBy(F.xxhash64(F.lit(7), F.col(item).cast("string")), item).limit(SAMPLE_PER_CELL * cells).select(F.col(vector).alias("v")).collect()
        if not sample:
            raise ValueError("no vector to train the cells on")
        centroids = trained_cells(np.array([r["v"] for r in sample], np.float64), cells)
        table = index.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, vector array<double>")
        table.coalesce(1).write.parquet(f"{index.path}/centroids")
        index.spark.createDataFrame([], f"document {rows.schema[document].dataType.simpleString()}, version long").write.parquet(f"{index.path}/removed")
        index._append(usable, vector, 1)
        return index

    def _usable(self, rows: DataFrame, vector: str) -> DataFrame:
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return rows.filter(F.col(self.item).isNotNull() & (F.size(vector) > 0) & finite)

    def centroids(self) -> np.ndarray:
        """A parameter's number of rows, so they fit the driver and a broadcast."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.array([r["vector"] for r in rows], np.float64)

    def _append(self, rows: DataFrame, vector: str, version: int) -> None:
        centroids = self.centroids()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = _units(_matrix(batch.column(2)))
                if points.shape[1] != centroids.shape[1]:
                    raise ValueError(f"vectors of {points.shape[1]} components in an index of {centroids.shape[1]}")
                cell = (points @ centroids.T).argmax(axis=1)
                residual = points - centroids[cell]
                scale = np.maximum(np.abs(residual).max(axis=1), 1e-12) / 127
                codes = np.rint(residual / scale[:, None]).astype(np.int8)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * points.shape[1]), pa.array(points.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary()), vectors, pa.array(cell.astype(np.int32))], names=["item", "document", "scale", "code", "vector", "cell"])

        kinds = [rows.schema[c].dataType.simpleString() for c in (self.item, self.document)]
        given = rows.select(F.col(self.item), F.col(self.document), F.col(vector).cast("array<double>"))
        coded = given.mapInArrow(encode, f"item {kinds[0]}, document {kinds[1]}, scale float, code binary, vector array<float>, cell int")
        # A cell may hold many rows, so it is dealt over tasks by item, not gathered in one.
        dealt = coded.withColumn("version", F.lit(version).cast("long")).repartition("cell", F.pmod(F.xxhash64("item"), F.lit(8)))
        dealt.write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def version(self) -> int:
        newest = lambda name: self.spark.read.parquet(f"{self.path}/{name}").agg(F.max("version")).first()[0] or 0
        return max(newest("rows"), newest("removed"))

    def remove(self, documents: DataFrame) -> None:
        """All rows of the documents (a column ``document``) go."""
        self._remove(documents.select(F.col(self.document).alias("document")), self.version() + 1)

    def _remove(self, documents: DataFrame, version: int) -> None:
        documents.filter("document IS NOT NULL").distinct().withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{self.path}/removed")

    def upsert(self, rows: DataFrame, vector: str = "vector") -> None:
        """Write documents anew: all their older rows go, also those that ``rows`` no longer has."""
        version = self.version() + 1
        usable = self._usable(rows, vector)
        self._append(usable, vector, version)
        # The old rows go last: a failure in between leaves both, never none.
        self._remove(rows.select(F.col(self.document).alias("document")), version)

    def rows(self) -> DataFrame:
        """The rows that are there now: of a repeated write of an item in one version, any one counts."""
        stored = self.spark.read.parquet(f"{self.path}/rows")
        gone = self.spark.read.parquet(f"{self.path}/removed").groupBy(F.col("document").alias("__d")).agg(F.max("version").alias("__v"))
        return stored.join(gone, (F.col("document") == F.col("__d")) & (F.col("version") < F.col("__v")), "left_anti")

    def compacted(self, path: str) -> VectorIndex:
        """The same index under another path, without removed rows."""
        path = path.rstrip("/")
        self.spark.read.parquet(f"{self.path}/centroids").coalesce(1).write.parquet(f"{path}/centroids")
        self.spark.read.parquet(f"{self.path}/removed").limit(0).write.parquet(f"{path}/removed")
        self.rows().repartition("cell", F.pmod(F.xxhash64("item"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
        return VectorIndex(self.spark, path, self.item, self.document)

    def search(self, queries: DataFrame, k: int, *, query: str, vector: str = "vector", probes: int = 8, rerank: int = 4, within: Column | None = None, skip_self: bool = False) -> DataFrame:
        """(query, item, score, rank): cosine to nine places, ties to the smaller item.

        ``within`` filters rows before the search, by ``document`` for one; queries of
        null or unusable vectors find nothing.
        """
        centroids = self.centroids()
        asked = queries.filter(F.col(query).isNotNull() & (F.size(vector) == centroids.shape[1])).select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v"))
        blocks = max(1, -(-asked.count() // BLOCK_ROWS))
        stored = self.rows() if within is None else self.rows().filter(within)
        kinds = asked.schema["q"].dataType.simpleString(), stored.schema["item"].dataType.simpleString()
        found = None
        for block in range(blocks):
            own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
            given = own.orderBy("q").collect()
            if not given:
                continue
            wanted = _units(np.array([r["v"] for r in given], np.float64))
            near = np.argsort(-(wanted @ centroids.T), axis=1, kind="stable")[:, :probes]
            part = stored.filter(F.col("cell").isin(np.unique(near).tolist())).select("item", "cell", "scale", "code", "vector")
            body = _searcher([r["q"] for r in given], wanted, near, centroids, k, k * rerank, skip_self, to_arrow_type(asked.schema["q"].dataType))
            part = part.mapInArrow(body, f"{query} {kinds[0]}, item {kinds[1]}, score double")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return stored.select(F.lit(None).cast(kinds[0]).alias(query), "item", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        return ranked(found.withColumn("score", F.round("score", 9)).dropDuplicates([query, "item"]), query, "item", k)


    def probes_for(self, queries: DataFrame, k: int, *, query: str, vector: str = "vector", recall: float = 0.9, skip_self: bool = False) -> int:
        """The fewest probes with which the true k best of sample queries lie in asked cells, to the share ``recall``.

        The sample is the ``CALIBRATION_ROWS`` queries of smallest hash, searched exactly.
        """
        centroids = self.centroids()
        sample = queries.orderBy(F.xxhash64(F.lit(11), F.col(query).cast("string"))).limit(CALIBRATION_ROWS)
        best = self.search(sample, k, query=query, vector=vector, probes=len(centroids), rerank=1 << 20, skip_self=skip_self)
        cells = best.join(self.rows().select("item", "cell"), "item").select(F.col(query).alias("q"), "cell").collect()
        wanted = {r["q"]: r["v"] for r in sample.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v")).collect() if r["v"] is not None}
        order = {q: np.argsort(-(centroids @ np.array(v)), kind="stable").tolist() for q, v in wanted.items() if len(v) == centroids.shape[1]}
        places = sorted(order[r["q"]].index(r["cell"]) + 1 for r in cells)
        return places[max(0, int(np.ceil(recall * len(places))) - 1)] if places else 1


def _searcher(ids: list, wanted: np.ndarray, near: np.ndarray, centroids: np.ndarray, k: int, most: int, skip_self: bool, key_type: pa.DataType):
    """Per batch and query: the best by codes, ranked by their vectors; k of each batch are kept."""
    asking: dict[int, np.ndarray] = {}
    for cell in np.unique(near).tolist():
        asking[cell] = np.nonzero((near == cell).any(axis=1))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1).to_numpy(zero_copy_only=False)
            items = batch.column(0).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            candidates: dict[int, tuple[list, list]] = {}
            for cell in np.unique(cells).tolist():
                here, rows = asking[cell], np.nonzero(cells == cell)[0]
                codes = np.frombuffer(b"".join(batch.column(3).take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), -1)
                scale = batch.column(2).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.float64)
                rough = (wanted[here] @ centroids[cell])[:, None] + (wanted[here] @ codes.T.astype(np.float64)) * scale[None, :]
                for q, scores in zip(here.tolist(), rough, strict=True):
                    mine = candidates.setdefault(q, ([], []))
                    mine[0].append(rows)
                    mine[1].append(scores)
            vectors = batch.column(4)
            for q, (rows, scores) in candidates.items():
                at, score = np.concatenate(rows), np.concatenate(scores)
                if len(at) > most:
                    at = at[np.argpartition(-score, most - 1)[:most]]
                exact = _units(_matrix(vectors.take(pa.array(at)))) @ wanted[q]
                best = np.argsort(-exact, kind="stable")[: k + skip_self]
                # Ties at the edge stay: the final ranking decides by item.
                floor = exact[best[-1]] - 1e-9
                for i in np.nonzero(exact >= floor)[0].tolist():
                    item = items[int(at[i])]
                    if not (skip_self and item == ids[q]):
                        out[0].append(ids[q])
                        out[1].append(item)
                        out[2].append(float(exact[i]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], key_type), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.float64())], names=["q", "item", "score"])

    return run

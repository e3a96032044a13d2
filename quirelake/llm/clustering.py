"""Plain Lloyd clustering of integer vectors, exact to the last unit.

The centroids are broadcast (``clusters * width`` integers, both parameters).  In each
round ``mapInPandas`` takes the squared differences to one centroid after the other in
NumPy, the lowest index wins ties, and every partition gives one sum for each cluster
and component; ``groupBy`` merges these.  A sum travels as limbs of 32 bits, so that
no number of rows overflows it, and so does the sum of distances.  Only the merged
sums, one for each cluster and component, reach the driver.

Components are ``floor(scale * x)``.  Where any of a batch is 2^27 or more in size the
batch is computed with Python integers instead of 64-bit ones, so results stay exact.

Defined cases: vectors that are null, of another width, or hold a null or non-finite
component take no part; a null id is clustered like any other but is a first centroid
only if there are too few others; repeated rows are clustered each, and of equal ids
the smaller vector comes first among the first centroids; a cluster that loses its
vectors keeps its centroid; with fewer vectors than clusters there are as many
clusters as vectors; an empty table gives an empty result; a distance or a sum beyond
the range of a long is its largest value; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

Centroids = list[list[int]]
#: Components below this leave room for 2^7 squared differences in 64 bits.
NARROW = 1 << 27
LIMB = 32
LONGEST = (1 << 63) - 1


def usable(vector: str, width: int) -> Column:
    """Whether the vector has ``width`` components, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def integers(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """``floor(scale * x)`` of all components: 64-bit integers, or Python's where these would not do."""
    x = np.stack(vectors).astype(np.float64)
    if np.abs(x).max() < NARROW / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[math.floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in row] for row in x.tolist()], dtype=object)


def nearest(points: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the lowest on ties) and the squared distance to it."""
    wide = points.dtype == object or any(abs(c) >= NARROW for row in centroids for c in row)
    kind = object if wide else np.int64
    points = points.astype(kind)
    squares = np.empty((len(points), len(centroids)), kind)
    for k, centroid in enumerate(centroids):
        difference = points - np.array(centroid, kind)
        squares[:, k] = (difference * difference).sum(axis=1)
    chosen = squares.argmin(axis=1)
    return chosen, squares[np.arange(len(points)), chosen]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The value as (number of limb, signed limb)."""
    sign, value, n = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield n, sign * (value & ((1 << LIMB) - 1))
        value, n = value >> LIMB, n + 1


@dataclass(frozen=True)
class Clustering:
    """Centroids and, for each, its number of vectors and the sum of their squared distances."""

    centroids: Centroids
    sizes: list[int]
    inertias: list[int]

    @property
    def inertia(self) -> int:
        return sum(self.inertias)

    def digests(self) -> list[str]:
        """sha256 of each centroid's components, as decimal integers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def _totals(points: DataFrame, centroids: Centroids, width: int, scale: int) -> dict[tuple[int, int], int]:
    """Exact sums by (cluster, component); component ``width`` is the count, the next one the squared distances."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not len(batch):
                continue
            whole = integers(batch["vector"].tolist(), scale)
            chosen, distance = nearest(whole, centroids)
            for k in np.unique(chosen).tolist():
                mine = chosen == k
                # A batch has fewer than 2^36 rows, so sums of narrow components fit in 64 bits.
                parts = [*whole[mine].sum(axis=0).tolist(), int(mine.sum()), sum(distance[mine].tolist())]
                for c, value in enumerate(parts):
                    sums[k, c] = sums.get((k, c), 0) + value
        rows = [(k, c, n, limb) for (k, c), value in sums.items() for n, limb in _limbs(value)]
        yield pd.DataFrame(rows, columns=["cluster", "component", "limb", "value"])

    found = points.select("vector").mapInPandas(partial, "cluster int, component int, limb int, value long")
    merged = found.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value"))
    totals = {(k, c): 0 for k in range(len(centroids)) for c in range(width + 2)}
    for r in merged.collect():
        totals[r["cluster"], r["component"]] += r["value"] << (LIMB * r["limb"])
    return totals


def lloyd(vectors: DataFrame, *, clusters: int, rounds: int, width: int, seed: str, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Clustering]:
    """Cluster ``vectors``: one row (``id``, ``cluster``, ``distance``) for each usable one, and the clustering.

    The first centroids are the vectors with the smallest sha256 of ``seed`` and the id in decimal.
    """
    scratch = Scratch(vectors.sparkSession, "lloyd")
    kept = vectors.filter(usable(vector, width)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    points = scratch.table(kept, "points")
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = points.select(digest.alias("digest"), "vector").orderBy(F.asc_nulls_last("digest"), "vector").limit(clusters).collect()
    centroids: Centroids = integers([np.array(r["vector"]) for r in first], scale).tolist() if first else []
    if not centroids:
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), Clustering([], [], [])
    for _ in range(rounds):
        totals = _totals(points, centroids, width, scale)
        centroids = [[totals[k, c] // totals[k, width] for c in range(width)] if totals[k, width] else centroids[k] for k in range(len(centroids))]
    totals = _totals(points, centroids, width, scale)
    n = len(centroids)
    result = Clustering(centroids, [totals[k, width] for k in range(n)], [totals[k, width + 1] for k in range(n)])

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                chosen, distance = nearest(integers(batch["vector"].tolist(), scale), centroids)
                short = [min(d, LONGEST) for d in distance.tolist()]
                yield pd.DataFrame({"id": batch["id"], "cluster": chosen.astype(np.int32), "distance": np.array(short, np.int64)})

    id_type = points.schema["id"].dataType.simpleString()
    return points.mapInPandas(assigned, f"id {id_type}, cluster int, distance long"), result


def with_inertia(rows: DataFrame, found: Clustering) -> DataFrame:
    """The rows of ``lloyd`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    if not found.centroids:
        own = F.lit(None).cast("struct<inertia:bigint,digest:string>")
    else:
        each = [F.struct(F.lit(min(i, LONGEST)).cast("long").alias("inertia"), F.lit(d).alias("digest")) for i, d in zip(found.inertias, found.digests(), strict=True)]
        own = F.get(F.array(*each), F.col("cluster"))
    return rows.select("*", own["inertia"].alias("cluster_inertia"), F.lit(min(found.inertia, LONGEST)).cast("long").alias("inertia"), own["digest"].alias("centroid_sha256"))

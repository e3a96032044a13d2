"""Exact top-k by inner product: a ball tree with branch and bound in every shard.

Vectors are dealt to shards of bounded size by a hash of their id, and each shard
becomes one ball tree, stored as one row in the shared folder.  Queries travel in
blocks; every block meets every shard once a round.  A node's upper bound for a
query is <query, centre> + |query| * radius; of all nodes that are open the one with
the largest bound is visited next, and the search of a shard ends when that bound is
below the current k-th score.

The k-th score is shared between shards: in a first round each shard looks only at
its best leaf for each query, and the k-th best of all those scores is a lower bound
for the final one, with which every shard starts the second round.  Within a task
each shard hands the k-th score it has reached to the next one.

Scores are integers, computed exactly: components are integers (floor of scale *
x) and the products are summed in double precision while that is exact (all
partial sums below 2^53), else in 64-bit integers, else in integers of any length.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite
component (also once scaled) take no part, nor do rows without an id; a score beyond
the range of a long is its nearest long; rows that repeat an id are candidates each,
but none of a query with that id, and queries that repeat an id get the k best of
all their scores; queries only meet vectors of their own length; ties go to the
smaller id; fewer candidates than k give fewer rows; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

LEAF = 64


def integer_vectors(table: DataFrame, scale: int, *, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (array of whole doubles) of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") * scale)
    whole = F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform("x", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))  # beyond 2^52 doubles are whole
    rows = table.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull()).filter(F.coalesce(whole, F.lit(False)))
    return rows.select("id", v.alias("v"))


class BallTree:
    """Nodes over consecutive rows: centre, radius, first and last row, children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        centres, radii, spans, children = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            low, high, parent, side = stack.pop()
            node = len(spans)
            own = points[order[low:high]].astype(np.float64)
            centre = own.mean(axis=0)
            far = own - centre
            distance = np.sqrt((far * far).sum(axis=1))
            centres.append(centre)
            radii.append(distance.max())
            spans.append((low, high))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if high - low > LEAF and radii[-1] > 0:
                # Split along the line between two far points, in halves.
                a = own[distance.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                along = np.argsort(own @ (b - a), kind="stable")
                order[low:high] = order[low:high][along]
                middle = (low + high) // 2
                stack += [(middle, high, node, 1), (low, middle, node, 0)]
        self.ids, self.points = ids[order], points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.spans, self.children = np.array(spans, np.int64), np.array(children, np.int64)

    def row(self) -> tuple:
        narrow = np.abs(self.points).max(initial=0) < 2**31
        points = self.points.astype(np.int32 if narrow else np.float64)
        return self.ids.tobytes(), points.tobytes(), self.centres.tobytes(), self.radii.tobytes(), self.spans.tobytes(), self.children.tobytes()

    @classmethod
    def of(cls, row: dict) -> BallTree:
        tree = object.__new__(cls)
        tree.ids = np.frombuffer(row["ids"], np.int64)
        narrow = len(row["points"]) == 4 * len(tree.ids) * row["dim"]
        tree.points = np.frombuffer(row["points"], np.int32 if narrow else np.float64).reshape(len(tree.ids), -1)
        tree.radii = np.frombuffer(row["radii"], np.float64)
        tree.centres = np.frombuffer(row["centres"], np.float64).reshape(len(tree.radii), -1)
        tree.spans = np.frombuffer(row["spans"], np.int64).reshape(-1, 2)
        tree.children = np.frombuffer(row["children"], np.int64).reshape(-1, 2)
        return tree

    def scores(self, queries: np.ndarray, low: int, high: int) -> np.ndarray:
        own = self.points[low:high]
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(own).max(initial=0)) * own.shape[1]
        if most < 2**53:
            return (queries.astype(np.float64) @ own.T.astype(np.float64)).astype(np.int64)
        if most < 2**62:
            return queries.astype(np.int64) @ own.T.astype(np.int64)
        exact = [[sum(int(x) * int(y) for x, y in zip(q, o, strict=True)) for o in own.tolist()] for q in queries.tolist()]
        return np.array([[min(max(s, -(1 << 63)), (1 << 63) - 1) for s in row] for row in exact], np.int64)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray, first_leaf: bool) -> list[tuple[int, int, int]]:
        """(query, vector, score) of the k best of this shard at or above each query's floor; raises the floors to its k-th scores."""
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
            reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
            bounds = queries @ self.centres.T + length[:, None] * (self.radii + 1e-9 * reach) + 1e-3  # upper bounds of all nodes, rounding included
            bounds[np.isnan(bounds)] = np.inf
        out: list[tuple[int, int, int]] = []
        for q in range(len(ids)):
            bound, best, best_ids, floor = bounds[q], np.empty(0, np.int64), np.empty(0, np.int64), floors[q]
            opened = [(-bound[0], 0)]
            while opened:
                least, node = heapq.heappop(opened)
                if -least < floor:
                    break
                a, b = self.children[node]
                if a >= 0:
                    if first_leaf:
                        opened = []
                    for child in (a, b) if not first_leaf else (a if bound[a] >= bound[b] else b,):
                        heapq.heappush(opened, (-bound[child], int(child)))
                    continue
                low, high = self.spans[node]
                score = self.scores(queries[q : q + 1], low, high)[0]
                near = self.ids[low:high]
                own = (score >= floor) & (near != ids[q])
                best, best_ids = np.append(best, score[own]), np.append(best_ids, near[own])
                if len(best) > k:
                    top = np.lexsort((best_ids, ~best))[:k]
                    best, best_ids = best[top], best_ids[top]
                if len(best) == k:
                    floor = floors[q] = max(floor, int(best.min()))
            out += zip([int(ids[q])] * len(best), best_ids.tolist(), best.tolist(), strict=True)
        return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """The k best candidates of each query by inner product: query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    scratch = Scratch(spark, "topk")
    points = scratch.table(integer_vectors(candidates, scale, key=key, vector=vector), "points")
    shards = max(1, -(-points.count() // shard_rows))

    def tree(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        built = BallTree(ids[order], flat.reshape(len(ids), -1)[order])
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        values = [table.column("shard")[0].as_py(), table.column("dim")[0].as_py(), *built.row()]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["shard", "dim", "ids", "points", "centres", "radii", "spans", "children"])

    dealt = points.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.size("v").cast("long").alias("dim"))
    trees = scratch.table(dealt.groupBy("shard", "dim").applyInArrow(tree, "shard long, dim long, ids binary, points binary, centres binary, radii binary, spans binary, children binary"), "trees")

    asked = scratch.table(integer_vectors(queries, scale, key=key, vector=vector), "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    packed = asked.groupBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).alias("block"), F.size("v").cast("long").alias("dim"))
    packed = packed.agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("queries"))

    def searched(first_leaf: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reached: dict[tuple[int, int], np.ndarray] = {}  # by block: its floors, raised by each shard of this task
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.array([q["id"] for q in row["queries"]], np.int64)
                    vectors = np.array([q["v"] for q in row["queries"]], np.float64)
                    floors = dict(zip(row["asked"] or [], row["floors"] or [], strict=True))
                    floor = np.array([floors.get(i, -(1 << 63)) for i in ids.tolist()], np.int64)
                    if not first_leaf:
                        floor = reached.setdefault((row["block"], row["dim"]), floor)
                    found = BallTree.of(row).search(ids, vectors, k, floor, first_leaf)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

        return search

    def meet(blocks_of_queries: DataFrame) -> DataFrame:
        everywhere = blocks_of_queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return trees.join(everywhere, ["shard", "dim"])

    result = "query_id long, vec_id long, score long"
    none = packed.select("*", F.lit(None).cast("array<long>").alias("asked"), F.lit(None).cast("array<long>").alias("floors"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    early = meet(none).mapInArrow(searched(True), result).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    early = scratch.table(early.select(F.col("query_id").alias("id"), F.col("score").alias("floor")), "floors")
    known = early.groupBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "floor")).alias("f"))
    informed = packed.join(known, "block", "left").select("block", "dim", "queries", F.col("f.id").alias("asked"), F.col("f.floor").alias("floors"))
    found = meet(informed).mapInArrow(searched(False), result)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

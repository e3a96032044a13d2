"""Merkle manifest of a dataset: a tree over each group of rows and one over the groups.

A leaf is the sha256 of a row's fields.  Within a group leaves ascend by key; while
several nodes remain, every ``fanout`` consecutive ones (of the last run as many as
there are, even one) become the sha256 of their digests as hex text.  What remains is
the group's subroot; the subroots, in order of the groups, give the root likewise.

Rows are range-partitioned by group and key.  Each partition reports the groups at its
two ends, which gives every row its index within its group.  A task then walks over its
indexed leaves with a mountain range: one pending run for each level, which when full
(or at the end of the group) is hashed and carried to the next level.  It emits the
nodes it completed as records and, as peaks, those whose run lies in other partitions
too.  Peaks are merged level by level with ``groupBy`` on the run they belong to, so no
task sees more than its share.  For proofs a partition's rows meet its node records and
the merged runs at its edges (two for each level) in one cogroup.

Defined cases: a null field is written ``-``; null groups and null keys come first;
rows with equal group and key are ordered by their leaf digest, equal rows stand beside
each other, each a leaf of its own; empty texts are fields of no bytes; a text of any
length is hashed whole; an empty table has no rows and no root; columns that are not
named as fields are ignored.  The driver gets one row for each partition.  A partition
has about ``PART_ROWS`` rows, which a task holds while it makes proofs, together with
one path for each of its groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, cut

#: Rows of a partition: about the first, at least the second where cores would be idle.
PART_ROWS, LEAST_ROWS = 1 << 18, 1 << 13
#: Siblings to the left and right of a node, their digests joined, from the leaf up.
PATH = "array<struct<l:string,r:string>>"
RECORD = "part int, grp string, n long, kind string, level int, idx long, digest string"


def leaf_of(fields: Sequence[Column]) -> Column:
    """sha256 of the fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""

    def one(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def digest_of(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Shape:
    """The tree over ``n`` leaves: number of nodes of each level, the last one 1."""

    sizes: tuple[int, ...]
    fanout: int

    @classmethod
    def of(cls, n: int, fanout: int) -> Shape:
        sizes = [n]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // fanout))
        return cls(tuple(sizes), fanout)

    @property
    def depth(self) -> int:
        return len(self.sizes) - 1

    def ends_run(self, level: int, idx: int) -> bool:
        return (idx + 1) % self.fanout == 0 or idx + 1 == self.sizes[level]

    def run_of(self, level: int, idx: int) -> range:
        """Indexes of the nodes that are hashed together with this one."""
        first = idx - idx % self.fanout
        return range(first, min(first + self.fanout, self.sizes[level]))


class MountainRange:
    """Pending runs by level over consecutive leaves of one tree."""

    def __init__(self, shape: Shape, emit: Callable[[str, int, int, str], None]):
        self.shape, self.emit = shape, emit
        self.pending: list[list[tuple[int, str]]] = [[] for _ in shape.sizes]

    def add(self, idx: int, digest: str) -> None:
        for level in range(self.shape.depth + 1):
            if level:
                self.emit("node", level, idx, digest)
            if level == self.shape.depth:
                self.emit("root", level, idx, digest)
                return
            run = self.pending[level]
            run.append((idx, digest))
            if not self.shape.ends_run(level, idx):
                return
            self.pending[level] = []
            if run[0][0] % self.shape.fanout:  # it began in another partition
                self._peaks(level, run)
                return
            idx, digest = idx // self.shape.fanout, digest_of([d for _, d in run])

    def close(self) -> None:
        for level, run in enumerate(self.pending):
            self._peaks(level, run)

    def _peaks(self, level: int, run: list[tuple[int, str]]) -> None:
        for idx, digest in run:
            self.emit("peak", level, idx, digest)


@dataclass(frozen=True)
class _Part:
    """Where a partition's first group goes on, and how large its first and last groups are in all."""

    start: int
    first: int
    last: int


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the groups at both ends of the partition and their rows in it."""
    runs: list[list] = []
    rows = 0
    for batch in batches:
        for grp, same in itertools.groupby(batch.column("grp").to_pylist()):
            n = sum(1 for _ in same)
            rows += n
            if runs and runs[-1][0] == grp:
                runs[-1][1] += n
            else:
                runs = [*runs[:1], [grp, n]]  # the first and the newest
    if rows:
        (a, n), (b, m) = runs[0], runs[-1]
        yield pa.RecordBatch.from_pydict(
            {"part": [TaskContext.get().partitionId()], "a": pa.array([a], pa.string()), "n": [n], "b": pa.array([b], pa.string()), "m": [m], "one": [len(runs) == 1]}
        )


def _parts(ends: list[tuple]) -> dict[int, _Part]:
    """From (partition, first group, its rows, last group, its rows, whether they are one), in order of partitions."""
    totals: dict[str | None, int] = {}
    starts = []
    for _, a, n, b, m, one in ends:
        starts.append(totals.get(a, 0))
        totals[a] = totals.get(a, 0) + n
        if not one:
            totals[b] = m
    return {p: _Part(start, totals[a], totals[b]) for (p, a, _, b, _, _), start in zip(ends, starts, strict=True)}


def _segments(batches: Iterator[pa.RecordBatch], parts: dict[int, _Part], last_grp: dict[int, str | None]) -> Iterator[tuple[str | None, int, int, pa.RecordBatch]]:
    """Slices of one group: (group, its size, index of the slice's first row, slice).

    The size of a group that lies in one partition is not known before its end, so
    such a group is gathered first; it has no more rows than the partition.
    """
    part = TaskContext.get().partitionId()
    if part not in parts:
        return
    at, grp, held = parts[part].start, None, []
    begun = outer = False

    def gathered() -> Iterator[tuple]:
        size = sum(b.num_rows for b in held)
        seen = 0
        for b in held:
            yield grp, size, seen, b
            seen += b.num_rows

    for batch in batches:
        names, offset = batch.column("grp").to_pylist(), 0
        for name, same in itertools.groupby(names):
            n = sum(1 for _ in same)
            piece = batch.slice(offset, n)
            offset += n
            if not begun or name != grp:
                yield from gathered()
                held = []
                first = not begun
                at = parts[part].start if first else 0
                size = parts[part].first if first else parts[part].last if name == last_grp[part] else 0
                begun, grp, outer = True, name, bool(size)
            if outer:
                yield grp, size, at, piece
                at += n
            else:
                held.append(piece)
    yield from gathered()


@dataclass(frozen=True)
class Forest:
    """The trees of all groups.

    ``rows``: part, grp, n, idx and the columns of the leaves; ``records``: nodes,
    peaks, roots and ranges by partition; ``runs``: the merged runs (grp, level, run,
    children); ``roots``: grp, digest.
    """

    rows: DataFrame
    records: DataFrame
    runs: DataFrame
    roots: DataFrame
    fanout: int


def forest(leaves: DataFrame, scratch: Scratch, name: str, fanout: int) -> Forest:
    """Trees over ``leaves`` (grp, key, leaf, further columns), which is best a written table."""
    spark = leaves.sparkSession
    count = leaves.count()
    parts_wanted = max(1, -(-count // PART_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // LEAST_ROWS)))
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())
    order = ["grp", "key", "leaf", "tie"]
    ordered = cut(tied.repartitionByRange(parts_wanted, *order).sortWithinPartitions(*order).drop("tie"))

    ends = sorted((tuple(r) for r in ordered.select("grp").mapInArrow(_ends, "part long, a string, n long, b string, m long, one boolean").collect()), key=lambda r: r[0])
    parts, last_grp = _parts(ends), {r[0]: r[3] for r in ends}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, now = TaskContext.get().partitionId(), [], {}

        def emit(kind: str, level: int, idx: int, digest: str | None) -> None:
            out.append((part, now["grp"], now["n"], kind, level, idx, digest))

        def close() -> None:
            peaks, shape = now["peaks"], now["peaks"].shape
            peaks.close()
            emit("segment", shape.depth, 0, None)
            if (now["from"], now["to"]) != (0, now["n"]):
                for level in range(shape.depth):
                    scale = fanout**level
                    for run in sorted({now["from"] // scale // fanout, (now["to"] - 1) // scale // fanout}):
                        emit("edge", level, run, None)

        for grp, n, at, rows in _segments(batches, parts, last_grp):
            if not now or now["grp"] != grp:
                if now:
                    close()
                now.update(grp=grp, n=n, peaks=MountainRange(Shape.of(n, fanout), emit))
                now["from"] = at
            for idx, leaf in enumerate(rows.column("leaf").to_pylist(), at):
                now["peaks"].add(idx, leaf)
            now["to"] = at + rows.num_rows
            if len(out) > 50_000:
                yield _batch(out)
                out.clear()
        if now:
            close()
        yield _batch(out)

    records = scratch.table(ordered.select("grp", "leaf").mapInArrow(walk, RECORD), f"{name}-records")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for _, n, at, rows in _segments(batches, parts, last_grp):
            m = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([n] * m, pa.int64()), pa.array(range(at, at + m), pa.int64()), *rows.columns], names=["part", "n", "idx", *rows.schema.names])

    new = [T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("idx", T.LongType())]
    rows = ordered.mapInArrow(index, T.StructType([*new, *ordered.schema.fields]))

    # Level by level the peaks, and what was merged of them, meet in their runs.
    across = max((max(p.first, p.last) for p in parts.values()), default=0)
    runs = records.filter("false").select("grp", "level", F.col("idx").alias("run"), F.array(F.struct("idx", "digest")).alias("children"))
    roots = records.filter("kind = 'root'").select("grp", "digest")
    if len(parts) > 1:
        peaks, merged = records.filter("kind = 'peak'").select("grp", "n", "level", "idx", "digest"), None
        for level in range(Shape.of(across, fanout).depth):
            here = peaks.filter(F.col("level") == level)
            here = here if merged is None else here.unionByName(merged)
            met = here.groupBy("grp", "n", F.expr(f"idx div {fanout}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("children"))
            met = scratch.table(met.select("grp", "n", F.lit(level).alias("level"), "run", "children"), f"{name}-runs-{level}")
            runs = runs.unionByName(met.drop("n"))
            joined = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
            above = met.select("grp", "n", F.lit(level + 1).alias("level"), F.col("run").alias("idx"), joined.alias("digest"))
            done = F.col("n") <= fanout ** (level + 1)
            roots = roots.unionByName(above.filter(done).select("grp", "digest"))
            merged = above.filter(~done)
    return Forest(rows, records, runs, roots, fanout)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    names = ["part", "grp", "n", "kind", "level", "idx", "digest"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class _Climber:
    """Paths from the leaves of one partition, from its nodes and the runs at its edges."""

    def __init__(self, fanout: int, nodes: dict[tuple, str], tops: dict[str | None, tuple[str, str, list]]):
        self.fanout, self.nodes, self.tops = fanout, nodes, tops
        self.shapes: dict[int, Shape] = {}
        self.joined: dict[tuple, str] = {}
        self.folds: dict[tuple, str] = {}

    def shape(self, n: int) -> Shape:
        if n not in self.shapes:
            self.shapes[n] = Shape.of(n, self.fanout)
        return self.shapes[n]

    def sides(self, grp: str | None, n: int, level: int, idx: int) -> tuple[str, str]:
        run = self.shape(n).run_of(level, idx)
        left = "".join([self.nodes[grp, level, i] for i in range(run.start, idx)])
        return left, "".join([self.nodes[grp, level, i] for i in range(idx + 1, run.stop)])

    def path(self, grp: str | None, n: int, idx: int) -> list[tuple[str, str]]:
        own = [self.sides(grp, n, level, idx // self.fanout**level) for level in range(self.shape(n).depth)]
        return own + (self.tops[grp][2] if grp in self.tops else [])

    def siblings(self, grp: str | None, n: int, level: int, idx: int) -> str:
        """All siblings from this node up to the root, joined."""
        if level == self.shape(n).depth:
            return "".join(a + b for a, b in self.tops[grp][2])
        key = grp, level, idx
        if key not in self.joined:
            a, b = self.sides(grp, n, level, idx)
            text = a + b + self.siblings(grp, n, level + 1, idx // self.fanout)
            if level < 2:  # few leaves ask for it, and there are many such nodes
                return text
            self.joined[key] = text
        return self.joined[key]

    def fold(self, grp: str | None, n: int, level: int, idx: int, digest: str) -> str:
        """Root that follows from the digest and the siblings; kept for digests that stand in the tree."""
        if level == self.shape(n).depth:
            for a, b in self.tops[grp][2]:
                digest = digest_of([a, digest, b])
            return digest
        stands = level > 0 and self.nodes.get((grp, level, idx)) == digest
        key = grp, level, idx
        if stands and key in self.folds:
            return self.folds[key]
        a, b = self.sides(grp, n, level, idx)
        root = self.fold(grp, n, level + 1, idx // self.fanout, digest_of([a, digest, b]))
        if stands:
            self.folds[key] = root
        return root


def _climb(trees: Forest, tops: DataFrame | None, body: Callable[[_Climber, dict], dict], schema: T.StructType) -> DataFrame:
    """``body`` over the rows of each partition beside all nodes that their paths touch.

    ``tops`` has for each group its subroot, the root and the path between them.
    """
    records = trees.records
    none = [F.lit(None).cast("string").alias("root"), F.lit(None).cast(PATH).alias("path")]
    local = records.filter("kind = 'node'").select("part", "grp", "level", "idx", "digest", *none)
    edges, runs = records.filter("kind = 'edge'").alias("e"), trees.runs.alias("r")
    same = F.col("e.grp").eqNullSafe(F.col("r.grp")) & (F.col("e.level") == F.col("r.level")) & (F.col("e.idx") == F.col("r.run"))
    met = edges.join(runs, same).select("e.part", "e.grp", "e.level", F.explode("r.children").alias("c")).select("part", "grp", "level", "c.idx", "c.digest", *none)
    beside = local.unionByName(met)
    if tops is not None:
        held = records.filter("kind = 'segment'").alias("s").join(tops.alias("t"), F.col("s.grp").eqNullSafe(F.col("t.grp")))
        beside = beside.unionByName(held.select("s.part", "s.grp", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.col("t.subroot").alias("digest"), "t.root", "t.path"))
    fanout = trees.fanout

    def climbed(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        known, above = {}, {}
        for r in nodes.to_pylist():
            if r["level"] < 0:
                above[r["grp"]] = r["digest"], r["root"], [(p["l"], p["r"]) for p in r["path"]]
            else:
                known[r["grp"], r["level"], r["idx"]] = r["digest"]
        columns = {c: rows.column(c) if c == "key" else rows.column(c).to_pylist() for c in rows.column_names}
        known.update(zip(zip(columns["grp"], itertools.repeat(0), columns["idx"]), columns["leaf"], strict=False))
        return pa.table(body(_Climber(fanout, known, above), columns))

    return trees.rows.groupBy("part").cogroup(beside.groupBy("part")).applyInArrow(climbed, schema)


def _paths(climber: _Climber, rows: dict) -> dict:
    paths = [[{"l": a, "r": b} for a, b in climber.path(g, n, i)] for g, n, i in zip(rows["grp"], rows["n"], rows["idx"], strict=True)]
    kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    return {"name": pa.array(rows["name"], pa.string()), "subroot": pa.array(rows["leaf"], pa.string()), "path": pa.array(paths, kind)}


def _proofs(climber: _Climber, rows: dict) -> dict:
    out: dict[str, list] = {c: [] for c in ("subroot", "root", "proof_sha256", "folded_root", "verified")}
    for grp, n, idx, leaf, changed in zip(rows["grp"], rows["n"], rows["idx"], rows["leaf"], rows["changed"], strict=True):
        subroot, root, _ = climber.tops[grp]
        folded = climber.fold(grp, n, 0, idx, leaf if changed is None else changed)
        for column, value in zip(out.values(), (subroot, root, digest_of([climber.siblings(grp, n, 0, idx)]), folded, folded == root), strict=True):
            column.append(value)
    typed = {c: pa.array(v, pa.bool_() if c == "verified" else pa.string()) for c, v in out.items()}
    return {"key": rows["key"], "leaf": pa.array(rows["leaf"], pa.string()), **typed}


def manifest(docs: DataFrame, *, fields: Sequence[str], group: str, key: str, fanout: int = 8, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and a checked proof for each row of ``docs``.

    ``changed`` gives new values of some fields, which rows for which ``when`` holds are
    read back with; ``folded_root`` is what their leaves and the original siblings give,
    and ``verified`` tells whether that is the root.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes or more")
    scratch = Scratch(docs.sparkSession, "merkle")
    original = leaf_of([F.col(c) for c in fields])
    read = leaf_of([(changed or {}).get(c, F.col(c)) for c in fields])
    tampered = F.when(F.coalesce(when, F.lit(False)), read) if when is not None else F.lit(None).cast("string")
    leaves = scratch.table(docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), original.alias("leaf"), tampered.alias("changed")), "leaves", hashes=("leaf", "changed"))
    trees = forest(leaves, scratch, "rows", fanout)

    roots = scratch.table(trees.roots, "subroots")
    upper = forest(roots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"), F.col("digest").alias("leaf"), F.col("grp").alias("name")), scratch, "groups", fanout)
    paths = _climb(upper, None, _paths, T.StructType().add("name", "string").add("subroot", "string").add("path", T.ArrayType(T.StructType().add("l", "string").add("r", "string"))))
    top = scratch.table(upper.roots.select(F.col("digest").alias("root")), "root").first()
    tops = scratch.table(paths.select(F.col("name").alias("grp"), "subroot", F.lit(top["root"] if top else None).cast("string").alias("root"), "path"), "tops")

    schema = T.StructType([T.StructField("key", leaves.schema["key"].dataType), T.StructField("leaf", T.StringType())])
    for c in ("subroot", "root", "proof_sha256", "folded_root"):
        schema.add(c, "string")
    return _climb(trees, tops, _proofs, schema.add("verified", "boolean"))

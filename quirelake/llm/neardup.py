"""Near-duplicate documents by HyperMinHash.

A document's set are its 5-word shingles.  One 64-bit hash of each shingle feeds a
HyperMinHash sketch: the top bits choose a register, and a register keeps of the
smallest remainder the number of leading zeros and the next mantissa bits.  Empty
registers of small sets are filled from other registers by a fixed probe order.
Bands of compressed registers give keys; documents that share a key form the edges
of a candidate graph, whose connected clusters are dealt to tasks.  A large cluster
is split into groups of bounded size and every pair of groups is one task, so no
task holds more than two groups, and no pair is lost.  In a task pairs are first
estimated from the registers (corrected for chance collisions) and then confirmed
on the full sets; pairs that confirmed links already join are skipped, so a task
gives back a forest, never all pairs.

Exact copies of a text count once in all of this and are joined to the result by
the md5 of the text.

Probability of missing a pair: 32 bands of 4 registers miss a pair of similarity
0.75 with probability 5e-6; the estimate (standard error 0.04 at 128 registers)
discards below the threshold less 0.2, about five standard errors.

Defined cases: null texts and texts without words have an empty set, stay alone
and are kept; a text with fewer words than a shingle is one shingle; rows with the
same key and text are one document; two texts under one key are two nodes that
share the key; null keys are larger than any other and never represent a group
with another key; other columns are ignored; an empty table gives an empty result;
a text of any length is sketched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import Scratch, WordHashes, mix, runs, texts_of

REGISTER_BITS, MANTISSA_BITS, BANDS = 7, 10, 32
REGISTERS = 1 << REGISTER_BITS
ROWS = REGISTERS // BANDS
PROBES = 96
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[bytes], known: WordHashes, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and how many each has."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    word = known.of([w for s in split for w in s])
    value = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        value = value * FACTOR + word[k : len(word) - words + 1 + k]
    starts = np.cumsum(sizes) - sizes
    out, counts = [], np.zeros(len(texts), np.int64)
    for i, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        if n >= words:
            own = np.unique(mix(value[at : at + n - words + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for k in range(at, at + n):
                short = short * FACTOR + word[k : k + 1]
            own = mix(short)
        else:
            continue
        counts[i] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.empty(0, np.uint64), counts


def _probe_order() -> np.ndarray:
    """For each register the registers from which it is filled if empty, in turn."""
    i = np.arange(REGISTERS * PROBES, dtype=np.uint64) + np.uint64(0x5EED)
    return (mix(i * FACTOR) % np.uint64(REGISTERS)).astype(np.int64).reshape(REGISTERS, PROBES)


ORDER = _probe_order()
#: Sets of fewer shingles are compared whenever they share a band.
SMALL_SET = 64


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, uint16) of sorted sets; rows without elements are 0."""
    rows = np.repeat(np.arange(len(counts)), counts)
    register = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    slot = rows * REGISTERS + register
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.empty(0, np.int64)
    rest = hashes[first] << np.uint64(REGISTER_BITS)
    # Leading zeros of the 64-bit remainder, then the bits below the leading one.
    exponent = np.frexp(rest.astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, 57).astype(np.uint64)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA_BITS)
    table = np.zeros(len(counts) * REGISTERS, np.uint16)
    table[slot[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    table = table.reshape(len(counts), REGISTERS)
    filled = table.copy()
    for k in range(PROBES + REGISTERS):
        row, col = np.nonzero(filled == 0)
        some = counts[row] > 0
        row, col = row[some], col[some]
        if not len(row):
            break
        filled[row, col] = table[row, ORDER[col, k] if k < PROBES else (col + k - PROBES) % REGISTERS]
    return filled


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    words = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), BANDS)
    return mix(words + np.arange(BANDS, dtype=np.uint64) * FACTOR).view(np.int64)


def estimate(registers: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one sketch against many, less the share of chance collisions."""
    equal = (others == registers).mean(axis=1)
    # Two independent registers agree if zeros (sum of 4^-z = 1/3) and mantissa agree.
    chance = 1.0 / (3.0 * (1 << MANTISSA_BITS))
    return (equal - chance) / (1.0 - chance)


def linked_forest(sets: list[np.ndarray], registers: np.ndarray, left: int, share: float) -> list[tuple[int, int]]:
    """Edges that join what is linked.  With ``left`` > 0 only pairs across ``left`` are new."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    root = np.arange(n)
    edges = []
    for i in range(left or n):
        begin = max(i + 1, left)
        low, high = np.minimum(sizes[i], sizes[begin:]), np.maximum(sizes[i], sizes[begin:])
        near = begin + np.flatnonzero((root[begin:] != root[i]) & (low >= share * high))
        if not len(near):
            continue
        likely = estimate(registers[i], registers[near])
        # Sketches of small sets fill many registers from few elements: these are always confirmed.
        worth = (likely >= share - 0.2) | (low[near - begin] < SMALL_SET)
        near = near[worth][np.argsort(-likely[worth], kind="stable")]
        for j in near.tolist():
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= round(100 * share) * (len(sets[i]) + len(sets[j]) - both):
                edges.append((i, j))
                root[root == root[j]] = root[i]
    return edges


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", share: float = 0.75, group_bytes: int = 24_000_000, group_rows: int = 8192) -> DataFrame:
    """One row for each row of ``docs``: doc_id, node (md5 of the text), n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession, "neardup")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.md5(body)).alias("node"), body.alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in runs(batches, "text", 4_000_000):
            hashes, counts = shingle_hashes(texts_of(batch.column("text")), known)
            keys = band_keys(sketches(hashes, counts))
            bands = pa.array([k.tolist() if n else [] for k, n in zip(keys, counts, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(counts), pa.array([8 * int(c) for c in counts], pa.int64()), bands], names=["doc_id", "node", "n_shingles", "bytes", "bands"])

    marks = scratch.table(rows.mapInArrow(sketched, "doc_id long, node binary, n_shingles long, bytes long, bands array<long>"), "marks")
    texts = marks.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    texts = scratch.table(texts, "texts")

    # Candidate clusters: nodes that share a band key, hooked to the smallest node with it.
    spread = texts.select("node", F.posexplode("bands").alias("band", "value"))
    hubs = spread.groupBy("band", "value").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("band", "value", "hub")
    pairs = spread.join(hubs, ["band", "value"]).filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = connected(pairs, scratch, "clusters")
    members = clusters.join(texts.select("node", "low", "bytes"), "node")
    groups = clusters.join(texts.select("node", "bytes"), "node").groupBy("root").agg(
        F.greatest(F.ceil((F.sum("bytes") + F.count("node") * 2 * REGISTERS) / group_bytes), F.ceil(F.count("node") / group_rows)).cast("int").alias("groups")
    )
    members = scratch.table(members.join(groups, "root").withColumn("part", F.pmod(F.xxhash64("node"), "groups").cast("int")).drop("bytes"), "members")

    # Every member goes to the tasks of its group with each group of the cluster.
    at = (F.col("r.doc_id").eqNullSafe(F.col("m.low"))) & (F.col("r.node") == F.col("m.node"))
    other = F.explode(F.sequence(F.lit(0), F.col("m.groups") - 1))
    sent = rows.alias("r").join(members.alias("m").hint("shuffle_hash"), at).select("r.node", "m.root", "m.part", "m.groups", "r.text")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in runs(batches, "text", 4_000_000):
            hashes, counts = shingle_hashes(texts_of(batch.column("text")), known)
            registers = sketches(hashes, counts)
            ends = np.cumsum(counts)
            sets = [hashes[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "part", "groups")), pa.array(sets, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())], names=["node", "root", "part", "groups", "hashes", "registers"])

    sets = sent.mapInArrow(with_sets, "node binary, root binary, part int, groups int, hashes binary, registers binary")
    tiles = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))

    def tile(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        table = table.sort_by([("part", "ascending"), ("node", "ascending")])
        nodes, parts = table.column("node").to_pylist(), table.column("part").to_pylist()
        once = [i for i in range(len(nodes)) if not i or nodes[i] != nodes[i - 1]]
        hashes, registers = table.column("hashes").to_pylist(), table.column("registers").to_pylist()
        own = [np.frombuffer(hashes[i], np.uint64) for i in once]
        regs = np.frombuffer(b"".join(registers[i] for i in once), np.uint16).reshape(len(once), REGISTERS)
        left = sum(parts[i] == p for i in once) if p != q else 0
        edges = [] if p != q and left in (0, len(once)) else linked_forest(own, regs, left, share)
        return pa.table([pa.array([nodes[once[a]] for a, _ in edges], pa.binary()), pa.array([nodes[once[b]] for _, b in edges], pa.binary())], names=["a", "b"])

    links = scratch.table(tiles.select("root", "p", "q", "part", "node", "hashes", "registers").groupBy("root", "p", "q").applyInArrow(tile, "a binary, b binary"), "links")
    roots = connected(links, scratch, "links")
    lows = roots.join(texts.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_id"))
    joined = texts.select("node", "low").join(roots.join(lows, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    return marks.select("doc_id", "node", "n_shingles").join(joined, "node", "left").select("doc_id", "node", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", share: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that represent their group (smallest key), unchanged.

    Rows without a key go if their group has a row with one, else they stay; rows that
    repeat the smallest key stay.
    """
    others = (F.col("doc_id") != F.col("component_id")) | (F.col("doc_id").isNull() & F.col("component_id").isNotNull())
    found = near_duplicates(docs, key=key, text=text, share=share).filter(others).select("doc_id", "node").distinct()
    node = F.unhex(F.md5(F.coalesce(F.col(f"d.{text}").cast("string"), F.lit(""))))
    same = F.col(f"d.{key}").cast("long").eqNullSafe(F.col("f.doc_id")) & (node == F.col("f.node"))
    return docs.alias("d").join(found.alias("f").hint("shuffle_hash"), same, "left_anti")

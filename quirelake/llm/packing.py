"""Packing of token sequences by first-fit decreasing.

Documents become token ids (a tokenizer file named by path, then an end id) and
are cut into full pieces and one remainder.  Documents are dealt at random (by a
hash) into groups of about ``group_docs``; each group is packed by itself with
first-fit decreasing.  The bins of a group stand in a tournament tree whose inner
nodes hold the largest free space below them, so the leftmost bin with room is
found in log n steps.  Only lengths and checksums are shuffled, never ids.

Defined cases: a null or empty text is the end id alone; a text of any length is
cut into pieces of at most ``capacity`` ids; equal lengths are taken in order of
doc_id and start; repeated rows are packed each; null ids are one more value; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import word_ids
from .shared import Scratch, runs

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_crc long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Bins in the order they were opened; finds the leftmost with enough room."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1
        while self.size < max(1, bins):
            self.size *= 2
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Put an item into the leftmost bin with room; the bin and the room it had."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        had = room[node]
        room[node] = had - length
        place = node - self.size
        while node > 1:
            node //= 2
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
        return place, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each item; items are given in decreasing order."""
    tree = TournamentTree(len(lengths), capacity)
    out = []
    for length in lengths:
        place, had = tree.place(length)
        out.append((place, capacity - had))
    return out


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document: place, length, checksums of its ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in runs(batches, "text", 4_000_000):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            rows: list[tuple] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                raw += end
                crc = zlib.crc32(raw)
                for at in range(0, len(raw), 4 * capacity):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, crc))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int = 4096, group_docs: int = 8192, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` ids.

    Returns a row for each piece; ``sequence_id`` is the group times 2^32 plus the
    bin in the group.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(token_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, key=key, text=text), "pieces")
    groups = max(1, -(-pieces.filter("start = 0").count() // group_docs))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group = table.column("pack_group")[0].as_py()
        places = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        bins = np.array([b for b, _ in places], np.int64) + (group << 32)
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.table([*(table.column(c) for c in columns), pa.array(bins), pa.array([o for _, o in places], pa.int64())], names=[*columns, "sequence_id", "offset"])

    return pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "doc_tokens", "doc_crc"), F.lit(groups))).groupBy("pack_group").applyInArrow(packed, PACKED)

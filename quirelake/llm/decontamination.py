"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of the training texts: the documents are cut
into segments of bounded size, and every segment is one row that holds its terms,
the number of postings of each term and all positions, sorted by term and place.
Segments are independent, so neither building nor searching shuffles postings.

``search`` takes the windows of the test items in blocks of bounded size.  In
each segment a window starts from the positions of its rarest term; the list of
the next rarest term, moved by its offset in the window, is intersected with what
is left, and so on.  What survives all terms is an exact phrase match: terms are
compared as bytes, so no later check is needed.  With ``span`` the same lists also
give proximity matches: all distinct terms of a window within ``span`` words.

Defined cases: null or empty texts have no words and no hits; an item without
words matches nothing; an item shorter than the window is one window; repeated
items and repeated documents are each treated on their own; items with a null id
mark words but add no id; a text of any length forms its own segment; empty
tables give empty (documents) or hitless (benchmark) results; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, runs, texts_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX = "segment long, doc_ids array<long>, keys array<long>, lengths array<int>, terms binary, counts binary, positions binary"
HITS = "segment long, doc long, doc_id long, text_key long, n_words long, hits array<int>, items array<string>, near_items array<string>"
#: Empty places between documents of a segment, so that no window or span crosses.
GAP = 64


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


@dataclass
class Windows:
    """The windows of some items: term numbers by window, of one width each."""

    terms: list[bytes] = field(default_factory=list)
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    items: list[str | None] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], width: int) -> Windows:
        ids, found, items = _Ids(), {}, []
        for item, text in rows:
            terms = [ids[w] for w in words_of((text or "").encode("utf-8", "surrogatepass"))]
            if terms:
                size = min(width, len(terms))
                for at in range(len(terms) - size + 1):
                    found.setdefault(size, []).append((terms[at : at + size], len(items)))
                items.append(item)
        return cls(list(ids), {n: (np.array([t for t, _ in w], np.int64), np.array([i for _, i in w], np.int64)) for n, w in found.items()}, items)


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", segment_bytes: int = 4_000_000) -> DataFrame:
    """Positional postings of ``docs``, one row for each segment."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1).compress
        for batch in runs(batches, "text", segment_bytes):
            ids, lengths, places = _Ids(), [], []
            for raw in texts_of(batch.column("text")):
                words = words_of(raw)
                lengths.append(len(words))
                places.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            term = np.concatenate(places)
            counts = np.bincount(term, minlength=len(ids)).astype(np.int32)
            where = np.arange(len(term), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32) * GAP, lengths)
            positions = where[np.argsort(term, kind="stable")]
            blobs = [pack(b"\0".join(ids)), pack(counts.tobytes()), pack(np.diff(positions, prepend=np.int32(0)).tobytes())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([batch.column("text_key").to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), *(pa.array([b], pa.binary()) for b in blobs)],
                names=["segment", "doc_ids", "keys", "lengths", "terms", "counts", "positions"],
            )
            made += 1

    body = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key")).mapInArrow(segments, INDEX)


class Segment:
    """One row of the index, opened for search."""

    def __init__(self, row: dict):
        unpack = zstandard.ZstdDecompressor().decompress
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths + GAP) - self.lengths - GAP
        self.counts = np.frombuffer(unpack(row["counts"]), np.int32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.positions = np.cumsum(np.frombuffer(unpack(row["positions"]), np.int32), dtype=np.int32).astype(np.int64)
        terms = unpack(row["terms"])
        self.terms = {t: i for i, t in enumerate(terms.split(b"\0"))} if terms else {}
        #: Sorted, as positions are sorted by term and then place.
        self.postings = np.repeat(np.arange(len(self.counts), dtype=np.int64) << 32, self.counts) | self.positions

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        wanted = term << 32 | place
        at = np.minimum(np.searchsorted(self.postings, wanted), len(self.postings) - 1)
        return (self.postings[at] == wanted) & (place >= 0)

    def local(self, windows: Windows) -> np.ndarray:
        return np.array([self.terms.get(t, -1) for t in windows.terms], np.int64)

    def starts_of(self, terms: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows whose terms all occur, in blocks: (window rows, order of terms by rarity, window of each candidate, place of its rarest term)."""
        alive = np.flatnonzero((terms >= 0).all(axis=1))
        order = np.argsort(self.counts[terms[alive]], axis=1, kind="stable")
        rarest = terms[alive][np.arange(len(alive)), order[:, 0]] if len(alive) else alive
        total = np.cumsum(self.counts[rarest])
        at = 0
        while at < len(alive):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            n = self.counts[rarest[at:end]]
            window = np.repeat(np.arange(at, end), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield alive, order, window, self.positions[self.first[rarest[window]] + inside]
            at = end

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its first word) of all exact occurrences."""
        rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for alive, order, window, place in self.starts_of(terms):
            start = place - order[window, 0]
            for rank in range(1, terms.shape[1]):
                offset = order[window, rank]
                stays = self.has(terms[alive[window], offset], start + offset)
                window, start = window[stays], start[stays]
            rows.append(alive[window])
            places.append(start[start >= 0])
        return np.concatenate(rows), np.concatenate(places)

    def near(self, terms: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its rarest term) where all its terms lie within ``span`` words."""
        rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for alive, order, window, place in self.starts_of(terms):
            before, after = [np.zeros(len(window), np.int64)], [np.zeros(len(window), np.int64)]
            for rank in range(1, terms.shape[1]):
                term = terms[alive[window], order[window, rank]]
                at = np.searchsorted(self.postings, term << 32 | place)
                right = self.postings[np.minimum(at, len(self.postings) - 1)]
                left = self.postings[np.maximum(at - 1, 0)]
                far = np.int64(1 << 31)
                after.append(np.where((right >> 32 == term) & (at < len(self.postings)), (right & 0xFFFFFFFF) - place, far))
                before.append(np.where((left >> 32 == term) & (at > 0), place - (left & 0xFFFFFFFF), far))
                same = after[-1] == 0
                before[-1][same] = 0
            before, after = np.array(before), np.array(after)
            best = np.full(len(window), np.int64(1 << 40))
            for limit in before:  # what lies up to ``limit`` to the left counts there, the rest to the right
                best = np.minimum(best, limit + np.where(before > limit, after, 0).max(axis=0))
            ok = best < min(span, GAP)
            rows.append(alive[window[ok]])
            places.append(place[ok])
        return np.concatenate(rows), np.concatenate(places)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as sorted disjoint intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    if not len(starts):
        return starts, ends
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _searched(windows: Windows, span: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                docs = len(row["doc_ids"])
                lows, highs, pairs, close = [], [], set(), set()
                local = segment.local(windows) if len(segment.postings) else None
                for width, (terms, item) in windows.by_width.items() if local is not None else ():
                    which, start = segment.phrases(local[terms])
                    lows.append(start)
                    highs.append(start + width)
                    doc = np.searchsorted(segment.starts, start, side="right") - 1
                    pairs.update(zip(doc.tolist(), item[which].tolist(), strict=True))
                    if span:
                        which, place = segment.near(local[terms], span)
                        doc = np.searchsorted(segment.starts, place, side="right") - 1
                        close.update(zip(doc.tolist(), item[which].tolist(), strict=True))
                low, high = _merged(np.concatenate([*lows, np.empty(0, np.int64)]), np.concatenate([*highs, np.empty(0, np.int64)]))
                doc = np.searchsorted(segment.starts, low, side="right") - 1
                hits: list[list[int]] = [[] for _ in range(docs)]
                for d, a, b in zip(doc.tolist(), (low - segment.starts[doc]).tolist(), (high - segment.starts[doc]).tolist(), strict=True):
                    hits[d] += (a, b)
                items: list[set[str]] = [set() for _ in range(docs)]
                near: list[set[str]] = [set() for _ in range(docs)]
                for into, found in ((items, pairs), (near, close)):
                    for d, i in found:
                        if windows.items[i] is not None:
                            into[d].add(windows.items[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * docs, pa.int64()), pa.array(range(docs), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([sorted(x) for x in near], pa.list_(pa.string()))],
                    names=["segment", "doc", "doc_id", "text_key", "n_words", "hits", "items", "near_items"],
                )

    return search


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("hits")
        out = []
        for flat in batch.column(at).to_pylist():
            ends = np.array(flat, np.int64)
            out.append(np.stack(_merged(ends[::2], ends[1::2]), axis=1).ravel().tolist())
        yield batch.set_column(at, "hits", pa.array(out, pa.list_(pa.int32())))


def search(index: DataFrame, items: DataFrame, *, width: int = 10, span: int = 0, key: str = "item_id", text: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """Matches of all windows of ``items`` in ``index``, one row for each document.

    ``hits`` lists the disjoint word intervals (start, end, start, end, ...) inside
    an occurrence of some window; ``items`` the ids with an exact match,
    ``near_items`` (with ``span``) those with a proximity match.  Items are sent to
    the executors in blocks of about ``block_bytes`` of text.
    """
    if max(width, span) > GAP:
        raise ValueError(f"width and span are at most {GAP}")
    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = None
    for block in range(max(1, blocks)):
        own = rows if blocks <= 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        windows = Windows.of([tuple(r) for r in own.toLocalIterator()], width)
        part = index.mapInArrow(_searched(windows, span), HITS)
        found = part if found is None else found.unionByName(part)
    if blocks <= 1:
        return found
    joined = found.groupBy("segment", "doc").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "text_key", "n_words")),
        F.flatten(F.collect_list("hits")).alias("hits"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")),
    )
    return joined.select(*found.columns).mapInArrow(_united, HITS)


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = 10, span: int = 0, block_bytes: int = 4_000_000) -> DataFrame:
    """Index ``docs``, search ``items``: doc_id, text_key, n_words, n_hit, items, near_items."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    index = scratch.table(build_index(docs), "index")
    found = search(index, items, width=width, span=span, block_bytes=block_bytes)
    hit = F.aggregate(F.sequence(F.lit(0), (F.size("hits") / 2).cast("int") - 1), F.lit(0).cast("long"), lambda a, i: a + F.get("hits", 2 * i + 1) - F.get("hits", 2 * i))
    return found.select("doc_id", "text_key", "n_words", F.when(F.size("hits") > 0, hit).otherwise(F.lit(0)).cast("long").alias("n_hit"), "hits", "items", "near_items")


def keep_clean(docs: DataFrame, items: DataFrame, *, width: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit, unchanged."""
    found = decontaminate(docs, items, width=width).filter("n_hit > 0").select("doc_id", "text_key").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("f.text_key"))
    return docs.alias("d").join(found.alias("f").hint("shuffle_hash"), same, "left_anti")

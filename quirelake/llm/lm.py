"""Language-model scoring by deleted interpolation.

An n-gram model whose maximum-likelihood estimates (and the uniform law over the
vocabulary and one unknown word) are mixed with weights that depend on how often
the context was seen.  The weights are learned by expectation-maximisation: one
slice of the training documents is deleted from the counts and serves as held-out
data; for scoring its counts are put back.

Shape of the computation.  Documents are cut into blocks, one row each, with the
distinct words of the block and its tokens as numbers.  Every block sends its
distinct n-gram keys (64-bit hashes, sorted, packed) to the buckets of the key
space, where the counts of all blocks meet and are sent back packed to the blocks
that asked.  An n-gram thus crosses the network once per block, however frequent,
so no key is hot; buckets are even because keys are hashes.  The number of buckets
and of the tasks of both shuffles grows with the input, so no task does.  Held-out events are counted on a logarithmic grid of the
estimates, which is all that the driver gets.

Defined cases: null and empty texts are the end token alone; null ids count as the
empty string in the hold-out rule; without training documents every estimate is
the uniform law; repeated rows count each; a text of any length lies in one block;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, WordHashes, mix, runs, texts_of

HELD_OUT, SLICE, BASE = 0, 1, 2
END, START = np.uint64(0x9D5C_0F1E_3A77_1021), np.uint64(0x41B6_77D2_90E3_5C85)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BLOCK = "block long, kind int, doc_ids array<long>, sizes array<int>, hashes binary, tokens binary, n_keys long"
SENT = "bucket long, block long, kind int, n int, keys binary, counts binary"
ANSWER = "block long, n int, bucket long, counts binary, types long, tokens long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
STEPS = 8  # of the grid in an octave
TASK_BUCKETS, TASK_BLOCKS = 2, 4  # on average in a task of the two shuffles


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, compressed: small numbers in wide words get short."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def _unpack(raw: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def blocks_of(docs: DataFrame, kind: Column, *, key: str, text: str, block_bytes: int = 6_000_000) -> DataFrame:
    """Documents as blocks of one kind each."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, known = TaskContext.get().partitionId(), 0, WordHashes()
        for batch in runs(batches, "text", block_bytes):
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            for own in np.unique(kinds):
                some = batch.take(pa.array(np.flatnonzero(kinds == own)))
                hashes, sizes = [], []
                for raw in texts_of(some.column("text")):
                    hashes.append(np.append(known.of(raw.lower().split()), END))
                    sizes.append(len(hashes[-1]))
                distinct, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 24 | made]), pa.array([int(own)], pa.int32()), pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_pack(np.diff(distinct, prepend=np.uint64(0)))], pa.binary()), pa.array([_pack(tokens.astype(np.int32))], pa.binary()), pa.array([len(tokens)])],
                    names=["block", "kind", "doc_ids", "sizes", "hashes", "tokens", "n_keys"],
                )
                made += 1

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), kind.alias("kind")).mapInArrow(blocks, BLOCK)


class Block:
    """Tokens of a block and the keys of the n-grams that end at each."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.cumsum(_unpack(row["hashes"], np.uint64), dtype=np.uint64)[_unpack(row["tokens"], np.int32)]

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, key of the n-gram that ends at each token) for n up to ``order``."""
        keys = mix(self.tokens)
        yield 1, keys
        for n in range(2, order + 1):
            context = np.empty_like(keys)
            context[1:] = keys[:-1]
            context[self.starts] = START + np.uint64(n)
            keys = mix(context * FACTOR + self.tokens + np.uint64(n))
            yield n, keys


def _sent(order: int, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for n, keys in Block(row).grams(order):
                    distinct, counts = np.unique(keys, return_counts=True)
                    bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
                    ids, at = np.unique(bucket, return_index=True)
                    stops = [*at[1:].tolist(), len(distinct)]
                    out = [[], []]
                    for a, b in zip(at.tolist(), stops, strict=True):
                        out[0].append(_pack(np.diff(distinct[a:b], prepend=np.uint64(0))))
                        out[1].append(_pack(counts[a:b].astype(np.uint32)))
                    m = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([row["block"]] * m, pa.int64()), pa.array([row["kind"]] * m, pa.int32()), pa.array([n] * m, pa.int32()), *(pa.array(x, pa.binary()) for x in out)], names=["bucket", "block", "kind", "n", "keys", "counts"])

    return send


def _answered(table: pa.Table) -> pa.Table:
    """Counts of all blocks for one bucket, given back to each block in the order of its keys."""
    out: list[tuple] = []
    rows = table.to_pylist()
    for n in sorted({r["n"] for r in rows}):
        own = [r for r in rows if r["n"] == n]
        keys = [np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64) for r in own]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        given = np.concatenate([_unpack(r["counts"], np.uint32) for r in own]).astype(np.float64)
        kind = np.repeat([r["kind"] for r in own], [len(k) for k in keys])
        every = np.bincount(which, given * (kind != HELD_OUT), len(distinct)).astype(np.uint64)
        deleted = np.bincount(which, given * (kind == SLICE), len(distinct)).astype(np.uint64)
        at = 0
        for r, k in zip(own, keys, strict=True):
            w = which[at : at + len(k)]
            at += len(k)
            both = np.concatenate([every[w], deleted[w]])
            out.append((r["block"], n, r["bucket"], _pack(both), None, None))
        out.append((-1, n, own[0]["bucket"], None, int((every > 0).sum()), int(every.sum())))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "n", "bucket", "counts", "types", "tokens"])


@dataclass
class Corpus:
    """Totals of the training documents: tokens, distinct tokens, documents; with and without the slice."""

    tokens: int
    types: int
    documents: int
    slice_tokens: int
    slice_documents: int


def _estimates(row: dict, order: int, corpus: Corpus, deleted: bool) -> tuple[Block, list[np.ndarray], np.ndarray, np.ndarray]:
    """ML estimates of each token for n = 1.., counts of its longest context and of itself."""
    block = Block(row)
    given: dict[int, list] = {}
    for a in sorted(row["answers"], key=lambda a: (a["n"], a["bucket"])):
        given.setdefault(a["n"], []).append(np.split(_unpack(a["counts"], np.uint64).astype(np.float64), 2))
    documents = corpus.documents - corpus.slice_documents * deleted
    total = corpus.tokens - corpus.slice_tokens * deleted
    estimates, context, own = [], np.full(len(block.tokens), float(total)), None
    for n, keys in block.grams(order):
        _, which = np.unique(keys, return_inverse=True)
        every, gone = (np.concatenate(x) for x in zip(*given[n], strict=True))
        count = (every - gone * deleted)[which]
        if n == 1:
            own = every[which]
        else:
            context = np.empty_like(count)
            context[1:] = shorter[:-1]
            context[block.starts] = documents
        estimates.append(np.divide(count, context, out=np.zeros_like(count), where=context > 0))
        shorter = count
    return block, estimates, context, own


def _bucket_of(context: np.ndarray, buckets: int) -> np.ndarray:
    """0 for an unseen context, then by octaves of its count; all higher ones share the last."""
    return np.minimum(np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0), buckets - 1).astype(np.int64)


def learn_weights(events: list[tuple[int, tuple[int, ...], int]], order: int, buckets: int, uniform: float, rounds: int = 40) -> np.ndarray:
    """EM over held-out events: (bucket, grid steps of the estimates or -1 for zero, count)."""
    weights = np.full((buckets, order + 1), 1.0 / (order + 1))
    if not events:
        return _without_unseen(weights)
    bucket = np.array([e[0] for e in events])
    steps = np.array([e[1] for e in events], np.float64).reshape(len(events), order)
    counts = np.array([e[2] for e in events], np.float64)
    p = np.column_stack([np.full(len(events), uniform), np.where(steps < 0, 0.0, np.exp2(-steps / STEPS))])
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (counts / share.sum(axis=1))[:, None]
        mass = np.column_stack([np.bincount(bucket, share[:, j], buckets) for j in range(order + 1)]) + 0.5
        weights = mass / mass.sum(axis=1, keepdims=True)
    return _without_unseen(weights)


def _without_unseen(weights: np.ndarray) -> np.ndarray:
    """An unseen context has no estimate, so its weight goes to the others."""
    weights[0, -1] = 0.0
    weights[0] /= weights[0].sum()
    return weights


def score(docs: DataFrame, training: Column, deleted: Column, *, key: str = "doc_id", text: str = "text", order: int = 2, buckets: int = 20, bucket_keys: int = 2_000_000) -> DataFrame:
    """Score every row of ``docs`` by the model of the rows where ``training`` holds.

    ``deleted`` marks the slice of the training rows that the weights are learned on.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    kind = F.when(training & deleted, F.lit(SLICE)).when(training, F.lit(BASE)).otherwise(F.lit(HELD_OUT))
    blocks = scratch.table(blocks_of(docs, kind, key=key, text=text), "blocks")
    sums = {r["kind"]: r for r in blocks.groupBy("kind").agg(F.sum("n_keys").alias("tokens"), F.sum(F.size("doc_ids")).alias("documents"), F.count("*").alias("blocks")).collect()}
    of = lambda what, *kinds: sum(sums[k][what] for k in kinds if k in sums)
    bits = max(0, int(np.ceil(np.log2(max(1, order * of("tokens", HELD_OUT, SLICE, BASE)) / bucket_keys))))

    by_bucket, by_block = max(1, 2**bits // TASK_BUCKETS), max(1, of("blocks", HELD_OUT, SLICE, BASE) // TASK_BLOCKS)

    sent = blocks.select("block", "kind", "doc_ids", "sizes", "hashes", "tokens").mapInArrow(_sent(order, bits), SENT)
    answers = scratch.table(sent.repartition(by_bucket, "bucket").groupBy("bucket").applyInArrow(_answered, ANSWER), "answers")
    types = answers.filter("block = -1 and n = 1").agg(F.sum("types")).first()[0] or 0
    corpus = Corpus(of("tokens", SLICE, BASE), types, of("documents", SLICE, BASE), of("tokens", SLICE), of("documents", SLICE))
    uniform = 1.0 / (types + 1)

    def with_answers(some: DataFrame) -> DataFrame:
        own = answers.filter("block >= 0").repartition(by_block, "block").groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "counts")).alias("answers"))
        return some.repartition(by_block, "block").join(own.hint("merge"), "block")

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, estimates, context, _ = _estimates(row, order, corpus, True)
                code = _bucket_of(context, buckets)
                for p in estimates:
                    step = np.where(p > 0, np.round(-np.log2(np.where(p > 0, p, 1.0)) * STEPS), -1).astype(np.int64)
                    code = code * 1024 + step + 1
                codes, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    grid = with_answers(blocks.filter(F.col("kind") == SLICE)).mapInArrow(events, "code long, n long").groupBy("code").agg(F.sum("n")).collect()
    split = [(code >> 10 * order, tuple((code >> 10 * (order - 1 - i) & 1023) - 1 for i in range(order)), n) for code, n in grid]
    weights = learn_weights(split, order, buckets, uniform)
    if not corpus.tokens:
        weights[:] = [1.0] + [0.0] * order

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, estimates, context, own = _estimates(row, order, corpus, False)
                share = weights[_bucket_of(context, buckets)]
                p = share[:, 0] * uniform
                for n, e in enumerate(estimates, 1):
                    p += share[:, n] * e
                base = np.log10((own + 1) / (corpus.tokens + corpus.types + 1))
                columns = [row["doc_ids"], [row["kind"] == HELD_OUT] * len(block.sizes), block.sizes, np.add.reduceat((own > 0).astype(np.int64), block.starts), [corpus.tokens] * len(block.sizes), np.add.reduceat(base, block.starts), np.add.reduceat(np.log10(p), block.starts)]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(blocks).mapInArrow(scores, SCORES)

"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters as its word vector (words that training tells something of) beside
the mean of its character n-gram vectors (hashed), so unseen forms of a word still
say something.  A GRU reads the words of a window forwards and another backwards;
attention pools their states; a logistic unit scores the window.  Overlapping
windows cover the whole text and its score is the largest.  Everything is numpy.

Training takes labelled documents as bags: a document is toxic if its most toxic
window is.  Each round the currently highest window of every toxic document is a
positive example, and the highest and some random windows of clean documents are
negative ones.  The sample is bounded: the ``most_toxic`` and ``most_clean`` labelled
keys of smallest hash, of these the documents of at most ``most_bytes`` bytes;
scoring takes every row and every word.

The input side of the GRUs depends on the word alone, so it is computed once for
each distinct word and gathered; the recurrence runs over thousands of windows at
once.  Nothing but the trained weights (a few MB, bounded by the vocabulary
parameter) is sent to the executors and nothing is shuffled for scoring.

Defined cases: null texts and texts without words get the score of no evidence;
repeated rows get equal scores; with no labelled rows (or one class only) every
score is that of no evidence; label rows without a document or with a null label
are left out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import runs, texts_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER = {c.encode(): c.lower().encode() for c in map(chr, range(0xC0, 0xDF)) if c != "\xd7"}
WIDTH, STRIDE = 40, 30
NO_EVIDENCE = 0.01


def words_of(text: bytes) -> list[bytes]:
    low = text.lower()
    if b"\xc3" in low:
        low = re.sub(b"\xc3[\x80-\x96\x98-\x9e]", lambda m: UPPER[m[0]], low)
    return WORD.findall(low)


def ngrams_of(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (3 to 5 bytes, with word ends) of all words, and the number of each word's."""
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    ids, owner = [], []
    code = flat.copy()
    for n in range(2, 6):
        code = code[:-1] * np.uint32(0x01000193) ^ flat[n - 1 :]
        if n > 2:
            inside = word[: len(word) - n + 1] == word[n - 1 :]
            mixed = code[inside] * np.uint32(2654435761)
            ids.append(((mixed >> np.uint32(8)) % np.uint32(buckets)).astype(np.int64))
            owner.append(word[: len(word) - n + 1][inside])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(words))


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows of n words; the last one ends with the text."""
    if n <= WIDTH:
        return [0] if n else []
    return [*range(0, n - WIDTH, STRIDE), n - WIDTH]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    buckets: int = 8192
    word_size: int = 8
    char_size: int = 12
    hidden: int = 8
    attention: int = 8
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, rng: np.random.Generator) -> Network:
        h, d = self.hidden, self.word_size + self.char_size
        shapes = {"word": (len(self.vocabulary) + 1, self.word_size), "char": (self.buckets, self.char_size), "in": (d, 6 * h), "in_b": (6 * h,), "fwd": (h, 3 * h), "bwd": (h, 3 * h), "att": (2 * h, self.attention), "att_b": (self.attention,), "att_v": (self.attention,), "out": (2 * h,), "out_b": (1,)}
        scale = {"word": 0.02, "char": 0.05, "in": d**-0.5, "fwd": h**-0.5, "bwd": h**-0.5, "att": (2 * h) ** -0.5, "att_v": 0.3, "out": 0.3}
        self.p = {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shapes.items()}
        self.p["out_b"] -= 2
        return self

    # Inputs of distinct words.

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        ids, counts = ngrams_of(words, self.buckets)
        row = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        firsts = np.cumsum(counts) - counts
        chars = np.add.reduceat(self.p["char"][ids], firsts, axis=0) / counts[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][row] * (row > 0)[:, None], chars], axis=1)
        return x, (row, ids, counts)

    def projected(self, words: list[bytes], part: int = 10_000) -> np.ndarray:
        out = np.empty((len(words), 6 * self.hidden), np.float32)
        for at in range(0, len(words), part):  # n-gram vectors of a part at a time
            out[at : at + part] = self.inputs(words[at : at + part])[0] @ self.p["in"] + self.p["in_b"]
        return out

    # Windows: indices (windows x steps) into projected words, -1 for padding.

    def forward(self, table: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        h = self.hidden
        n, steps = index.shape
        live = (index >= 0).astype(np.float32)
        states = np.zeros((steps, n, 2 * h), np.float32)
        cache: dict = {"live": live, "states": states, "fwd": [None] * steps, "bwd": [None] * steps}
        columns = np.ascontiguousarray(index.T)
        for name, at, order in (("fwd", 0, range(steps)), ("bwd", h, range(steps - 1, -1, -1))):
            weights, side = self.p[name], table[:, 3 * at : 3 * at + 3 * h]
            state = np.zeros((n, h), np.float32)
            for t in order:
                x, u = side[columns[t]], state @ weights
                gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                if keep:
                    cache[name][t] = (state, z, r, new, u[:, 2 * h :])
                state = (new + z * (state - new)) * live[:, t : t + 1]
                states[t, :, at : at + h] = state
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"] + (live.T - 1) * 1e9
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        cache |= {"a": a, "alpha": alpha, "pooled": pooled, "columns": columns}
        return logit, cache

    def backward(self, table: np.ndarray, cache: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        p, h, states, alpha, a = self.p, self.hidden, cache["states"], cache["alpha"], cache["a"]
        steps, n, _ = states.shape
        g = {"out": cache["pooled"].T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = alpha[:, :, None] * d_pooled
        d_alpha = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["att_v"] = np.einsum("tn,tna->a", d_e, a)
        d_a = d_e[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("tnh,tna->ha", states, d_a), d_a.sum(axis=(0, 1))
        d_states += d_a @ p["att"].T
        d_x = np.zeros((steps, n, 6 * h), np.float32)
        for name, at, order in (("fwd", 0, range(steps - 1, -1, -1)), ("bwd", h, range(steps))):
            weights, g[name] = p[name], np.zeros_like(p[name])
            d_state = np.zeros((n, h), np.float32)
            for t in order:
                state, z, r, new, un = cache[name][t]
                d = (d_states[t, :, at : at + h] + d_state) * cache["live"][:, t : t + 1]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (state - new) * z * (1 - z)
                d_r = d_new * un * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_x[t, :, 3 * at : 3 * at + 3 * h] = np.concatenate([d_z, d_r, d_new], axis=1)
                g[name] += state.T @ d_u
                d_state = d * z + d_u @ weights.T
        index = cache["columns"].ravel()
        real = np.flatnonzero(index >= 0)
        order = real[np.argsort(index[real], kind="stable")]
        firsts = np.flatnonzero(np.append(True, np.diff(index[order]) != 0))
        d_table = np.zeros_like(table)
        d_table[index[order[firsts]]] = np.add.reduceat(d_x.reshape(-1, 6 * h)[order], firsts, axis=0)
        return g, d_table

    def gradients(self, words: list[bytes], index: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        x, (row, ids, counts) = self.inputs(words)
        table = x @ self.p["in"] + self.p["in_b"]
        logit, cache = self.forward(table, index, keep=True)
        prob = _sigmoid(logit)
        d_logit = ((prob - target) * weight / weight.sum()).astype(np.float32)
        g, d_table = self.backward(table, cache, d_logit)
        g["in"], g["in_b"] = x.T @ d_table, d_table.sum(axis=0)
        d = d_table @ self.p["in"].T
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], row, d[:, : self.word_size] * (row > 0)[:, None])
        g["char"] = np.zeros_like(self.p["char"])
        np.add.at(g["char"], ids, np.repeat(d[:, self.word_size :] / counts[:, None], counts, axis=0))
        loss = -np.mean(weight * (target * np.log(prob + 1e-9) + (1 - target) * np.log(1 - prob + 1e-9)))
        return g, float(loss)


class Encoder:
    """Words of many texts as rows of a table of projected inputs; at most ``most`` words are kept."""

    def __init__(self, network: Network, most: int = 150_000):
        self.network, self.most = network, most
        self.rows: dict[bytes, int] = {}
        self.table = np.empty((0, 6 * network.hidden), np.float32)

    def encode(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        new = set().union(*texts) - self.rows.keys()
        if len(self.rows) + len(new) > self.most:
            self.rows, self.table, new = {}, self.table[:0], set().union(*texts)
        if new:
            fresh = sorted(new)
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, self.network.projected(fresh)])
        get = self.rows.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]


def window_index(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as (windows x WIDTH) rows padded with -1, and the text of each."""
    owner, rows = [], []
    for i, ids in enumerate(texts):
        starts = windows_of(len(ids))
        if starts and len(ids) < WIDTH:
            rows.append(np.concatenate([ids, np.full(WIDTH - len(ids), -1)])[None])
        elif starts:
            rows.append(ids[np.array(starts)[:, None] + np.arange(WIDTH)])
        owner += [i] * len(starts)
    return (np.concatenate(rows) if rows else np.empty((0, WIDTH), np.int64)), np.array(owner, np.int64)


def score_texts(network: Network, encoder: Encoder, texts: list[list[bytes]], batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and the start of its highest window."""
    index, owner = window_index(encoder.encode(texts))
    short = (index < 0).sum(axis=1)
    order = np.argsort(short, kind="stable")
    logits = np.empty(len(index), np.float32)
    for at in range(0, len(index), batch):
        some = order[at : at + batch]
        steps = max(1, WIDTH - int(short[some].min()))
        logits[some] = network.forward(encoder.table, index[some, :steps])[0]
    best = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(best, owner, logits)
    first = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(logits == best[owner])[::-1].tolist() if len(index) else ():
        first[owner[i]] = i
    scores = np.where(np.isfinite(best), _sigmoid(np.where(np.isfinite(best), best, 0.0)).astype(np.float64), NO_EVIDENCE)
    return scores, first


def evidence(parts: Iterator[tuple[np.ndarray, np.ndarray]], size: int, toxic: np.ndarray, least: float) -> np.ndarray:
    """z-scores of log odds: in how many toxic and clean documents each of ``size`` features is found.

    ``parts`` are (feature, document) arrays; a document is in one part only.
    """
    a, b = np.full(size, 0.5), np.full(size, 0.5)
    for found, owner in parts:
        pairs = np.unique(owner * np.int64(size) + found)
        feature, label = pairs % size, toxic[pairs // size]
        a += np.bincount(feature[label], minlength=size)
        b += np.bincount(feature[~label], minlength=size)
    odds = np.log(a / (toxic.sum() + 1)) - np.log(b / ((~toxic).sum() + 1))
    z = odds / np.sqrt(1 / a + 1 / b)
    return np.sign(z) * np.maximum(np.abs(z) - least, 0)  # less than ``least`` standard errors says nothing


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def train(rows: list[tuple[bytes, int]], *, rounds: int = 5, batch: int = 256, rate: float = 0.01, most_words: int = 2000, most_windows: int = 10, least_steps: int = 20, seed: int = 5) -> Network | None:
    """Fit on (text, label) rows; None if they hold fewer than two classes.

    The first dimension of the word and n-gram vectors starts as the evidence of
    the training rows; words without enough evidence have no vector of their own.
    """
    if len({label for _, label in rows}) < 2:
        return None
    rng = np.random.default_rng(seed)
    toxic = np.array([y for _, y in rows]) == 1
    seen = _Numbers()
    numbers = [np.fromiter(map(seen.__getitem__, words_of(t)), np.int32, -1) for t, _ in rows]
    if not seen:
        return None
    # Words in order of their bytes, so that the result does not hang on the order of rows.
    distinct = sorted(seen)
    place = np.empty(len(seen), np.int32)
    place[[seen[w] for w in distinct]] = np.arange(len(distinct))
    numbers = [place[n].astype(np.int64) for n in numbers]
    seen.clear()

    def words_by_document() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, own in enumerate(numbers):
            yield np.unique(own), np.array([i])

    def ngrams_by_document() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, own in enumerate(numbers):
            if len(own):
                yield ngrams_of([distinct[w] for w in np.unique(own).tolist()], buckets)[0], np.array([i])

    buckets = Network.buckets
    weight_of = evidence(words_by_document(), len(distinct), toxic, 2.0)
    best = np.argsort(-np.abs(weight_of), kind="stable")[:most_words]
    best = best[np.abs(weight_of[best]) > 0.5]
    network = Network({distinct[i]: k for k, i in enumerate(best.tolist(), 1)}).start(rng)
    network.p["word"][1:, 0] = 0.5 * weight_of[best]
    network.p["char"][:, 0] = 0.5 * evidence(ngrams_by_document(), buckets, toxic, 3.0)

    index, owner = window_index(numbers)
    scores = np.where(index >= 0, np.append(weight_of, 0)[index], -9).max(axis=1)
    deal = rng.permutation(len(index))
    nth = np.empty(len(index), np.int64)
    order = deal[np.argsort(owner[deal], kind="stable")]
    nth[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    pool = np.flatnonzero(toxic[owner] | (nth < most_windows))
    index, owner, scores = index[pool], owner[pool], scores[pool]
    m = {k: np.zeros_like(v) for k, v in network.p.items()}
    v = {k: np.zeros_like(x) for k, x in network.p.items()}
    t = 0
    for turn in range(rounds):
        order = np.lexsort((-scores, owner))
        top = order[np.append(True, owner[order][1:] != owner[order][:-1])]
        others = np.flatnonzero(~toxic[owner])
        chosen = np.concatenate([top, rng.choice(others, min(len(others), 1500), replace=False)])
        target = toxic[owner[chosen]].astype(np.float32)
        weight = np.where(target == 1, max(1.0, 0.5 * (target == 0).sum() / max(1, target.sum())), 1.0).astype(np.float32)
        passes = max(1, -(-least_steps * batch // len(chosen)))
        deal = np.concatenate([rng.permutation(len(chosen)) for _ in range(passes)])
        for at in range(0, len(deal), batch):
            some = chosen[deal[at : at + batch]]
            used, local = np.unique(index[some], return_inverse=True)
            local = local.reshape(index[some].shape) - (used[0] == -1)
            words = [distinct[i] for i in used[used >= 0].tolist()]
            g, _ = network.gradients(words, local, target[deal[at : at + batch]], weight[deal[at : at + batch]])
            t += 1
            step = rate * (0.3 if turn >= rounds - 2 else 1.0) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                network.p[k] -= (step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        if turn + 1 < rounds:
            table = network.projected(distinct)
            scores = np.concatenate([network.forward(table, index[at : at + 2048])[0] for at in range(0, len(index), 2048)])
    return network


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, *, most_toxic: int, most_clean: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """The bounded training sample, as (text, label) rows in the order of the key's hash."""
    known = labels.filter(allowed & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    short = docs.select("doc_id", body.alias("text")).filter(F.octet_length("text") <= most_bytes)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # The limits bound what is broadcast; the texts are never shuffled.
    chosen = [known.filter(F.col("toxic") == label).orderBy(*order).limit(most) for label, most in ((1, most_toxic), (0, most_clean))]
    found = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    # One row for each key, whatever is repeated: that bounds what the driver gets.
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (-r["toxic"], zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    return [(r["text"].encode("utf-8", "surrogatepass"), r["toxic"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, *, most_toxic: int = 1200, most_clean: int = 1800, most_bytes: int = 16_000) -> Network | None:
    return train(labelled_sample(docs, labels, allowed, most_toxic=most_toxic, most_clean=most_clean, most_bytes=most_bytes))


def scored(docs: DataFrame, network: Network | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text), ``score`` and ``at`` (first word of the highest window) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = held.value
        encoder = Encoder(network) if network else None
        for batch in runs(batches, "text", 2_000_000):
            if network is None:
                scores = np.full(batch.num_rows, NO_EVIDENCE)
            else:
                scores, _ = score_texts(network, encoder, [words_of(t) for t in texts_of(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(scores, pa.float64())], names=["doc_id", "text_key", "score"])

    body = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key")).mapInArrow(apply, "doc_id long, text_key long, score double")


def keep_clean(docs: DataFrame, network: Network | None, *, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    found = scored(docs, network, key=key, text=text).filter(F.col("score") >= threshold).select("doc_id", "text_key").distinct()
    same = F.col(f"d.{key}").eqNullSafe(F.col("f.doc_id")) & F.xxhash64(F.col(f"d.{text}").cast("string")).eqNullSafe(F.col("f.text_key"))
    return docs.alias("d").join(found.alias("f").hint("shuffle_hash"), same, "left_anti")

"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  A block enters as the mean of
learned vectors of its tag path (tags and words of class, id and role, hashed), the
mean of hashed vectors of its distinct words and a few measures (length, links, position).  A
bidirectional LSTM in numpy reads the whole sequence, so each block is labelled
with the page around it.  Pages go through in batches of like length.

The labeller learns from pages that ``htmlpages`` builds; it is the same for every
input, is trained once per process with a fixed seed, and is sent to the executors
(its size is fixed by the constants below).

Defined cases: null and empty pages, and pages without article blocks, give an
empty text; text outside any element is a block; a page of any length and depth
is read whole in linear time, and of its path a block sees the innermost 128 distinct
tags and names; repeated rows give equal results; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .htmlpages import Maker
from .htmlparse import Block, Path, blocks_of, bucket
from .shared import runs

TAGS, WORDS, TAG_SIZE, WORD_SIZE, MEASURES, HIDDEN = 2048, 1024, 16, 4, 4, 16
#: Logit from which a block is kept: a lost article block is worse than a kept other one.
LEAST = -0.8
INPUT = 2 * TAG_SIZE + WORD_SIZE + MEASURES


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def features(blocks: list[Block], cache: dict) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]], list[tuple[int, ...]], np.ndarray]:
    """Tag buckets of the path, of its last two elements, word buckets and measures of each block."""
    paths, leaves, words, rows = [], [], [], []
    n = len(blocks)
    for i, b in enumerate(blocks):
        known = cache.get(b.path)
        if known is None:
            known = cache[b.path] = (tuple(bucket(t, TAGS) for t in b.path.tokens) or (0,), (bucket("leaf " + b.path.tag, TAGS), bucket("over " + (b.path.parent.tag if b.path.parent else ""), TAGS)))
        paths.append(known[0])
        leaves.append(known[1])
        size, text = len(b.text), b.text
        words.append(tuple([bucket(w, WORDS) for w in dict.fromkeys(text.split(" "))]))
        rows.append((np.log1p(size) / 20, b.link / size, 0.5 * ("\xa9" in text), i / n / 4))
    return paths, leaves, words, np.array(rows, np.float32).reshape(n, MEASURES)


def _bag(vectors: np.ndarray, bags: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    ids = np.fromiter((i for bag in bags for i in bag), np.int64, int(sizes.sum()))
    return np.add.reduceat(vectors[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32), ids, sizes


class Labeller:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        shapes = {"tag": (TAGS, TAG_SIZE), "leaf": (TAGS, TAG_SIZE), "word": (WORDS, WORD_SIZE), "in": (INPUT, 8 * HIDDEN), "in_b": (8 * HIDDEN,), "fwd": (HIDDEN, 4 * HIDDEN), "bwd": (HIDDEN, 4 * HIDDEN), "out": (2 * HIDDEN,), "own": (INPUT,), "out_b": (1,)}
        scale = {"tag": 0.5, "leaf": 0.5, "word": 0.05, "in": INPUT**-0.5, "fwd": HIDDEN**-0.5, "bwd": HIDDEN**-0.5, "out": 0.2}
        self.p = {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shapes.items()}

    def inputs(self, parts: tuple) -> tuple[np.ndarray, list]:
        paths, leaves, words, rows = parts
        bags = [(name, *_bag(self.p[name], bag)) for name, bag in (("tag", paths), ("leaf", leaves), ("word", words))]
        return np.concatenate([*(b[1] for b in bags), rows], axis=1), bags

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits (steps x pages); index (steps x pages) into rows of x, -1 for padding."""
        h = HIDDEN
        table = np.concatenate([x @ self.p["in"] + self.p["in_b"], np.zeros((1, 8 * h), np.float32)])
        steps, n = index.shape
        live = (index >= 0).astype(np.float32)[:, :, None]
        states = np.zeros((steps, n, 2 * h), np.float32)
        cache: dict = {"fwd": [None] * steps, "bwd": [None] * steps, "states": states, "live": live, "index": index}
        for name, at, order in (("fwd", 0, range(steps)), ("bwd", h, range(steps - 1, -1, -1))):
            side, weights = table[:, 4 * at : 4 * at + 4 * h], self.p[name]
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in order:
                a = side[index[t]] + state @ weights
                gates = _sigmoid(a[:, : 3 * h])
                i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(a[:, 3 * h :])
                new = (f * cell + i * g) * live[t]
                squashed = np.tanh(new)
                if keep:
                    cache[name][t] = (state, cell, i, f, o, g, squashed)
                state, cell = o * squashed * live[t], new
                states[t, :, at : at + h] = state
        own = np.append(x @ self.p["own"], np.float32(0))
        return states @ self.p["out"] + own[index] + self.p["out_b"][0], cache

    def gradients(self, parts: tuple, index: np.ndarray, target: np.ndarray) -> dict:
        h, p = HIDDEN, self.p
        x, bags = self.inputs(parts)
        logit, cache = self.forward(x, index, keep=True)
        live, states = cache["live"], cache["states"]
        d_logit = ((_sigmoid(logit) - target) * live[:, :, 0] / live.sum()).astype(np.float32)
        g = {"out": np.einsum("tn,tnh->h", d_logit, states), "out_b": d_logit.sum(keepdims=True).reshape(1)}
        d_states = d_logit[:, :, None] * p["out"]
        steps, n = index.shape
        d_a = np.zeros((steps, n, 8 * h), np.float32)
        for name, at, order in (("fwd", 0, range(steps - 1, -1, -1)), ("bwd", h, range(steps))):
            weights, g[name] = p[name], np.zeros_like(p[name])
            d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in order:
                state, cell, i, f, o, new, squashed = cache[name][t]
                d = (d_states[t, :, at : at + h] + d_state) * live[t]
                d_c = (d * o * (1 - squashed * squashed) + d_cell) * live[t]
                da = np.concatenate([d_c * new * i * (1 - i), d_c * cell * f * (1 - f), d * squashed * o * (1 - o), d_c * i * (1 - new * new)], axis=1)
                d_a[t, :, 4 * at : 4 * at + 4 * h] = da
                g[name] += state.T @ da
                d_state, d_cell = da @ weights.T, d_c * f
        real = index >= 0
        d_table = np.zeros((len(x), 8 * h), np.float32)
        d_table[index[real]] = d_a[real]
        d_own = np.zeros(len(x), np.float32)
        d_own[index[real]] = d_logit[real]
        g["in"], g["in_b"], g["own"] = x.T @ d_table, d_table.sum(axis=0), x.T @ d_own
        d_x = d_table @ p["in"].T + d_own[:, None] * p["own"]
        at = 0
        for name, mean, ids, sizes in bags:
            width = mean.shape[1]
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], ids, np.repeat(d_x[:, at : at + width] / sizes[:, None], sizes, axis=0))
            at += width
        return g

    def label(self, pages: list[list[Block]], cache: dict, most_blocks: int = 20_000) -> list[np.ndarray]:
        """True for the article blocks of each page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= most_blocks:
                end += 1
            some = order[at:end]
            index, parts = batch_of([pages[i] for i in some], cache)
            logit, _ = self.forward(self.inputs(parts)[0], index)
            for column, i in enumerate(some):
                out[i] = logit[: len(pages[i]), column] > LEAST
            at = end
        return out


def batch_of(pages: list[list[Block]], cache: dict) -> tuple[np.ndarray, tuple]:
    parts: tuple = ([], [], [], [])
    index = np.full((max(map(len, pages)), len(pages)), -1, np.int64)
    at = 0
    for column, blocks in enumerate(pages):
        for into, new in zip(parts, features(blocks, cache), strict=True):
            into.append(new) if isinstance(new, np.ndarray) else into.extend(new)
        index[: len(blocks), column] = np.arange(at, at + len(blocks))
        at += len(blocks)
    return index, (*parts[:3], np.concatenate(parts[3]))


MARK = re.compile(r"</?x-(?:yes|no)>")


def example(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of a built page; the marks are cut out of the paths."""
    marked = blocks_of(page.replace("<x-no>", "</p><x-no>"))  # what follows an open paragraph is not inside it
    plain = blocks_of(MARK.sub("", page))
    labels = np.array(["x-yes" in b.path.tokens and "x-no" not in b.path.tokens for b in marked], np.float32)
    return (plain, labels) if len(plain) == len(labels) else ([], labels[:0])


@functools.lru_cache(maxsize=1)
def trained(pages: int = 2000, rounds: int = 6, batch: int = 24, rate: float = 0.006, seed: int = 23) -> Labeller:
    """The labeller, fitted on ``pages`` built pages."""
    maker, rng, labeller, cache = Maker(seed), np.random.default_rng(seed), Labeller(), {}
    examples = [e for e in (example(maker.page()) for _ in range(pages)) if e[0]]
    m = {k: np.zeros_like(v) for k, v in labeller.p.items()}
    v = {k: np.zeros_like(x) for k, x in labeller.p.items()}
    t = 0
    for turn in range(rounds):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), batch):
            some = [examples[i] for i in order[at : at + batch]]
            index, parts = batch_of([b for b, _ in some], cache)
            target = np.zeros(index.shape, np.float32)
            for column, (_, labels) in enumerate(some):
                target[: len(labels), column] = labels
            t += 1
            step = rate * (1.0 - turn / rounds) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, d in labeller.gradients(parts, index, target).items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                labeller.p[k] -= (step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return labeller


def extract_pages(pages: list[str], labeller: Labeller) -> list[str]:
    root, cache = Path(None, "", ()), {}
    blocks = [blocks_of(p, root) for p in pages]
    return ["\n\n".join(b.text for b, yes in zip(own, keep, strict=True) if yes) for own, keep in zip(blocks, labeller.label(blocks, cache), strict=True)]


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every row: page_id, url, text, n_chars (code points)."""
    held = pages.sparkSession.sparkContext.broadcast(trained())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "html", 4_000_000):
            texts = extract_pages([p or "" for p in batch.column("html").to_pylist()], held.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(apply, "page_id long, url string, text string, n_chars long")

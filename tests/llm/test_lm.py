import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import lm

START, END = "<s>", "</s>"


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7


@pytest.fixture(scope="module")
def scored(spark, make_docs, corpus):
    f = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    return lm.score(make_docs(corpus), f != 2, f == 5, bucket_keys=500).collect()


def test_base_counts_equal_brute_force(scored, corpus):
    train = [tokens(t) for d, t in corpus if fold(d) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((d, fold(d) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in corpus)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == want


def test_model_equals_brute_force(scored, corpus):
    """The same model built from dictionaries, with the grid of held-out events and EM."""
    keep = [tokens(t) for d, t in corpus if fold(d) != 2]
    slices = [tokens(t) for d, t in corpus if fold(d) == 5]

    def counts(docs):
        one, two, context = Counter(), Counter(), Counter()
        for t in docs:
            one.update(t)
            two.update(zip([START, *t], t))
            context.update([START, *t[:-1]])
        return one, two, context

    full, gone = counts(keep), counts(slices)
    base = [Counter({k: n - b[k] for k, n in a.items()}) for a, b in zip(full, gone, strict=True)]
    v = len(full[0])
    bucket = lambda n: min(1 + int(math.log2(n)), 19) if n > 0 else 0

    def p(model, a, b):
        one, two, context = model
        total = sum(one.values())
        return (one[b] / total if total else 0.0, two[a, b] / context[a] if context[a] else 0.0), bucket(context[a])

    events = Counter()
    for t in slices:
        for a, b in zip([START, *t], t):
            e, k = p(base, a, b)
            events[k, tuple(int(np.round(-np.log2(x) * lm.STEPS)) if x > 0 else -1 for x in e)] += 1
    weights = lm.learn_weights([(k, s, n) for (k, s), n in sorted(events.items())], 2, 20, 1 / (v + 1))
    assert np.allclose(weights.sum(axis=1), 1)
    by_text = {}
    for d, t in corpus:
        total = 0.0
        for a, b in zip([START, *tokens(t)], tokens(t)):
            e, k = p(full, a, b)
            total += math.log10(weights[k] @ [1 / (v + 1), *e])
        by_text[d] = total
    for r in scored:
        assert r.score == pytest.approx(by_text[r.doc_id], abs=1e-6)


def test_probabilities_sum_to_one():
    weights = lm.learn_weights([(3, (8, 4), 5), (3, (20, -1), 2), (0, (16, -1), 3)], 2, 5, 0.01)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[1:] > 0).all() and weights[0, 2] == 0


def test_trigrams_and_empty(spark, make_docs, corpus):
    held = F.col("doc_id") % 3 == 0
    rows = lm.score(make_docs(corpus), ~held, F.col("doc_id") % 3 == 1, order=3).collect()
    assert len(rows) == len(corpus) and all(r.score < 0 for r in rows)
    assert lm.score(make_docs([]), F.lit(True), F.lit(False)).count() == 0
    lone = lm.score(make_docs([(1, "a b")]), F.lit(False), F.lit(False)).collect()[0]
    assert lone.score == pytest.approx(0.0) and lone.train_tokens == 0

import numpy as np

from quirelake.llm import neardup
from quirelake.llm.components import connected
from quirelake.llm.shared import Scratch, WordHashes
from tests.llm.conftest import text_of


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(corpus):
    sets = [shingles(t) for _, t in corpus]
    root = list(range(len(corpus)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(corpus)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(corpus):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, len(sets[i]), low[top(i)] if sets[i] else d) for i, (d, _) in enumerate(corpus))


def test_equals_brute_force(spark, make_docs, corpus):
    rows = neardup.near_duplicates(make_docs(corpus)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(corpus)


def test_large_group_in_small_tiles(spark, make_docs):
    """A group of near copies, split over many pairs of groups, stays whole."""
    import random

    r = random.Random(2)
    base = text_of(r, 6).split()
    corpus = []
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"w{r.randrange(9)}"
        corpus.append((i, " ".join(words)))
    corpus += [(100 + i, text_of(r, 3)) for i in range(20)]
    rows = neardup.near_duplicates(make_docs(corpus), group_bytes=6000).collect()
    assert sorted((d.doc_id, d.n_shingles, d.component_id) for d in rows) == brute(corpus)


def test_keep_one_and_empty(spark, make_docs, corpus):
    kept = neardup.keep_one(make_docs(corpus))
    assert kept.columns == make_docs(corpus).columns
    want = [d for d, _, c in brute(corpus) if d == c]
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert neardup.near_duplicates(make_docs([])).count() == 0
    assert neardup.keep_one(make_docs([(None, None), (None, "a b"), (4, "a b")])).count() == 2  # of the copies the one with a key stays


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(40):
            n = int(rng.integers(20, 800))
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64)])) << np.uint64(1) for _ in range(2)]
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            regs = neardup.sketches(np.concatenate(sets), np.array([len(s) for s in sets]))
            errors.append(neardup.estimate(regs[0], regs[1:])[0] - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_shingle_counts():
    texts = [b"", b"A b", b"a b c d e", b"a a a a a a a", b"x\ty\nz  q w e"]
    hashes, counts = neardup.shingle_hashes(texts, WordHashes())
    assert counts.tolist() == [len(shingles(t.decode())) for t in texts] and len(hashes) == counts.sum()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (201, None)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "t").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "t").count() == 0

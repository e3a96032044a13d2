import random
import re

import pytest

from quirelake.llm.decontamination import build_index, decontaminate, keep_clean, search
from tests.llm.conftest import text_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(corpus, items, width):
    out = []
    for d, t in corpus:
        own, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            n = min(width, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(own) - n + 1 if n else 0):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out.append((d, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark, corpus):
    r = random.Random(9)
    own = [(1, " ".join(corpus[4][1].split()[3:25])), (2, text_of(r, 2)), (3, "ONE"), (10, None), (11, ""), (12, corpus[8][1]), (12, corpus[8][1]), (13, "kaban")]
    return own, spark.createDataFrame([(i, t, "x") for i, t in own], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block", [4_000_000, 100])
def test_equals_brute_force(spark, make_docs, corpus, items, block):
    rows = decontaminate(make_docs(corpus), items[1], width=10, block_bytes=block).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in rows), key=str)
    assert got == brute(corpus, items[0], 10)


def test_small_segments_give_the_same(spark, make_docs, corpus, items):
    index = build_index(make_docs(corpus), segment_bytes=200)
    got = sorted((r.doc_id, sorted(r["items"])) for r in search(index, items[1]).select("doc_id", "items").collect() if r["items"])
    assert got == sorted((d, f) for d, _, _, f in brute(corpus, items[0], 10) if f)


def test_proximity_equals_brute_force(spark, make_docs):
    docs = [(1, "a x b y c"), (2, "c b a"), (3, "a x x x x x b c"), (4, "a b"), (5, "b a x a c b"), (6, None)]
    item = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    for span in (3, 4, 5, 6, 8):
        rows = decontaminate(make_docs(docs), item, width=3, span=span).collect()
        near = {r.doc_id for r in rows if r.near_items}
        want = {d for d, t in docs if any({"a", "b", "c"} <= set(words(t)[i : i + span]) for i in range(len(words(t))))}
        assert near == want


def test_empty_tables_and_filter(spark, make_docs, corpus, items):
    none = items[1].filter("false")
    assert decontaminate(make_docs(corpus), none).filter("n_hit > 0").count() == 0
    assert decontaminate(make_docs([]), items[1]).count() == 0
    kept = keep_clean(make_docs(corpus), items[1])
    assert kept.columns == make_docs(corpus).columns
    want = [(d, t) for d, t in corpus if not any(x == d and h for x, _, h, _ in brute([(d, t)], items[0], 10))]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)

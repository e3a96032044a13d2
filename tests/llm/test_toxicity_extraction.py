import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import extraction, htmlparse, toxicity
from quirelake.llm.htmlpages import Maker
from tests.llm.conftest import text_of


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(8)
    bad = ["vilegit", "vilesnak", "gromp"]
    rows = []
    for i in range(240):
        text = text_of(r, 3)
        toxic = i % 3 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(bad))
            text = " ".join(words)
        rows.append((i, text, int(toxic)))
    return rows


def test_held_out_accuracy_and_defined_cases(spark, make_docs, labelled):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in labelled] + [(9999, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    extra = [(500, None), (501, ""), (502, "..."), (503, text_of(random.Random(1), 300) + " gromp vilegit"), (0, labelled[0][1])]
    docs = make_docs([(i, t) for i, t, _ in labelled] + extra)
    network = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = {}
    for r in toxicity.scored(docs, network).collect():
        assert got.setdefault(r.doc_id, r.score) == r.score and 0 <= r.score <= 1
    held = [(got[i] >= 0.3) == bool(y) for i, _, y in labelled if i % 4 == 2]
    assert np.mean(held) >= 0.9
    assert got[500] == got[501] == got[502] == toxicity.NO_EVIDENCE and got[503] >= 0.3
    kept = toxicity.keep_clean(docs, network)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}
    assert toxicity.fit(docs, labels.filter("false"), F.lit(True)) is None
    assert toxicity.scored(docs, None).filter(F.col("score") != toxicity.NO_EVIDENCE).count() == 0
    assert toxicity.scored(docs.filter("false"), network).count() == 0


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    words = [b"alpha", b"beta", b"gamma", b"delta"]
    net = toxicity.Network({b"beta": 1}, buckets=64, hidden=3, attention=3).start(rng)
    net.p = {k: v.astype(np.float64) + 0.1 for k, v in net.p.items()}
    index = np.array([[0, 1, 2, -1], [3, 1, 0, 2]])
    target, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        logit, _ = net.forward(net.inputs(words)[0] @ net.p["in"] + net.p["in_b"], index)
        p = 1 / (1 + np.exp(-logit.astype(np.float64)))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / weight.sum()

    g, _ = net.gradients(words, index, target, weight)
    for name in ("fwd", "bwd", "att_v", "out", "in", "word"):
        at = (1, 0) if net.p[name].ndim == 2 else (0,)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        high = loss()
        net.p[name][at] = old - 1e-2
        low = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((high - low) / 2e-2, rel=0.05, abs=2e-4), name


def test_windows_cover_all_words():
    for n in (0, 1, 39, 40, 41, 100, 1000):
        seen = set()
        for s in toxicity.windows_of(n):
            seen |= set(range(s, min(n, s + toxicity.WIDTH)))
        assert seen == set(range(n))


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One  two<br>three<p>Four&nbsp;five</p><!-- no --></article><footer>&copy; x</footer></body></html>'


def test_blocks_and_text(spark):
    texts = [b.text for b in htmlparse.blocks_of(PAGE)]
    assert texts == ["T", "Home", "Buy", "A & B", "One two three", "Four five", "© x"]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p" * 50), (5, "x", "<div>" * 3000 + "deep" + "</div>" * 10)]
    got = extraction.extract(spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "A & B\n\nOne two three\n\nFour five" and by[1].n_chars == len(by[1].text)
    assert by[2].text == "" and by[3].n_chars == 0
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_labeller_on_pages_it_has_not_seen():
    maker, labeller = Maker(4242), extraction.trained()
    right = total = 0
    for _ in range(150):
        blocks, labels = extraction.example(maker.page())
        if blocks:
            right += (labeller.label([blocks], {})[0] == (labels > 0)).sum()
            total += len(labels)
    assert right / total > 0.96


HARD = ["<b" * 200_000, '<a "' * 200_000, '<a "><b" ' * 60_000 + '"', "".join(f'<div class="c{i}">t' for i in range(20_000)), "<b>" * 20_000 + "</x><h1></h1>" * 20_000, "<p><div>" + "<b>" * 20_000 + "<h1>x</h1>" * 20_000, "<svg></sv" * 50_000, "<!-" * 200_000]


def test_malformed_pages_take_linear_time():
    import time

    for page in HARD:
        began = time.perf_counter()
        htmlparse.blocks_of(page)
        assert time.perf_counter() - began < 10, page[:20]


def test_hand_written_page():
    """A page that ``htmlpages`` has not made, with other names and nesting."""
    page = """<!DOCTYPE html><html><head><title>t</title><style>p > a {}</style></head><body><header><a href="/">Home</a></header>
<nav><ul><li><a href=/a>News</a><li><a href="/b">Sport</a></ul></nav><main><article><h1>Rain in the north</h1>
<p>Rain fell on the northern hills for three days &amp; the river rose by a metre, the council said on Monday.</p>
<p>Roads near the old bridge stay closed until the water has gone down, and schools open again on Thursday.</p></article></main>
<footer><p>&copy; 2024 Example</p></footer><script>if (a < b) { x("</p>") }</script></body></html>"""
    (text,) = extraction.extract_pages([page], extraction.trained())
    assert text.split("\n\n") == [
        "Rain in the north",
        "Rain fell on the northern hills for three days & the river rose by a metre, the council said on Monday.",
        "Roads near the old bridge stay closed until the water has gone down, and schools open again on Thursday.",
    ]

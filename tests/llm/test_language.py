import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quirelake.llm import queries
from quirelake.llm.language import Space, fit, identify, letters_of


def test_letters():
    spell = lambda t: "".join(map(chr, letters_of(t)))
    assert spell("Ab,  c1d!") == " ab c d "
    assert spell("ÉTÉ\n北京") == " été 北京 "
    assert spell("कि") == " कि "  # a vowel sign belongs to the word
    assert spell("12 .,") == "" and spell("") == "" and spell("́") == ""
    assert spell("x") == " x "


def test_bundle_is_the_sum_of_bound_vectors():
    """Against the definition, letter by letter; blocks and the emptied table change nothing."""
    space, text = Space(256, 3), "Der Anfang, der the the"
    letters = letters_of(text).tolist()
    want = np.zeros(256)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        want += np.roll(space.letter(a), 2) * np.roll(space.letter(b), 1) * space.letter(c)
    assert (space.bundle(text) == want).all()
    r = random.Random(4)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyzäöü éèñ") for _ in range(30_000))
    from quirelake.llm import language

    whole, block, most = Space(64, 3).bundle(long), language.BLOCK, language.MOST_GRAMS
    try:
        language.BLOCK, language.MOST_GRAMS = 997, 4096
        assert (Space(64, 3).bundle(long) == whole).all()
    finally:
        language.BLOCK, language.MOST_GRAMS = block, most


def test_defined_cases(spark, make_docs):
    docs = make_docs([(1, "the cat and the dog"), (2, "der hund und die katze"), (3, None), (4, ""), (5, "12 34"), (6, "the dog"), (7, "und der"), (1, "the cat and the dog"), (None, "the " * 400_000)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id").isin(2, 7), "de").when(F.col("doc_id") != 6, "en"))
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in identify(docs, fit(docs, F.col("doc_id") < 6)).collect()), key=str)
    assert [(i, p) for i, p, _ in got] == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (7, "de"), (None, "en")], key=str)
    assert all(0 <= s <= 1 and (s == 0) == (p == "und") for _, p, s in got)
    none = identify(docs, fit(docs, F.lit(False)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert identify(make_docs([]), fit(make_docs([]), F.lit(True))).count() == 0


def test_training_ignores_what_it_must(spark, make_docs):
    """Rows of the held-out fold and rows without language change no prototype; the order of rows does not either."""
    docs = make_docs([(i, f"some words of text {i} abc") for i in range(40)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    learn = F.col("doc_id") % 3 != 0
    base = fit(docs, learn)
    changed = docs.withColumn("text", F.when(learn & F.col("lang").isNotNull(), F.col("text")).otherwise("zzz"))
    assert (fit(changed.repartition(5), learn).prototypes == base.prototypes).all()


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    known = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet' WHERE regexp_matches(text, '[a-zA-Z]')").fetchall())
    rows = queries.op12_language(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 200 and sum(r.lang_pred == known[r.doc_id] for r in held) / len(held) >= 0.98

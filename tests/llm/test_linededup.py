import random

from quirelake.llm.linededup import chunk_marks, remove_repeats
from tests.llm.conftest import WORDS, sentence, text_of


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_planted_passages_go_from_all_but_the_first(spark, make_docs):
    r = random.Random(3)
    passage = "\n".join(sentence(r, 12) for _ in range(6))
    inline = " ".join(sentence(r, 11) for _ in range(6))
    long_line = sentence(r, 70)
    docs = {i: text_of(r) for i in range(40)}
    for i in range(10, 20):
        docs[i] = docs[i] + "\n" + passage + "\n" + text_of(r)
    for i in range(20, 26):
        docs[i] = docs[i] + " " + inline + " " + text_of(r)
    for i in range(26, 30):
        docs[i] = docs[i] + "\n" + long_line + "\n" + text_of(r)
    got = rows_of(remove_repeats(make_docs(docs), length="n_chars"))
    for first, last, text in ((10, 20, passage), (20, 26, inline), (26, 30, long_line)):
        assert text in got[first]
        assert all(text not in got[i] for i in range(first + 1, last))
        gone = [(len(docs[i]) - len(got[i])) / len(text) for i in range(first + 1, last)]
        assert min(gone) >= 0.5 and sum(gone) / len(gone) >= 0.8
    assert all(got[i] == docs[i] for i in [*range(10), *range(30, 40)])


def test_byte_comparison_and_owner(spark, make_docs):
    """Every removed piece is found word for word in a document of smaller key."""
    r = random.Random(4)
    shared = [" ".join(sentence(r, 9) for _ in range(5)) for _ in range(4)]
    docs = {i: "\n".join(r.sample(shared, 2) + [text_of(r, 2)]) for i in range(12)}
    got = rows_of(remove_repeats(make_docs(docs)))
    lines = lambda t: [x.strip() for x in t.replace(". ", ".\n").split("\n") if x.strip()]
    for i, t in docs.items():
        gone = set(lines(t)) - set(lines(got.get(i, "")))
        before = set().union(*(lines(docs[j]) for j in range(i)))
        assert gone <= before


def test_defined_cases(spark, make_docs):
    r = random.Random(5)
    text = text_of(r)
    docs = [(1, text), (2, text), (3, None), (4, ""), (5, "All rights reserved.\nLes."), (6, "All rights reserved.\nLes."), (None, text), (1, text)]
    out = remove_repeats(make_docs(docs), length="n_chars")
    assert out.columns == make_docs(docs).columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, text), (1, text), (3, None), (4, ""), (5, docs[4][1]), (6, docs[5][1])], key=str)
    assert remove_repeats(make_docs([])).count() == 0
    # Without keys the hash of the text decides; a row with a key comes before.
    other = text + "\nLes."
    out = rows_of(remove_repeats(make_docs([(None, text), (None, other), (None, None)])))
    got = [r.text for r in remove_repeats(make_docs([(None, text), (None, other), (None, None)])).collect()]
    assert sorted(map(str, got)) in (sorted([other, "None"]), sorted([text, "Les.", "None"])), out


def test_clashing_columns(spark, make_docs):
    """Columns named as those that the operator makes itself come back as they are."""
    r = random.Random(11)
    text = text_of(r)
    names = ["rest", "new", "doc", "m", "found", "at", "a.b"]
    docs = make_docs({1: text, 2: text + "\n" + text_of(r)})
    for n in names:
        docs = docs.withColumn(n, docs.doc_id * 3)
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    assert all(x[n] == 3 * x.doc_id for x in out.collect() for n in names) and out.count() == 2


def test_no_python_on_executors(spark, make_docs, corpus):
    plan = remove_repeats(make_docs(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chunks_span_several_lines(spark, make_docs, corpus):
    """Boundaries are chosen by the rolling hash, not nearly everywhere."""
    from pyspark.sql import functions as F

    marks = make_docs(corpus).select(F.explode(chunk_marks(F.col("text"))).alias("m")).select("m.*")
    phrases, alone = marks.agg(F.avg("n"), F.avg((F.col("n") == 1).cast("int"))).first()
    assert phrases > 2.5 and alone < 0.1


def test_a_stretch_needs_one_keeper(spark, make_docs):
    """Two lines of 15 words from different documents are no passage of 25 words."""
    r = random.Random(6)
    first, second = sentence(r, 15), sentence(r, 15)
    docs = {0: first + "\n" + text_of(r), 1: text_of(r) + "\n" + second, 2: text_of(r) + "\n" + first + "\n" + second + "\n" + text_of(r)}
    got = rows_of(remove_repeats(make_docs(docs)))
    assert got == docs


def test_passages_pasted_mid_sentence(spark, make_docs):
    """Passages of 50 to 60 words inside differing lines, of sentences or of one long one."""
    r = random.Random(8)
    words = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passages, docs = [], {}
    for i in range(60):
        n = r.randint(50, 60)
        whole = words(n)
        if i % 2:
            parts = whole.split(" ")
            parts[17] += "."
            parts[34] += "."
            whole = " ".join(parts)
        passages.append(whole)
        for j in (0, 1000):
            docs[j + i] = text_of(r) + "\n" + words(9) + " " + whole + " " + words(9) + ".\n" + text_of(r)
    got = rows_of(remove_repeats(make_docs(docs)))
    assert all(got[i] == docs[i] for i in range(60))
    left = [i for i in range(60) if len(docs[1000 + i].split()) - len(got[1000 + i].split()) < len(passages[i].split()) - 6]
    # Known residue: 3 of 60 are left whole or in part (see README).
    assert len(left) <= 3


def letters(r, n, alphabet="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(n))


PROBES = {
    "lower-case lines of four words": lambda r: "\n".join(letters(r, 4) for _ in range(40)),
    "lower-case words": lambda r: letters(r, 200),
    "sixty words": lambda r: letters(r, 60),
    "Cyrillic words": lambda r: letters(r, 60, "абвгдежзиклмнопрстуфхцчшщыэюя"),
    "CJK lines": lambda r: "\n".join("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(60)) for _ in range(10)),
    "one CJK line": lambda r: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(600)),
    "hex": lambda r: "".join(r.choice("0123456789abcdef") for _ in range(3000)),
    "code": lambda r: "\n".join("    " * r.randint(0, 3) + f"{letters(r, 1)} = {letters(r, 1)}({r.randint(0, 99)});" for _ in range(40)),
    "a menu": lambda r: "\n".join(letters(r, 1).capitalize() for _ in range(28)),
}


def test_passages_of_any_alphabet(spark, make_docs):
    """Each passage stands between other words in two documents, a menu in thirty."""
    r, docs, of = random.Random(21), {}, {}
    for name, make in PROBES.items():
        passage, gap = make(r), "\n" if "\n" in make(r) else " "
        for n in range(30 if name == "a menu" else 2):
            of[len(docs)] = (name, n, passage)
            docs[len(docs)] = letters(r, 30) + gap + passage + gap + letters(r, 30)
    got = rows_of(remove_repeats(make_docs(docs)))
    for i, (name, n, passage) in of.items():
        gone = (len(docs[i]) - len(got[i])) / len(passage)
        assert gone == 0 if n == 0 else gone > 0.9, (name, n, gone)


def test_against_brute_force(spark, make_docs):
    """All windows of words: what goes stands in a document of smaller key, and no long passage stays twice."""
    import difflib

    r = random.Random(22)
    passages = [letters(r, r.randint(60, 140)) for _ in range(25)]
    docs = {}
    for i in range(120):
        parts = [letters(r, r.randint(5, 60))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), letters(r, r.randint(5, 60))]
        docs[i] = r.choice([" ", "\n", ". "]).join(parts)
    got = rows_of(remove_repeats(make_docs(docs)))
    windows = lambda t, n: {tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)}
    before: set = set()
    left = 0
    for i in sorted(docs):
        words, kept = docs[i].split(), got.get(i, "").split()
        blocks = difflib.SequenceMatcher(None, words, kept, autojunk=False).get_opcodes()
        for kind, a, b, _, _ in blocks:
            assert kind in ("equal", "delete")
            if kind == "delete":
                assert any(" ".join(words[a:b]) in " ".join(docs[j].split()) for j in range(i)), i
        left += bool(windows(got.get(i, ""), 50) & before)
        before |= windows(docs[i], 50)
    assert left == 0


def test_chunks_are_taken_by_compiled_code(spark, make_docs, corpus):
    """The generator is compiled, and what stands behind it gives the chunks of ``chunk_marks``."""
    import re

    from pyspark.sql import functions as F

    from quirelake.llm.linededup import marks_of

    rows = make_docs(corpus).filter("length(text) > 0").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), F.col("text").alias("body"))
    assert re.search(r"\*\(\d+\) Generate explode", marks_of(rows)._jdf.queryExecution().executedPlan().toString())
    want = rows.select("doc", "row", F.explode(chunk_marks(F.col("body"))).alias("m")).select("doc", "row", "m.*")
    assert sorted(marks_of(rows).collect()) == sorted(want.collect())


def test_lines_of_odd_texts(spark, make_docs):
    """Lines begin where the pattern of a beginning matches, and joined they give the text."""
    from pyspark.sql import functions as F

    from quirelake.llm.linededup import BREAK, _lines

    r = random.Random(23)
    odd = " \t\n\r.!?\u3002ab cdEF12\x00\x0b\x1f\x85\xa0\u00e9\u4e2d\ud7ff\ue000\U0001f600\U00010000"
    texts = ["".join(r.choice(odd) for _ in range(r.randint(1, 300))) for _ in range(300)] + [c * 40 for c in odd] + ["x" * 200_000, "a b" * 100_000, "\n" * 50_000]
    text, lines = F.col("text"), _lines(F.col("text"))
    same = make_docs(dict(enumerate(texts))).select((lines == F.split(text, f"(?s)(?={BREAK})", -1)).alias("s"), (F.array_join(lines, "") == text).alias("w"))
    assert [tuple(x) for x in same.distinct().collect()] == [(True, True)]

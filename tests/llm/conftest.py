import random

import pytest

#: documents with extra columns whose names the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, row long, key string, score double"
WORDS = [a + b for a in "ka lo mi nu pe ra so tu".split() for b in "ban der fin gol hak jet lum nor pix".split()]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def text_of(r: random.Random, lines: int = 5) -> str:
    return "\n".join(" ".join(sentence(r, r.randint(4, 12)) for _ in range(r.randint(1, 4))) for _ in range(lines))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts: dict[int | None, str | None] | list[tuple]):
        pairs = list(texts.items()) if isinstance(texts, dict) else texts
        return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1, "x", 2, "k", 0.5) for d, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts, with nulls, blanks, copies, near copies and one long text."""
    r = random.Random(7)
    out: list[tuple] = [(i, text_of(r, r.randint(1, 6))) for i in range(60)]
    out += [(100 + i, out[i][1]) for i in range(6)]  # exact copies
    for i in range(8):  # near copies: some words changed
        words = out[10 + i][1].split(" ")
        for _ in range(1 + i):
            words[r.randrange(len(words))] = "zzz"
        out.append((200 + i, " ".join(words)))
    out += [(300, None), (301, ""), (302, "  \n\t "), (303, "One"), (304, "one"), (305, text_of(r, 400)), (306, out[3][1].upper()), (5, out[5][1])]
    return out

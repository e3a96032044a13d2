import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quirelake.llm import merkle
from quirelake.llm.merkle import MountainRange, Shape, manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level, fanout=8):
    """All levels over a list of digests, and for each leaf its siblings as (left, right) by level."""
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    paths = []
    for i in range(len(level)):
        path = []
        for nodes in levels[:-1]:
            start = i - i % fanout
            path.append((nodes[start:i], nodes[i + 1 : start + fanout]))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def brute(rows, changed, fanout=8):
    """Per row (doc_id, leaf, subroot, root, proof, folded): rows are tuples of FIELDS."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        made[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: climb([leaf(r) for r in made[g]], fanout) for g in order}
    root, upper = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, above in zip(order, upper):
        for r, path in zip(made[g], trees[g][1]):
            cur = leaf(changed(r))
            for left, right in path + above:
                cur = H(*left, cur, *right)
            out.append((r[0], leaf(r), trees[g][0], root, H(*[d for left, right in path + above for d in left + right]), cur))
    return sorted(out, key=str)


def tampered(r):
    return (*r[:4], r[4].lower() if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4])


def run(spark, rows, parts=3, fanout=8):
    docs = spark.createDataFrame([(*r, "g", "k", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, key string, part int, idx long").repartition(parts)
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, fields=FIELDS, group="lang", key="doc_id", fanout=fanout, changed={"text": F.lower("text")}, when=third)


def plain(df):
    return sorted(((r.key, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in df.collect()), key=str)


@pytest.fixture
def small_parts(monkeypatch):
    """Many partitions, so that groups begin, end and go on anywhere."""
    monkeypatch.setattr(merkle, "PART_ROWS", 60)


@pytest.mark.parametrize(("rows", "fanout"), [(1, 8), (7, 8), (8, 8), (9, 8), (65, 8), (700, 8), (700, 3), (513, 2)])
def test_equals_brute_force(spark, small_parts, rows, fanout):
    r = random.Random(rows)
    langs = ["en"] * 6 + ["de", "fr", None, "Zü", "en-GB"]
    docs = [(i * 3, r.choice(["s", None, ""]), r.choice(langs), r.choice([None, 5]), r.choice([None, "", "Text é " * r.randint(1, 9), "low"])) for i in range(rows)]
    docs += docs[:3] + [(None, None, None, None, None)] * 2 + [(3, "other", "en", 1, "Same Key")]
    got = run(spark, docs, fanout=fanout)
    assert plain(got) == brute(docs, tampered, fanout)
    assert all(x.verified == (x.folded_root == x.root) for x in got.collect())


def test_one_group_and_one_row_hold_most(spark, small_parts):
    docs = [(i, "s", "en", 1, f"T{i}") for i in range(300)] + [(7, "s", "en", 1, "Copy")] * 200 + [(9, "s", "de", 1, "x")]
    assert plain(run(spark, docs, parts=5)) == brute(docs, tampered)


def test_many_groups(spark, small_parts):
    docs = [(i, "s", f"l{i % 230}", 1, f"T{i}") for i in range(400)]
    assert plain(run(spark, docs)) == brute(docs, tampered)


def test_empty_and_long(spark):
    assert run(spark, []).count() == 0
    docs = [(1, "s", "en", 1, "Long " * 300_000), (2, "s", "en", 1, "b")]
    assert plain(run(spark, docs)) == brute(docs, tampered)


def test_unaligned_ranges_leave_peaks():
    """What two tasks emit for 3..10 and 10..20 of 20 leaves."""
    shape, out = Shape.of(20, 4), []
    assert shape.sizes == (20, 5, 2, 1)
    for a, b in ((3, 10), (10, 20)):
        out.append([])
        peaks = MountainRange(shape, lambda kind, level, idx, digest: out[-1].append((kind, level, idx)))
        for i in range(a, b):
            peaks.add(i, str(i))
        peaks.close()
    assert out[0] == [("peak", 0, 3), ("node", 1, 1), ("peak", 0, 8), ("peak", 0, 9), ("peak", 1, 1)]
    assert out[1] == [("peak", 0, 10), ("peak", 0, 11), ("node", 1, 3), ("peak", 1, 3), ("node", 1, 4), ("node", 2, 1), ("peak", 2, 1)]

"""The stages of the pipeline, each against what its rule says of a small table."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.conftest import sentence, text_of  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(21)
    path = tmp_path_factory.mktemp("sf")
    texts = {i: text_of(r, 4) for i in range(40)}
    texts |= {100 + i: texts[i] for i in range(4)}  # copies
    passage = " ".join(sentence(r, 12) for _ in range(6))
    for i in (10, 11, 12):
        texts[i] += "\n" + passage + "\n" + text_of(r, 3)
    item = " ".join(sentence(r, 11) for _ in range(2))
    texts[20] += "\n" + item
    toxic = [30, 31, 32, 33, 34, 35, 36, 37]
    for i in toxic:
        texts[i] = " ".join(["grumbax snarvil"] * 3) + " " + texts[i] + " grumbax snarvil"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(200, None, "en", "s", None), (201, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), texts, passage, item


def test_stages_in_turn(spark, sf_dir):
    path, texts, passage, item = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]

    lines = stages["line dedup"](spark, docs, path)
    assert lines.columns == docs.columns
    got = {r.doc_id: r for r in lines.collect()}
    assert passage in got[10].text and passage not in got[11].text and passage not in got[12].text
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text) and not {100, 101, 102, 103} & set(got)
    assert got[200].text is None and got[201].text == "" and got[20].text == texts[20]

    near = stages["MinHash near-dedup"](spark, docs, path)
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} == (set(texts) - {100, 101, 102, 103}) | {200, 201}

    clean = stages["benchmark decontamination"](spark, docs, path)
    assert {r.doc_id for r in clean.collect()} == (set(texts) - {20}) | {200, 201} and clean.columns == docs.columns

    kept = stages["toxicity"](spark, docs, path)
    assert kept.columns == docs.columns and {200, 201} <= {r.doc_id for r in kept.collect()} | {200, 201}


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    path, texts, _, item = sf_dir
    rows = corpus_pipeline.run(spark, path).collect()
    found = {r.doc_id for r in rows}
    assert not found & {20, 100, 101, 102, 103} and len(found) >= 25
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096

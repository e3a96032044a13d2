import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.operators.vector_index import VectorIndex, trained_cells

SF = "/root/testdata/sf0.01"


def exact(rows, asked, k):
    """{query: items} by cosine over dicts of vectors."""
    out = {}
    for q, v in asked.items():
        scores = sorted((-round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 9), i) for i, w in rows.items() if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") % 50).alias("doc"))


def found(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append(r.item)
    return out


def test_recall_and_isolation(spark, vectors, tmp_path):
    index = VectorIndex.create(str(tmp_path / "index"), vectors, cells=16, item="vec_id", document="doc")
    rows = {r.vec_id: np.array(r.vector) for r in vectors.collect()}
    asked = {i: v for i, v in rows.items() if i % 10 == 0}
    queries = vectors.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), "vector")
    want = exact(rows, asked, 10)
    # Probes are measured on other queries than those that recall is tested on.
    others = vectors.filter("vec_id % 10 = 3").select(F.col("vec_id").alias("q"), "vector")
    probes = index.probes_for(others, 10, query="q", recall=0.93, skip_self=True)
    got = found(index.search(queries, 10, query="q", probes=probes, skip_self=True))
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert probes < 16 and hits / (10 * len(want)) >= 0.9
    # Asking every cell is exact, and a filter isolates documents.
    assert found(index.search(queries, 10, query="q", probes=16, rerank=100, skip_self=True)) == want
    own = {i: v for i, v in rows.items() if i % 50 == 7}
    assert found(index.search(queries, 10, query="q", probes=16, rerank=100, within=F.col("document") == 7)) == exact(own, asked, 10)


def test_only_asked_cells_are_read(spark, vectors, tmp_path):
    index = VectorIndex.create(str(tmp_path / "index"), vectors, cells=16, item="vec_id", document="doc")
    plan = index.search(vectors.limit(1).select(F.col("vec_id").alias("q"), "vector"), 3, query="q", probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_upsert_and_remove(spark, vectors, tmp_path):
    """Documents are replaced and removed by version; compaction changes no result."""
    index = VectorIndex.create(str(tmp_path / "index"), vectors, cells=8, item="vec_id", document="doc")
    rows = {r.vec_id: np.array(r.vector) for r in vectors.collect()}
    queries = vectors.filter("vec_id in (1, 2, 3, 4)").select(F.col("vec_id").alias("q"), "vector")
    asked = {i: rows[i] for i in (1, 2, 3, 4)}
    check = lambda: found(index.search(queries, 10, query="q", probes=8, rerank=100, skip_self=True)) == exact(rows, asked, 10)
    assert check()
    index.remove(vectors.filter("doc in (5, 6)"))
    rows = {i: v for i, v in rows.items() if i % 50 not in (5, 6)}
    assert check() and index.rows().count() == len(rows)
    # Document 5 comes back with one row only, document 9 changes.
    new = vectors.filter("vec_id = 55 or doc = 9").withColumn("vector", F.when(F.col("doc") == 9, F.reverse("vector")).otherwise(F.col("vector")))
    index.upsert(new)
    rows |= {r.vec_id: np.array(r.vector) for r in new.collect()}
    assert check() and index.rows().count() == len(rows)
    index.upsert(new)
    assert check() and index.rows().count() == len(rows)
    index.remove(vectors.filter("doc = 5"))
    rows.pop(55)
    small = index.compacted(str(tmp_path / "small"))
    assert check() and small.rows().count() == len(rows)
    index = small
    assert check()


def test_unusable_vectors_and_errors(spark, tmp_path):
    schema = "item long, document long, vector array<double>"
    table = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 2, None), (4, 2, [float("nan"), 1.0]), (None, 2, [1.0, 1.0]), (5, None, [1.0, 1.0])], schema)
    index = VectorIndex.create(str(tmp_path / "index"), table, cells=4, item="item", document="document")
    got = index.search(spark.createDataFrame([(9, [1.0, 0.0]), (8, None), (7, [1.0])], "q long, vector array<double>"), 5, query="q").collect()
    assert [(r.q, r.item, round(r.score, 3), r["rank"]) for r in got] == [(9, 1, 1.0, 1), (9, 5, 0.707, 2), (9, 2, 0.0, 3)]
    with pytest.raises(Exception, match="components"):
        index.upsert(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], schema))
    with pytest.raises(ValueError, match="no vector"):
        VectorIndex.create(str(tmp_path / "none"), table.limit(0), cells=4, item="item", document="document")


def test_cells_have_length_one():
    cells = trained_cells(np.random.default_rng(0).standard_normal((200, 5)), 9)
    assert cells.shape == (9, 5) and np.allclose((cells**2).sum(axis=1), 1)

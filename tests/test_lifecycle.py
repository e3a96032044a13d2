import pytest
from pyspark.sql import functions as F

from quirelake.operators import lifecycle as L


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_vectors_join_one_to_one_or_fail(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, doc_id int")
    vectors = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "chunk_id string, v double")
    assert rows(L.joined_vectors(chunks, vectors)) == [("a", 1, 0.1), ("b", 1, 0.2)]
    for wrong in (vectors.filter("v < 0.2"), vectors.union(vectors), vectors.union(spark.createDataFrame([("c", 0.3)], vectors.schema))):
        with pytest.raises(Exception, match="chunks and vectors differ"):
            L.joined_vectors(chunks, wrong).collect()


def test_index_drops_documents_that_became_empty(spark):
    store = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "c", 1.0)], "doc_id int, chunk_id string, v double")
    again = spark.createDataFrame([(1,), (2,)], "doc_id int")
    new = spark.createDataFrame([(1, "a2", 2.0)], store.schema)
    after = L.indexed(store, new.select("doc_id", "chunk_id"), new.select("chunk_id", "v"), again)
    assert rows(after) == [(1, "a2", 2.0), (3, "c", 1.0)]
    assert rows(L.without_documents(store, again)) == [(3, "c", 1.0)]


def test_payload_round_trip(spark):
    df = spark.createDataFrame([(1, 'ação "x"\n', None, [1, 2])], "id long, t string, n int, p array<int>")
    kept = L.payload(df, df.columns).select("payload")
    assert L.restored(kept, "id long, t string, n int, p array<int>").collect() == df.collect()


def test_failed_query_keeps_siblings(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1,), (1,), (2,)], "query_id int")
    failures = spark.createDataFrame([(2, "timeout")], "query_id int, error string")
    assert rows(L.batch_outcome(asked, hits, failures)) == [(1, "found", 2, None), (2, "failed", 0, "timeout"), (3, "empty", 0, None)]


def test_updates_need_a_reference_of_the_same_case_and_amount(spark):
    references = spark.createDataFrame([("c1", "r1", 10), ("c2", "r2", 20)], "case string, reference_id string, amount int")
    columns = "case string, amount int, reference_id string, names_reference boolean, old_amount int, old_reference string, has_amount boolean"
    updates = [
        ("c1", 10, "r1", True, None, None, True),
        ("c1", 11, "r1", True, None, None, True),  # another amount
        ("c1", 20, "r2", True, None, None, True),  # reference of another case
        ("c1", 12, None, False, 10, "r1", True),  # a new amount clears the reference
        ("c1", None, None, False, 10, "r1", False),  # nothing changes
    ]
    found = L.guarded_updates(spark.createDataFrame(updates, columns), references, case="case").select("amount", "reference_id", "accepted")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(10, "r1", True), (11, None, False), (20, None, False), (12, None, True), (10, "r1", True)], key=repr)


def test_digest_follows_content_and_order(spark):
    def digest(units):
        df = spark.createDataFrame([("k", i, t) for i, t in units], "c string, i long, t string")
        return L.corpus_digests(df, corpus="c", order="i", content="t").first().corpus_sha256

    assert digest([(1, "a"), (2, "b")]) == digest([(2, "b"), (1, "a")])
    assert len({digest(u) for u in ([(1, "a"), (2, "b")], [(1, "b"), (2, "a")], [(1, "a")], [(1, "a"), (9000, "b")], [(1, None)])}) == 5


@pytest.mark.parametrize("body, want", [("curto", "curto"), ("a" * 300 + ". " + "b" * 600, "a" * 300 + "...."), ("a. " + "b" * 900, "a. " + "b" * 694 + "..."), ("", "")])
def test_display_summary(spark, body, want):
    df = spark.createDataFrame([(None, "Art. 5º-A. " + body)], "r string, t string")
    assert df.select(L.display_summary(F.col("r"), F.col("t"))).first()[0] == want


def test_unit_of_and_first_text(spark):
    df = spark.createDataFrame([("x:legal:art-6-inciso-2:part-3", " ", "b ")], "c string, a string, b string").select(L.unit_of(F.col("c")), L.unit_of(F.lit("doc:1")), L.first_text(F.col("a"), F.col("b")))
    assert tuple(df.first()) == ("art-6-inciso-2", None, "b")

"""Registered queries over persistent structures: the vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.vector_index import VectorIndex
from ..sources.staging import shared_folder
from .queries import register, table

CELLS = 16


def _index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame, DataFrame]:
    """A new index over all embeddings (documents are the ids modulo 50), the vectors, and the queries."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") % 50).alias("doc"))
    path = f"{shared_folder(spark)}/quirelake/index-{uuid.uuid4().hex}"
    index = VectorIndex.create(path, vectors, cells=CELLS, item="vec_id", document="doc")
    return index, vectors, vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")


@register("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND d.vec_id % 50 NOT IN (3, 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, round(min(score), 3) AS tenth, round(max(score), 3) AS first, count(*) AS hits FROM r WHERE rank <= 10 GROUP BY query_id
""")
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells asked, after documents 3 and 4 were removed and 5 was written twice: the exact scores."""
    index, vectors, asked = _index(spark, sf_dir)
    index.remove(vectors.filter("doc in (3, 4)"))
    index.upsert(vectors.filter("doc = 5"))
    found = index.search(asked, 10, query="query_id", probes=CELLS, rerank=1 << 20, skip_self=True)
    return found.groupBy("query_id").agg(F.round(F.min("score"), 3).alias("tenth"), F.round(F.max("score"), 3).alias("first"), F.count("*").alias("hits"))


@register("SELECT count(*) AS queries, true AS nine_in_ten FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 against exact search, with the probes that a sample of other vectors asks for."""
    index, vectors, asked = _index(spark, sf_dir)
    others = vectors.filter("vec_id % 100 = 50").select(F.col("vec_id").alias("query_id"), "vector")
    probes = index.probes_for(others, 10, query="query_id", recall=0.96, skip_self=True)
    near = index.search(asked, 10, query="query_id", probes=probes, skip_self=True).select("query_id", F.col("item").alias("vec_id"), F.lit(1).alias("hit"))
    exact = retrieval.dense(vectors, asked, 10, item="vec_id", query="query_id", skip_self=True)
    hits = exact.join(near, ["query_id", "vec_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("nine_in_ten"))

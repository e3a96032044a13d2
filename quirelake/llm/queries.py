"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spread import spread
from .oracles import lloyd_sql, merkle_sql

TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Clusters, rounds, components and seed of the embedding clustering.
LLOYD = {"clusters": 8, "rounds": 10, "width": 64, "seed": "3:"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table over all cores, also where it comes in one small file."""
    return spread(_table(spark, sf_dir, name))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key is the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding as S

    rows = S.balanced_shards(_table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", F.col(S.SIZE).alias("size"), F.col(S.CRC).alias("text_crc32"), F.lit("bytes").alias("law"), F.col(S.SHARD).alias("shard"), F.col(S.SLOT).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    found = decontaminate(_spread(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import remove_repeats

    return remove_repeats(_spread(spark, sf_dir, "documents"), length="n_chars")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    fold = fold_of("doc_id", 7)
    return score(_spread(spark, sf_dir, "documents"), fold != 2, fold == 5)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    found = near_duplicates(_spread(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, scored

    docs = _spread(spark, sf_dir, "documents")
    network = fit(docs, _table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2)
    return scored(docs, network).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors, 10)


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extract

    return extract(_spread(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, listed, scan

    found = scan(_spread(spark, sf_dir, "documents"))

    def of_kind(n: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == n)).cast("long")

    counts = [of_kind(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "random")).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_spread(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import lloyd, with_inertia

    rows, found = lloyd(_table(spark, sf_dir, "embeddings"), **LLOYD)
    return with_inertia(rows, found).withColumnRenamed("id", "vec_id")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify

    docs, fold = _spread(spark, sf_dir, "documents"), fold_of("doc_id", 4)
    found = identify(docs, fit(docs, fold != 2))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = _spread(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest(docs, fields=["doc_id", "source", "lang", "n_chars", "text"], group="lang", key="doc_id", changed={"text": lower}, when=third)
    return rows.withColumnRenamed("key", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op7_near_duplicates": op7_near_duplicates,
    "op5_toxicity": op5_toxicity,
    "op6_top_k": op6_top_k,
    "op8_extraction": op8_extraction,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_clustering": op11_clustering,
    "op12_language": op12_language,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {
    "op11_clustering": lloyd_sql(LLOYD["clusters"], LLOYD["rounds"], LLOYD["width"], LLOYD["seed"]),
    "op13_merkle": merkle_sql(),
    "op6_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op7_near_duplicates": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op2_decontamination": r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
hits AS (
    SELECT p.doc_id, p.i, win.n, win.item_id
    FROM (SELECT doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS g FROM places, (SELECT DISTINCT n FROM win) s WHERE i + s.n - 1 <= len(w)) p
    JOIN win ON p.n = win.n AND p.g = win.g),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""",
}

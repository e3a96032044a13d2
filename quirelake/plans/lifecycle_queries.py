"""Registered queries of the index and case-file operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
from .queries import register, table

STORE_SQL = """
s AS (SELECT o_custkey AS doc_id, o_orderkey AS chunk_id, CAST(o_totalprice AS DOUBLE) AS v FROM orders),
again AS (SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 5 = 0),
n AS (SELECT doc_id, chunk_id, v + 1 AS v FROM s JOIN again USING (doc_id) WHERE chunk_id % 3 <> 0)"""


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    store = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").cast("double").alias("v"))
    return store, table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("doc_id"))


@register(f"WITH {STORE_SQL} SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM again) UNION ALL SELECT * FROM n")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, again = _store(spark, sf_dir)
    new = store.join(again, "doc_id").filter("chunk_id % 3 <> 0")
    return lifecycle.indexed(store, new.select("doc_id", "chunk_id"), new.select("chunk_id", (F.col("v") + 1).alias("v")), again)


@register(f"WITH {STORE_SQL} SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM again)")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.without_documents(*_store(spark, sf_dir))


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents")
def payload_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a payload take it (also its nulls), others the columns beside it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.upper("source").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.col("source").alias("s"), F.col("n_chars").cast("long").alias("n"))
    inner = docs.select("doc_id", F.col("s").alias("source"), F.col("n").alias("n_chars"), F.col("source").alias("o"))
    kept = lifecycle.payload(inner, ["doc_id", "source", "n_chars"]).select("doc_id", F.col("o").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.when(F.col("doc_id") % 3 != 0, F.col("payload")).alias("payload"))
    return lifecycle.restored(kept, "doc_id long, source string, n_chars long")


@register("""
SELECT c_custkey AS query_id, CASE WHEN c_custkey % 10 = 0 THEN 'failed' WHEN count(o_orderkey) > 0 THEN 'found' ELSE 'empty' END AS status,
       CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE count(o_orderkey) END AS hits, CASE WHEN c_custkey % 10 = 0 THEN 'timeout' END AS error
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def retrieve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey")
    return lifecycle.batch_outcome(asked, hits, asked.filter("query_id % 10 = 0").withColumn("error", F.lit("timeout")))


@register("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'doc:' || doc_id ELSE 'cdc:legal:art-' || doc_id % 50 || '-caput:part-' || doc_id % 3 END AS chunk_id,
                  CASE WHEN doc_id % 3 = 0 THEN '  ' WHEN doc_id % 5 = 0 THEN NULL ELSE ' ' || lang || ' ' END AS a, source AS b FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 50 < 10 THEN 'old-art-' || doc_id % 50 ELSE 'art-' || doc_id % 50 || '-caput' END END AS unit,
       coalesce(nullif(trim(a), ''), nullif(trim(b), '')) AS label FROM c
""")
def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    legal = F.concat(F.lit("cdc:legal:art-"), (F.col("doc_id") % 50).cast("string"), F.lit("-caput:part-"), (F.col("doc_id") % 3).cast("string"))
    docs = table(spark, sf_dir, "documents").withColumn("unit", lifecycle.unit_of(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("doc:"), key)).otherwise(legal)))
    spaced = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 5 != 0, F.concat(F.lit(" "), F.col("lang"), F.lit(" ")))
    aliases = spark.range(10).select(F.concat(F.lit("art-"), F.col("id").cast("string"), F.lit("-caput")).alias("old_id"), F.concat(F.lit("old-art-"), F.col("id").cast("string")).alias("new_id"))
    rows = docs.select("doc_id", "unit", lifecycle.first_text(spaced, F.col("source")).alias("label"))
    return lifecycle.with_current_ids(rows, aliases, key="unit").select("doc_id", "unit", "label")


@register("""
SELECT l_orderkey AS case_id, l_partkey % 12 AS page, CASE WHEN l_partkey % 12 <= 5 THEN 'file1' ELSE 'file2' END AS evidence,
       CASE WHEN l_partkey % 12 <= 5 THEN l_partkey % 12 ELSE l_partkey % 12 - 5 END AS local_page
FROM lineitem WHERE l_partkey % 12 BETWEEN 1 AND 9
""")
def retrieved_page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 12).alias("page"))
    spans = F.array(*[F.struct(F.lit(n).alias("evidence"), F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for n, a, b in (("file1", 1, 5), ("file2", 6, 9))])
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(spans).alias("s")).select("case_id", "s.*")
    return lifecycle.page_sources(pages, files, case="case_id")


MONEY_SQL = """
m AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(o_totalprice AS DECIMAL(12, 2)) AS amount, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k % 7, k) AS position FROM m),
r AS (SELECT c AS customer, k, amount, substr(sha256(c || ':' || k % 7 || ':' || amount || ':' || h), 1, 24) AS reference_id FROM p WHERE position <= 50)"""


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("customer"), key.alias("k"), (key % 7).alias("page"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.sha2(key.cast("string"), 256).alias("h"))
    return lifecycle.money_references(rows, document="customer", page="page", amount="amount", quote_sha256="h", order="k")


@register(f"WITH {MONEY_SQL} SELECT CAST(customer AS VARCHAR) AS customer, k, reference_id FROM r")
def money_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(spark, sf_dir).select("customer", "k", "reference_id")


@register(f"""
WITH {MONEY_SQL}
SELECT CAST(customer AS VARCHAR) AS customer, k, CASE WHEN k % 3 = 1 THEN amount + 1 ELSE amount END AS amount,
       CASE WHEN k % 3 = 0 THEN reference_id END AS reference_id, k % 3 <> 1 AS accepted FROM r
""")
def guarded_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right references, references of another amount, and new amounts without one, by k modulo 3."""
    money, n = _money(spark, sf_dir), F.col("k") % 3
    references = money.select(F.struct("customer", "k").alias("case"), "reference_id", F.col("amount").cast("decimal(13,2)").alias("amount"))
    wrong = F.col("amount").cast("decimal(13,2)") + F.when(n == 1, 1).otherwise(0).cast("decimal(2,0)")
    updates = money.select(F.struct("customer", "k").alias("case"), wrong.cast("decimal(13,2)").alias("amount"), F.when(n != 2, F.col("reference_id")).alias("reference_id"), (n != 2).alias("names_reference"), F.lit(None).cast("decimal(13,2)").alias("old_amount"), F.col("reference_id").alias("old_reference"), F.lit(True).alias("has_amount"))
    return lifecycle.guarded_updates(updates, references, case="case").select("case.customer", "case.k", "amount", "reference_id", "accepted")


@register("""
WITH u AS (SELECT source, doc_id, sha256(doc_id || ':' || coalesce(text, '')) AS h FROM documents WHERE source IS NOT NULL),
b AS (SELECT source, doc_id // 4096 AS b, sha256(string_agg(h, ',' ORDER BY doc_id, h)) AS h, count(*) AS k FROM u GROUP BY ALL)
SELECT source, sha256(string_agg(h, ',' ORDER BY b)) AS corpus_sha256, CAST(sum(k) AS BIGINT) AS units FROM b GROUP BY source
""")
def corpus_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.corpus_digests(table(spark, sf_dir, "documents").filter("source is not null"), corpus="source", order="doc_id", content="text")


@register("SELECT l_orderkey AS doc_id, count(*) AS chunks, count(DISTINCT l_returnflag) AS sections FROM lineitem GROUP BY l_orderkey")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.chunk_totals(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), doc="doc_id", section="l_returnflag")


@register("""
WITH t AS (SELECT doc_id, 'Art. ' || doc_id % 119 || 'º ' || coalesce(text, '') AS caput, coalesce(text, '') AS body FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '^\\s')),
h AS (SELECT *, body[1:700] AS head FROM t),
c AS (SELECT *, CASE WHEN contains(head, '. ') THEN length(head) - instr(reverse(head), ' .') - 1 ELSE -1 END AS stop FROM h)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'reviewed' WHEN length(body) <= 700 THEN body
       ELSE regexp_replace(CASE WHEN stop >= 200 THEN head[1:stop + 1] ELSE head[1:697] END, '\\s+$', '') || '...' END AS summary,
       'REFERÊNCIA LEGAL CDC-ART-' || doc_id % 119 || chr(10) || chr(10) || 'Citação: CDC, art. ' || doc_id % 119 || chr(10) || 'Hierarquia: ' ||
       CASE WHEN doc_id % 2 = 0 THEN 'T > C' WHEN doc_id % 3 = 0 THEN 'T' ELSE 'não informada' END || chr(10) || 'Status: ACTIVE' || chr(10) || chr(10) || body[1:20] AS page
FROM c
""")
def provision_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(r"text is null or not text rlike '^\\s'")
    body, n, key = F.coalesce("text", F.lit("")), (F.col("doc_id") % 119).cast("string"), F.col("doc_id")
    caput = F.concat(F.lit("Art. "), n, F.lit("º "), body)
    path = [F.when((key % 2 == 0) | (key % 3 == 0), "T"), F.when(key % 2 == 0, "C"), F.lit("")]
    page = lifecycle.provision_page(reference=F.concat(F.lit("cdc-art-"), n), citation=F.concat(F.lit("CDC, art. "), n), hierarchy=path, status=F.lit("active"), content=F.substring(body, 1, 20))
    return docs.select("doc_id", lifecycle.display_summary(F.when(key % 6 == 0, "reviewed"), caput).alias("summary"), page.alias("page"))


@register("""
WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS chunk_id, CAST(l_quantity AS DOUBLE) AS rerank_score,
                  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS INTEGER) AS rank FROM lineitem)
SELECT * FROM r WHERE rank <= 3
""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_quantity").cast("double").alias("q"))
    return lifecycle.reranked(rows, F.col("q"), 3).drop("q")


@register("SELECT o_orderkey AS run, CAST(o_orderdate AS VARCHAR) AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").cast("string").alias("at"), F.array("o_custkey").alias("traces"))
    return lifecycle.newest_runs(runs, 100, at="at", run="run", heavy=("traces",))


@register("""
WITH f AS (SELECT doc_id, ['none', 'low', 'medium', 'high', 'critical'][CAST(doc_id % 5 AS INTEGER) + 1] AS severity, doc_id % 3 AS page, coalesce(source, '') AS category, lang AS quote FROM documents)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 50 ORDER BY list_position(['none', 'low', 'medium', 'high', 'critical'], severity) DESC, page, category, quote NULLS FIRST, doc_id) AS INTEGER) AS position FROM f
""")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    levels = F.array(*map(F.lit, lifecycle.SEVERITIES))
    found = table(spark, sf_dir, "documents").select("doc_id", F.element_at(levels, (F.col("doc_id") % 5).cast("int") + 1).alias("severity"), (F.col("doc_id") % 3).alias("page"), F.coalesce("source", F.lit("")).alias("category"), F.col("lang").alias("quote"))
    w = Window.partitionBy(F.floor(F.col("doc_id") / 50)).orderBy(*lifecycle.finding_order(), "doc_id")
    return found.select("doc_id", F.row_number().over(w).alias("position"))


@register("""
SELECT o_orderkey AS run, CAST(l_linenumber AS INTEGER) AS query_index, 'facts' AS agent, CASE WHEN l_linenumber % 3 <> 0 THEN i END AS position, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey + i END AS chunk_id
FROM orders JOIN lineitem ON l_orderkey = o_orderkey, (SELECT unnest([0, 1]) AS i) WHERE l_linenumber % 3 <> 0 OR i = 0
""")
def retrieval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third query found nothing and stays as a row of nulls."""
    results = F.when(F.col("l_linenumber") % 3 != 0, F.array(*[F.struct((F.col("l_partkey") + i).alias("chunk_id")) for i in (0, 1)]))
    query = F.struct(F.col("l_shipdate").cast("string").alias("created_at"), F.lit("facts").alias("agent"), F.col("l_linenumber").cast("int").alias("query_index"), results.alias("results"))
    traces = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.array_sort(F.collect_list(query)).alias("queries"))
    return lifecycle.retrieval_rows(traces, run="run").select("run", "query_index", "agent", "position", F.col("result.chunk_id").alias("chunk_id"))


@register("""
SELECT o_orderkey AS case_id, 'direct_loss' AS kind, CAST(o_totalprice AS DOUBLE) AS amount, CASE WHEN o_orderkey % 4 = 0 THEN 'statement' ELSE 'evidence' END AS origin,
       CASE WHEN o_orderkey % 4 <> 0 THEN 'file' || i END AS evidence, CASE WHEN o_orderkey % 4 <> 0 THEN i + 1 END AS page
FROM orders, (SELECT unnest([1, 2]) AS i) WHERE o_orderkey % 4 <> 0 OR i = 1
""")
def money_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.when(F.col("o_orderkey") % 4 != 0, F.array(*[F.struct(F.lit(f"file{i}").alias("evidence"), F.lit(i + 1).alias("page")) for i in (1, 2)]))
    part = F.struct(F.lit("direct_loss").alias("kind"), F.col("o_totalprice").cast("double").alias("amount"), sources.alias("sources"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.array(part).alias("components"))
    return lifecycle.money_sources(rows, case="case_id")


@register("""
WITH l AS (SELECT l_orderkey AS query_id, l_linenumber % 2 AS g, l_partkey % 5 AS item, l_returnflag = 'R' AS neg FROM lineitem),
a AS (SELECT query_id, list_sort(list(DISTINCT item) FILTER (NOT neg)) AS rel, list(DISTINCT item) FILTER (neg) AS bad, count(DISTINCT g) FILTER (NOT neg) AS groups FROM l GROUP BY query_id)
SELECT query_id, coalesce(array_to_string(rel, ','), '') AS relevant, coalesce(array_to_string(list_filter(rel, lambda x: list_contains(bad, x)), ','), '') AS contradictory, groups FROM a
""")
def relevant_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") % 2).alias("group"), (F.col("l_partkey") % 5).cast("string").alias("item"), (F.col("l_returnflag") == "R").alias("negative"))
    found = lifecycle.relevant_sets(labels, query="query_id")
    return found.select("query_id", F.concat_ws(",", "relevant").alias("relevant"), F.concat_ws(",", "contradictory").alias("contradictory"), "groups")

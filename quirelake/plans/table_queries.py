"""Registered queries of evaluation, cases, logs and statutes, on rows that the given tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money, text
from ..operators import consumer, metrics, records, security, statutes
from .queries import register, table

# Line items are the hits of their order, which is a case; orders give judgments and hard negatives.
RANKED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
STATUS = "CASE WHEN l_quantity > 45 THEN NULL WHEN l_returnflag = 'R' THEN 'revoked' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'vetoed' ELSE 'active' END"
HITS_SQL = f"h AS (SELECT l_orderkey AS case_id, CAST({RANKED} AS INTEGER) AS rank, 'cdc-' || l_partkey % 5 || '-u' || l_suppkey % 2 AS unit_id, 'cdc-' || l_partkey % 5 AS article_id, {STATUS} AS status FROM lineitem)"
JUDGED_SQL = """j AS (SELECT o_orderkey AS case_id, 'cdc-' || o_custkey % 5 AS article_id, NULL AS unit_id, 3 AS grade, 1 AS j FROM orders
    UNION ALL SELECT o_orderkey, 'cdc-' || (o_custkey + 1) % 5, 'cdc-' || (o_custkey + 1) % 5 || '-u0', 2, 2 FROM orders
    UNION ALL SELECT o_orderkey, 'cdc-' || (o_custkey + 2) % 5, NULL, 1, 3 FROM orders WHERE o_custkey % 2 = 0)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    article = F.concat(F.lit("cdc-"), (F.col("l_partkey") % 5).cast("string"))
    unit = F.concat(article, F.lit("-u"), (F.col("l_suppkey") % 2).cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), rank.alias("rank"), unit.alias("unit_id"), article.alias("article_id"), F.expr(STATUS).alias("status"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    article = lambda n: F.concat(F.lit("cdc-"), ((F.col("o_custkey") + n) % 5).cast("string"))
    one = lambda n, unit, grade: F.struct(article(n).alias("article_id"), unit.cast("string").alias("unit_id"), F.lit(grade).alias("grade"))
    third = F.when(F.col("o_custkey") % 2 == 0, one(2, F.lit(None), 1))
    rows = F.array_compact(F.array(one(0, F.lit(None), 3), one(1, F.concat(article(1), F.lit("-u0")), 2), third))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(rows).alias("j")).select("case_id", "j.*")


@register(f"""
WITH {HITS_SQL}, {JUDGED_SQL},
u AS (SELECT case_id, unit_id, article_id, min(rank) AS rank FROM h WHERE rank <= 5 GROUP BY ALL),
m AS (SELECT j.case_id, j.j, j.grade, min(u.rank) AS rank FROM u JOIN j ON u.case_id = j.case_id AND (u.unit_id = j.unit_id OR (j.unit_id IS NULL AND u.article_id = j.article_id)) GROUP BY ALL),
g AS (SELECT case_id, rank, max(grade) AS grade, count(*) AS n FROM m GROUP BY ALL),
p AS (SELECT case_id, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, count(*) AS ranks, min(rank) AS first, sum(n) AS met FROM g GROUP BY case_id),
a AS (SELECT u.case_id, count(DISTINCT u.article_id) AS articles FROM u JOIN (SELECT DISTINCT case_id, article_id FROM j) w ON w.case_id = u.case_id AND w.article_id = u.article_id GROUP BY u.case_id),
i AS (SELECT case_id, sum(gain / log2(n + 1)) AS idcg FROM (SELECT case_id, 2 ** grade - 1 AS gain, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC) AS n FROM j) WHERE n <= 5 GROUP BY case_id),
w AS (SELECT case_id, count(*) AS wanted, count(DISTINCT article_id) AS wa FROM j GROUP BY case_id)
SELECT case_id, coalesce(met, 0) / wanted AS recall, coalesce(articles, 0) / wa AS article_recall, coalesce(1.0 / first, 0.0) AS mrr, round(coalesce(dcg, 0) / idcg, 9) AS ndcg, coalesce(ranks, 0) / 5.0 AS subdivision_precision, coalesce(articles, 0) / 5.0 AS article_precision
FROM w LEFT JOIN p USING (case_id) LEFT JOIN a USING (case_id) LEFT JOIN i USING (case_id)
""")
def graded_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.graded_metrics(_hits(spark, sf_dir), _judged(spark, sf_dir), 5)


@register(f"""
WITH {HITS_SQL}, n AS (SELECT o_orderkey AS case_id, 'cdc-' || o_custkey % 5 || CASE WHEN o_orderkey % 3 = 0 THEN '-u1' ELSE '' END AS negative_id FROM orders WHERE o_orderkey % 2 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id, unit_id ORDER BY rank) AS k FROM h WHERE rank <= 5),
f AS (SELECT o.*, EXISTS (SELECT 1 FROM n WHERE n.case_id = o.case_id AND (o.unit_id = negative_id OR o.article_id = negative_id OR starts_with(o.unit_id, negative_id || '-'))) AS bad FROM o WHERE k = 1),
s AS (SELECT case_id, avg(CAST(bad AS DOUBLE)) AS b, avg(CAST(coalesce(status IN ('revoked', 'vetoed'), FALSE) AS DOUBLE)) AS i, avg(CAST(status IS NULL AS DOUBLE)) AS k FROM f GROUP BY case_id)
SELECT o_orderkey AS case_id, coalesce(b, 0) AS hard_negative_rate, coalesce(i, 0) AS inactive_rate, coalesce(k, 0) AS unknown_status_rate FROM orders LEFT JOIN s ON case_id = o_orderkey
""")
def safety_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey")
    negative = F.concat(F.lit("cdc-"), (F.col("o_custkey") % 5).cast("string"), F.when(F.col("case_id") % 3 == 0, "-u1").otherwise(""))
    return metrics.safety_rates(_hits(spark, sf_dir), orders.filter("case_id % 2 = 0").select("case_id", negative.alias("negative_id")), orders, 5)


@register("""
SELECT o_orderkey AS case_id, CAST(count(l_orderkey) = 0 AS DOUBLE) AS abstention FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 20 WHERE o_custkey % 3 = 0 GROUP BY o_orderkey
""")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 3 == 0).alias("no_applicable_ground"))
    hits = table(spark, sf_dir, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("case_id"))
    return metrics.abstention(cases, hits)


SEVERITY = "CASE WHEN event_id % 97 = 0 THEN 'critical' WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'high' WHEN event_type = 'view' AND user_id % 3 = 0 THEN 'medium' WHEN event_type = 'click' THEN 'low' END"


@register(f"""
WITH f AS (SELECT user_id AS doc_id, {SEVERITY} AS severity FROM events WHERE {SEVERITY} IS NOT NULL), d AS (SELECT c_custkey AS doc_id, c_custkey % 9 = 4 AS scan_failed FROM customer),
p AS (SELECT doc_id, count(*) AS findings, max(list_position(['none', 'low', 'medium', 'high', 'critical'], severity)) AS level FROM f GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(findings, 0) AS findings, ['none', 'low', 'medium', 'high', 'critical'][CASE WHEN scan_failed THEN 5 ELSE coalesce(level, 1) END] AS risk FROM d LEFT JOIN p USING (doc_id))
SELECT *, CASE risk WHEN 'critical' THEN 'block' WHEN 'high' THEN 'human_review' WHEN 'medium' THEN 'proceed_with_warning' ELSE 'proceed' END AS action FROM r
""")
def assessment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.expr(SEVERITY).alias("severity")).filter("severity IS NOT NULL")
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 9 == 4).alias("scan_failed"))
    return security.assessments(found, documents)


PLAIN_SQL = "trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g'))"


@register(f"""
WITH d AS (SELECT doc_id, {PLAIN_SQL} AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN nullif(trim(t[11:50]), '') END AS q1, CASE WHEN doc_id % 6 = 0 THEN nullif(trim(t[61:80]), '') END AS q2 FROM d),
a AS (SELECT *, CASE WHEN q1 IS NULL THEN t ELSE replace(t, q1, '{security.MASK}') END AS t1 FROM q)
SELECT doc_id, CASE WHEN q2 IS NULL THEN t1 ELSE replace(t1, q2, '{security.MASK}') END AS text FROM a
""")
def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer quote of a document goes first."""
    plain = F.trim(F.regexp_replace(text.unaccent(F.lower("text")), r"\s+", " "))
    pages = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", plain.alias("text"))
    quotes = F.array(F.when(F.col("doc_id") % 3 == 0, F.trim(F.substring("text", 11, 40))), F.when(F.col("doc_id") % 6 == 0, F.trim(F.substring("text", 61, 20))))
    found = pages.select("doc_id", F.explode(F.array_compact(quotes)).alias("quote")).filter("quote <> ''")
    return security.masked(pages, found)


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
RAW_SQL = f"""CASE l_linenumber % 4 WHEN 0 THEN {CENTS} // 100 || ',' || lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0') WHEN 1 THEN {CENTS} // 100 || '.' || lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0')
    WHEN 2 THEN {CENTS} // 100000 || '.' || lpad(CAST({CENTS} // 100 % 1000 AS VARCHAR), 3, '0') ELSE {CENTS} // 100000 || '.' || lpad(CAST({CENTS} // 100 % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0') END"""


@register(f"""
SELECT l_orderkey, l_linenumber, {RAW_SQL} AS raw, CAST(CASE WHEN l_linenumber % 4 = 2 THEN {CENTS} // 100 ELSE {CENTS} / 100.0 END AS DOUBLE) AS amount FROM lineitem
""")
def parse_brl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ways of writing an amount: cents behind a comma or a point, thousands behind a point, both."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    two, three = F.lpad((cents % 100).cast("string"), 2, "0"), F.lpad((F.floor(cents / 100) % 1000).cast("string"), 3, "0")
    whole, thousands = F.floor(cents / 100).cast("string"), F.floor(cents / 100_000).cast("string")
    kind = F.col("l_linenumber") % 4
    raw = F.when(kind == 0, F.concat(whole, F.lit(","), two)).when(kind == 1, F.concat(whole, F.lit("."), two)).when(kind == 2, F.concat(thousands, F.lit("."), three)).otherwise(F.concat(thousands, F.lit("."), three, F.lit(","), two))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), money.parse_brl(raw).cast("double").alias("amount"))


# Documents as complaints: one of a few openings before their text.
OPENINGS = ["Meu produto veio errado", "Meu vizinho faz barulho e não recebi herança", "Comprei um produto na loja", "Desisti da compra em sete dias e a loja negou", "Problema qualquer", "A entrega atrasada do produto"]
CATEGORIES = ["employment", "other", "other", "service_failure", None, "unknown"]
COMPLAINT_SQL = f"""c AS (SELECT doc_id AS case_id, {['employment', 'other', 'other', 'service_failure', '', 'unknown']}[doc_id % 6 + 1] AS category0, {OPENINGS}[doc_id % 6 + 1] || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '. ' || text END AS complaint, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Quero ' || text END AS wish FROM documents),
x AS (SELECT case_id, nullif(category0, '') AS category, trim(regexp_replace(coalesce(complaint, ''), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(wish, ''), '\\s+', ' ', 'g')) AS b FROM c)"""


def _complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % 6 + 1).cast("int"))
    complaint = F.concat(pick(OPENINGS), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit(". "), "text")))
    wish = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Quero "), "text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), pick(CATEGORIES).alias("category"), complaint.alias("complaint"), wish.alias("wish"))


def _signals(terms: list[str] | tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(a), '{x}')" for x in terms) + ")"


_KNOWN = ", ".join(f"'{c}'" for c in consumer.EXPANSIONS)


@register(f"""
WITH {COMPLAINT_SQL}
SELECT case_id, CASE WHEN category IN ('employment', 'labor', 'neighbor_dispute', 'no_consumer_relationship') THEN FALSE WHEN category IN ({_KNOWN}) AND category <> 'other' THEN TRUE ELSE {_signals(consumer.CONSUMER_SIGNALS)} OR NOT {_signals(consumer.OTHER_SIGNALS)} END AS in_scope,
 CASE {' '.join(f"WHEN {_signals(terms)} THEN '{name}'" for name, terms in consumer.REFINEMENTS)} WHEN category IN ({_KNOWN}) THEN category ELSE 'other' END AS category FROM x
""")
def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _complaints(spark, sf_dir)
    return rows.select("case_id", consumer.in_scope(F.col("category"), F.col("complaint")).alias("in_scope"), consumer.retrieval_category(F.col("category"), F.col("complaint")).alias("category"))


def _cut(t: str, most: int) -> str:
    return f"CASE WHEN length({t}) <= {most} THEN {t} WHEN contains({t}[1:{most}], ' ') THEN regexp_replace({t}[1:{most}], ' [^ ]*$', '') ELSE {t}[1:{most}] END"


_EXPANSION = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in consumer.EXPANSIONS.items()) + f" ELSE '{consumer.EXPANSIONS['other']}' END"


@register(f"""
WITH {COMPLAINT_SQL},
s AS (SELECT case_id, concat_ws('. ', nullif({_cut("a", 1050)}, ''), nullif({_cut("b", 500)}, '')) AS story, {_EXPANSION} AS e FROM x),
q AS (SELECT case_id, 1 AS n, 'Situação de consumo relatada: ' || story || '. Localizar dispositivos legais diretamente aplicáveis.' AS t FROM s UNION ALL SELECT case_id, 2, story || '. ' || {_cut("e", 320)} FROM s)
SELECT case_id, n, {_cut("trim(t)", 2000)} AS query FROM q
""")
def legal_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories beyond both budgets are cut at a blank."""
    rows = _complaints(spark, sf_dir)
    found = rows.select("case_id", F.posexplode(consumer.legal_queries(F.col("category"), F.col("complaint"), F.col("wish"))).alias("n", "query"))
    return found.select("case_id", (F.col("n") + 1).alias("n"), "query")


FACTS_SQL = "f AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS bank_name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS consumer_name, CASE WHEN doc_id % 5 <> 0 THEN 'fraud' END AS issue_category FROM documents)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(k.alias("case_id"), F.when(k % 3 != 0, F.col("source")).alias("bank_name"), F.when(k % 4 == 0, "").otherwise(F.col("lang")).alias("consumer_name"), F.when(k % 5 != 0, "fraud").alias("issue_category"))


_MISSING = "[x for x in [" + ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END" for c in ("bank_name", "consumer_name", "issue_category")) + "] if x IS NOT NULL]"


@register(f"WITH {FACTS_SQL} SELECT case_id, array_to_string({_MISSING}, ',') AS missing FROM f")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("case_id", F.concat_ws(",", consumer.missing(["bank_name", "consumer_name", "issue_category"])).alias("missing"))


@register(f"""
WITH {FACTS_SQL}, m AS (SELECT *, {_MISSING} AS m FROM f)
SELECT case_id, CASE WHEN len(m) > 0 THEN CASE m[1] {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in consumer.QUESTIONS.items())} END WHEN case_id % 2 = 0 THEN '{consumer.ASK_EVIDENCE}' ELSE '{consumer.ASK_CONFIRMATION}' END AS question,
  CASE WHEN issue_category = 'fraud' THEN '{'; '.join(consumer.DOCUMENTS['fraud'])}' ELSE '{'; '.join(consumer.DOCUMENTS['other'])}' END AS documents FROM m
""")
def next_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    lacking = consumer.missing(["bank_name", "consumer_name", "issue_category"])
    return _facts(spark, sf_dir).select("case_id", consumer.next_question(lacking, F.col("case_id") % 2 != 0).alias("question"), F.array_join(consumer.recommended_documents(F.col("issue_category")), "; ").alias("documents"))


LOG_SQL = """l AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"run_id": "' || event_id || '", "succ' WHEN event_id % 5 = 0 THEN '{"success": true}' ELSE '{"run_id": "' || event_id || '", "success": ' || (event_type <> 'error') || ', "outcome": "' || event_type || '"}' END AS value FROM events)"""
LOG_SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("outcome", T.StringType())])


def log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a log; some are cut off, some lack a field."""
    k = F.col("event_id")
    whole = F.format_string('{"run_id": "%d", "success": %s, "outcome": "%s"}', k, (F.col("event_type") != "error").cast("string"), F.col("event_type"))
    value = F.when(k % 7 == 0, F.format_string('{"run_id": "%d", "succ', k)).when(k % 5 == 0, '{"success": true}').otherwise(whole)
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


@register(f"WITH {LOG_SQL} SELECT json_extract_string(value, '$.run_id') AS run_id, CAST(json_extract(value, '$.success') AS BOOLEAN) AS success, json_extract_string(value, '$.outcome') AS outcome FROM (SELECT * FROM l WHERE json_valid(value)) WHERE json_extract_string(value, '$.run_id') IS NOT NULL")
def corrupt_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parsed_log(log_values(spark, sf_dir), LOG_SCHEMA, ["run_id", "success"])[0]


@register(f"""
WITH s AS (SELECT l_orderkey AS job_id, CAST({RANKED} AS INTEGER) AS stage_no, CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'failed' WHEN l_linestatus = 'F' THEN 'done' WHEN l_tax < 0.02 THEN 'skipped' END AS c FROM lineitem)
SELECT job_id, stage_no, coalesce(c, CASE WHEN stage_no = min(stage_no) FILTER (c IS NULL) OVER (PARTITION BY job_id) THEN 'running' ELSE 'pending' END) AS status FROM s
""")
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), rank.alias("stage_no"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("failed"), (F.col("l_linestatus") == "F").alias("done"), (F.col("l_tax") < 0.02).alias("skipped"))
    return records.stage_status(rows).select("job_id", "stage_no", "status")


# Customers as laws, their orders as articles, the line items as units in a fixed cycle.
PLACE = "DOS PEDIDOS E DAS ENTREGAS DE TODOS OS CLIENTES DO CENTRO E DAS SUAS FILIAIS EM QUALQUER PARTE DO PAÍS"
LAW_SQL = f"""
o AS (SELECT 'law-' || o_custkey AS law_id, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders),
i AS (SELECT l_orderkey, {RANKED} AS k, ({RANKED} - 1) % 7 AS m, 'palavra ' || l_partkey || repeat(' mais', CAST(l_quantity AS INTEGER)) AS w FROM lineitem),
u AS (
  SELECT law_id, o_custkey, a, '' AS s, 0 AS unit_no, 'caput' AS name, 'caput' AS kind, 'active' AS status, 'Art. ' || a || 'º Pedido ' || o_orderkey || '.' AS text FROM o
  UNION ALL SELECT law_id, o_custkey, a, '-a', 0, 'caput', 'caput', 'revoked', 'Art. ' || a || '-A. Artigo com letra (Revogado)' FROM o WHERE o_orderkey % 3 = 0
  UNION ALL SELECT law_id, o_custkey, a, '', k,
    CASE m WHEN 0 THEN 'paragrafo-' || k WHEN 1 THEN 'paragrafo-' || (k - 1) || '-inciso-i' WHEN 2 THEN 'paragrafo-' || (k - 2) || '-inciso-i-alinea-a' WHEN 3 THEN 'paragrafo-' || (k - 3) || '-inciso-ii'
      WHEN 4 THEN 'pena-' || lpad(CAST((k - 1) // 7 + 1 AS VARCHAR), 3, '0') WHEN 5 THEN 'nota-' || lpad(CAST((k - 1) // 7 + 1 AS VARCHAR), 3, '0') ELSE 'normativo-' || lpad(CAST((k - 1) // 7 + 1 AS VARCHAR), 3, '0') END,
    ['paragraph', 'inciso', 'alinea', 'inciso', 'penalty', 'note', 'normative_other'][m + 1], CASE m WHEN 3 THEN 'vetoed' WHEN 5 THEN 'revoked' ELSE 'active' END,
    CASE m WHEN 0 THEN '§ ' || k || 'º ' || w WHEN 1 THEN 'I - ' || w WHEN 2 THEN 'a) ' || w WHEN 3 THEN 'II - (VETADO) ' || w WHEN 4 THEN 'Pena - ' || w WHEN 5 THEN '(Revogado pela Lei) ' || w ELSE w END
  FROM o JOIN i ON l_orderkey = o_orderkey),
units AS (SELECT law_id, law_id || '-art-' || a || s AS provision_id, CAST(a AS INTEGER) AS article_no, 'TÍTULO I {PLACE}' AS title, CASE WHEN o_custkey % 2 = 0 THEN 'CAPÍTULO I Disposições' END AS chapter, CAST(unit_no AS INTEGER) AS unit_no, law_id || '-art-' || a || s || '-' || name AS unit_id, kind, status, text FROM u)"""


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(law_id, html): one page a customer."""
    rank = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(rank))
    word = F.concat(F.lit("palavra "), F.col("l_partkey").cast("string"), F.expr("repeat(' mais', cast(l_quantity as int))"))
    number = F.col("k").cast("string")
    forms = [F.concat(F.lit("§ "), number, F.lit("º "), word), F.concat(F.lit("I - "), word), F.concat(F.lit("a) "), word), F.concat(F.lit("II - (VETADO) "), word), F.concat(F.lit("Pena - "), word), F.concat(F.lit("(Revogado pela Lei) "), word), word]
    body = F.element_at(F.array(*forms), (F.col("k") - 1) % 7 + 1)
    units = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("b")))), lambda x: F.concat(F.lit("<p>"), x["b"], F.lit("</p>"))), "\n").alias("units"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("a", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    rows = orders.join(units, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    lettered = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("<p>Art. %d-A. Artigo com letra (Revogado)</p>", "a")).otherwise("")
    article = F.concat(F.format_string("<p>Art. %dº Pedido %d.</p>", "a", "o_orderkey"), F.coalesce("units", F.lit("")), lettered)
    pages = rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", article.alias("h")))), lambda x: x["h"]), "\n").alias("h"))
    head = F.concat(F.lit(f"<html><body><p>TÍTULO I</p><p>{PLACE}</p>"), F.when(F.col("o_custkey") % 2 == 0, "<p>CAPÍTULO I Disposições</p>").otherwise(""))
    return pages.select(F.concat(F.lit("law-"), F.col("o_custkey").cast("string")).alias("law_id"), F.concat(head, "h", F.lit("</body></html>")).alias("html"))


@register(f"WITH {LAW_SQL} SELECT law_id, provision_id, article_no, title, chapter, unit_no, unit_id, kind, status, text FROM units")
def legal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statutes.legal_units(laws(spark, sf_dir)).drop("suffix", "section")


@register(f"""
WITH {LAW_SQL}
SELECT law_id, provision_id, CASE WHEN count(DISTINCT status) FILTER (kind <> 'note') = 1 AND min(status) FILTER (kind <> 'note') <> 'active' THEN min(status) FILTER (kind <> 'note') ELSE 'active' END AS status FROM units GROUP BY ALL
""")
def article_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statutes.article_status(statutes.legal_units(laws(spark, sf_dir)))


@register(f"""
WITH {LAW_SQL},
c AS (SELECT law_id, provision_id, unit_id, concat_ws(' | ', title, chapter, unit_id) AS head, regexp_extract_all(text, '(?s)\\S(?:.{{0,99}}$|.{{49,98}} |.{{99}})') AS parts FROM units WHERE status = 'active'),
p AS (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM c)
SELECT law_id, provision_id, unit_id, law_id || ':legal:' || unit_id || ':part-' || lpad(CAST(n AS VARCHAR), 2, '0') AS chunk_id, head || chr(10) || chr(10) || rtrim(parts[n]) AS text FROM p
""")
def legal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads take more than half of the target, so pieces have the least size of 100."""
    return statutes.legal_chunks(statutes.legal_units(laws(spark, sf_dir)), target=200)


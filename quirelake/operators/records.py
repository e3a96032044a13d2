"""Run telemetry, citations, stores of chunks, damaged logs, reports and job stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote_in
from .metrics import shown


def run_totals(runs: DataFrame) -> DataFrame:
    """One row over all runs: counts by outcome (else by success), costs, tokens, retrieval."""
    outcome = F.coalesce("outcome", F.when(F.col("success"), "succeeded").otherwise("failed"))
    return runs.agg(
        F.count("*").alias("runs"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if(outcome.isin("failed", "partial")).alias("failures"),
        F.count_if(outcome == "blocked").alias("blocked"),
        F.count_if(outcome == "review_required").alias("review_required"),
    )


def run_metrics(traces: DataFrame, *, run: str = "run_id") -> DataFrame:
    """Per run: durations (a batch's once), tokens, cost (null only if all are), models, chunks."""
    batches = traces.groupBy(run, F.coalesce("batch_id", F.concat(F.lit("trace "), F.col("trace_id").cast("string"))).alias("b")).agg(F.max("duration_ms").alias("ms"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost"), F.collect_set("model").alias("models"), F.collect_set("chunk_id").alias("chunks"))
    return batches.groupBy(run).agg(F.sum("ms").alias("duration_ms"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost_usd"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"), F.size(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"))


def validated_citations(citations: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``valid``: the quote is on its page, inside its chunk if one is named.

    ``citations``: doc_id, chunk_id or null, page, quote.  ``chunks``: chunk_id, text,
    page_start, page_end.  ``pages``: doc_id, page_no, text.
    """
    c = chunks.select("chunk_id", F.col("text").alias("__chunk"), "page_start", "page_end")
    p = pages.select("doc_id", F.col("page_no").alias("page"), F.col("text").alias("__page"))
    rows = citations.join(c, "chunk_id", "left").join(p, ["doc_id", "page"], "left")
    in_chunk = F.col("chunk_id").isNull() | (F.coalesce(quote_in(F.col("quote"), F.col("__chunk")), F.lit(False)) & F.col("page").between(F.col("page_start"), F.col("page_end")))
    on_page = F.coalesce(quote_in(F.col("quote"), F.col("__page")), F.lit(False))
    return rows.withColumn("valid", F.coalesce(in_chunk & on_page, F.lit(False))).select(*citations.columns, "valid")


def citation_counts(checked: DataFrame, conclusions: DataFrame) -> DataFrame:
    """total, verified, rejected citations, conclusions without any, groundedness and coverage, to three decimals (halves of the binary value to even).

    Hallucination is what the rounded groundedness lacks of 1; without citations groundedness is 0.
    """
    with_any = checked.select("conclusion_id").distinct()
    n = checked.agg(F.count("*").alias("total"), F.count_if("valid").alias("verified"), F.avg(F.col("valid").cast("double")).alias("share"))
    c = conclusions.join(with_any.withColumn("has", F.lit(True)), "conclusion_id", "left").agg(F.count_if(F.col("has").isNull()).alias("conclusions_without"), F.avg(F.coalesce("has", F.lit(False)).cast("double")).alias("coverage"))
    joined = n.withColumn("k", F.lit(1)).join(c.withColumn("k", F.lit(1)), "k")
    grounded = shown(F.coalesce("share", F.lit(0.0)))
    return joined.select("total", "verified", (F.col("total") - F.col("verified")).alias("rejected"), "conclusions_without", grounded.alias("groundedness"), shown(1 - grounded).alias("hallucination"), shown(F.coalesce("coverage", F.lit(0.0))).alias("coverage"))


def replaced(existing: DataFrame, new: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """A store after the documents of ``new`` were replaced whole."""
    return existing.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)


def stale(existing: DataFrame, new: DataFrame, *, doc: str = "doc_id", item: str = "chunk_id") -> DataFrame:
    """Items of replaced documents that the new version lacks."""
    return existing.join(new.select(doc).distinct(), doc, "left_semi").join(new.select(item), item, "left_anti")


def label_errors(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Labels whose id is unknown or not active: id, problem.  ``known``: id, status."""
    rows = labels.join(known, "id", "left")
    problem = F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "active", "inactive")
    return rows.withColumn("problem", problem).filter("problem is not null").select(*labels.columns, "problem")


def overlapping(left: DataFrame, right: DataFrame, *, key: str, start: str = "page_start", end: str = "page_end") -> DataFrame:
    """Pairs of spans of one document that share a page; an equi-join with a band residual."""
    same = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"l.{start}") <= F.col(f"r.{end}")) & (F.col(f"r.{start}") <= F.col(f"l.{end}"))
    return left.alias("l").join(right.alias("r"), same)


def parsed_log(lines: DataFrame, schema: T.StructType, required: list[str], *, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON lines; damaged lines and lines without a required field are rejected."""
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    rows = lines.select(F.col(value), F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    whole = F.col("r.__bad").isNull() & F.col("r").isNotNull()
    for name in required:
        whole = whole & F.col(f"r.{name}").isNotNull()
    return rows.filter(whole).select(*[F.col(f"r.{f.name}") for f in schema.fields]), rows.filter(~whole).select(value)


def stage_status(stages: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Status of each stage: failed, done, skipped, then running for the first open one, else pending."""
    closed = F.when(F.col("failed"), "failed").when(F.col("done"), "done").when(F.col("skipped"), "skipped")
    rows = stages.withColumn("closed", closed)
    first = F.min(F.when(F.col("closed").isNull(), F.col("stage_no"))).over(Window.partitionBy(job))
    return rows.withColumn("status", F.coalesce("closed", F.when(F.col("stage_no") == first, "running").otherwise("pending"))).drop("closed")


def latest(movements: DataFrame, *, key: str, value: str, at: str) -> DataFrame:
    """The value with the largest time of each key."""
    return movements.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def with_court_records(cases: DataFrame, records: DataFrame, *, number: str = "case_number") -> DataFrame:
    """Left join to the court records with a status note."""
    rows = cases.join(records.withColumn("__found", F.lit(True)), number, "left")
    note = F.when(F.col(number).isNull(), "no_case_number").when(F.col("__found").isNull(), "not_found").otherwise("found")
    return rows.withColumn("enrichment", note).drop("__found")


def markdown(title: Column, parts: list[tuple[str, Column]]) -> Column:
    """A report in Markdown; parts that are null or empty are left out."""
    blocks = [F.concat(F.lit("# "), title)] + [F.when(body.isNotNull() & (body != ""), F.concat(F.lit(f"## {head}\n\n"), body)) for head, body in parts]
    return F.concat_ws("\n\n", *blocks)


def versioned_name(prefix: str, corpus: Column, embedding: Column) -> Column:
    """``prefix-slug-hash`` of a corpus and an embedding id, for partitions of an index."""
    slug = F.substring(F.trim(F.regexp_replace(F.lower(corpus), "[^a-z0-9]+", "-"), F.lit("-")), 1, 40)
    return F.concat_ws("-", F.lit(prefix), slug, F.substring(F.sha2(F.concat_ws(":", corpus, embedding), 256), 1, 12))

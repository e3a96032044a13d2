"""Case work on retrieval results: grounds, evidence, citations, confidence, orders, passages and extraction scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import bound
from ..functions.text import chunk_quote, citation_form

MOST_GROUNDS, MOST_EVIDENCE, MOST_REFERENCES = 8, 8, 50
WINDOW, STEP = 700, 600
SEMANTIC_CONFIDENCE = 0.7
BATCH_CHARACTERS = 12_000


def first_rows(rows: DataFrame, group: list[str], order: list, most: int, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group; the sort stops early in each partition."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= most)


def legal_grounds(merged: DataFrame, *, case: str, provision: str, status: str, unit_status: str, rank: str, most: int = MOST_GROUNDS) -> DataFrame:
    """Active provisions in the order of their best rank, each once, ``most`` at most per case."""
    active = merged.filter((F.col(status) == "active") & (F.col(unit_status).isNull() | (F.col(unit_status) == "active")))
    best = active.groupBy(case, provision).agg(F.min(rank).alias("best_rank"))
    return first_rows(best, [case], ["best_rank", provision], most, "position")


def evidence_references(merged: DataFrame, pages: DataFrame, *, case: str, rank: str, text: str, page: str = "page", most: int = MOST_EVIDENCE) -> DataFrame:
    """The first quotes that lie on a page of an evidence file; empty quotes and unknown pages do not count."""
    quotes = merged.join(pages, [case, page]).withColumn("quote", chunk_quote(F.col(text))).filter("quote <> ''")
    return first_rows(quotes, [case], [rank], most, "position")


def citations_in_context(citations: DataFrame, retrieved: DataFrame, *, run: str, agent: str = "agent", chunk: str = "chunk_id") -> DataFrame:
    """Per run: citations with a chunk, those whose chunk was in the context of the agent that cites, and their share."""
    known = retrieved.filter("included").select(run, agent, chunk).distinct().withColumn("__in", F.lit(1))
    joined = citations.filter(F.col(chunk).isNotNull()).join(known, [run, agent, chunk], "left")
    counts = joined.groupBy(run).agg(F.count("*").alias("citations"), F.count("__in").alias("in_context"))
    return counts.withColumn("coverage", F.round(F.col("in_context") / F.col("citations"), 3))


def included_chunks(retrieved: DataFrame, *, run: str, agent: str = "agent", chunk: str = "chunk_id") -> DataFrame:
    """Distinct chunks in each agent's context, in order."""
    return retrieved.filter("included").groupBy(run, agent).agg(F.array_sort(F.collect_set(chunk)).alias("chunk_ids"))


def aggregate_confidence(conclusions: DataFrame, runs: DataFrame, *, run: str) -> DataFrame:
    """Unweighted mean of the confidences, clamped to 0 to 1 each; 0 for a run without conclusions."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    means = conclusions.groupBy(run).agg(F.round(F.avg(clamped), 3).alias("confidence"))
    return runs.select(run).distinct().join(means, run, "left").select(run, F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def case_status(*, notice: Column, ready: Column, missing: Column) -> Column:
    """Status of a case: a notice goes before readiness, this before missing facts, these before evidence."""
    return F.when(notice, "notice_generated").when(ready, "ready_for_notice").when(missing, "collecting_facts").otherwise("collecting_evidence")


def requests(*, resolution: Column, loss: Column, protocols: Column) -> Column:
    """What a notice asks for, in order (fixed texts)."""
    parts = [
        F.coalesce(F.nullif(resolution, F.lit("")), F.lit("solução integral do problema relatado")),
        F.when(loss > 0, "restituição do prejuízo direto alegado, após conferência dos comprovantes"),
        F.when(F.size(protocols) > 0, "resposta escrita e fundamentada aos protocolos já registrados"),
        F.lit("confirmação escrita das providências adotadas dentro do prazo indicado"),
    ]
    return F.array_compact(F.array(*parts))


def trace_items(results: DataFrame, *, text: str = "text") -> DataFrame:
    """Results for an audit trail: the text gives way to its hash and length."""
    return results.withColumns({"content_sha256": F.sha2(text, 256), "n_chars": F.length(text)}).drop(text)


def passages(pages: DataFrame, *, key: str, text: str) -> DataFrame:
    """Sentences of a page: up to a full stop, exclamation or question mark or semicolon."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?;]+[.!?;]?"), F.lit(0)), lambda p: F.trim(p, F.lit(" \t\n\r")))
    return pages.select(key, F.posexplode(F.filter(parts, lambda p: p != "")).alias("n", "passage"))


def windows_of(text: Column, *, width: int = WINDOW, step: int = STEP) -> Column:
    """Array of struct(n, passage): overlapping windows of a text, trimmed, without blank ones.

    The text is cut once, into pieces of ``step`` characters, and a window is a piece with
    the beginning of what follows: work is linear in the text, and no row carries it along.
    """
    more = -(-width // step)  # pieces that a window reaches into
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def window(p: Column, i: Column) -> Column:
        whole = F.substring(F.array_join(F.slice(p, i + 1, F.lit(more)), ""), 1, width)
        return F.struct(i.alias("n"), F.trim(whole, F.lit(" \t\n\r")).alias("passage"))

    return bound(pieces, lambda p: F.filter(F.transform(p, lambda _, i: window(p, i)), lambda w: w["passage"] != ""))


def windows(pages: DataFrame, *, key: str, text: str, width: int = WINDOW, step: int = STEP) -> DataFrame:
    """Overlapping windows over the whole text of every page; blank ones are left out."""
    rows = pages.select(key, F.explode(windows_of(F.col(text), width=width, step=step)).alias("__w"))
    return rows.select(key, (F.col("__w.n") * step).alias("start"), F.col("__w.passage").alias("passage"))


def batches(sizes: Column, most: int = BATCH_CHARACTERS) -> Column:
    """Batch number of each candidate, by its size in JSON: a batch is closed before it would pass ``most``.

    Each element costs one more character for the comma, each batch two for its brackets.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(2).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        new = (acc["used"] > 2) & (acc["used"] + size > most)
        n = acc["n"] + new.cast("int")
        used = F.when(new, F.lit(2)).otherwise(acc["used"]) + size + 1
        return F.struct(n.alias("n"), used.cast("int").alias("used"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("int")), start, step, lambda acc: acc["out"])


def validated_findings(found: DataFrame, pages: DataFrame, candidates: DataFrame, *, doc: str, page: str = "page", text: str = "text", passage: str = "passage") -> DataFrame:
    """Findings of a reviewer whose quote stands on the page and in a passage that was shown, sure enough; critical counts as high."""
    sure = found.filter((F.col("confidence") >= SEMANTIC_CONFIDENCE) & (F.col("severity") != "none")).withColumn("quote", F.trim("quote"))
    on_page = sure.join(pages.select(doc, page, F.col(text).alias("__page")), [doc, page]).filter(F.contains("__page", F.col("quote"))).drop("__page")
    shown = candidates.select(F.col(doc).alias("__d"), F.col(page).alias("__p"), F.col(passage).alias("__c"))
    inside = (F.col(doc) == F.col("__d")) & (F.col(page) == F.col("__p")) & F.contains(F.col("__c"), F.col("quote"))
    return on_page.join(shown, inside, "left_semi").withColumn("severity", F.when(F.col("severity") == "critical", "high").otherwise(F.col("severity")))


def set_difference(expected: DataFrame, found: DataFrame, *, key: str) -> DataFrame:
    """Keys that only one of two sets has: ``missing`` or ``unexpected``."""
    sides = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(found.select(key, F.lit(0).alias("e"), F.lit(1).alias("f")))
    per = sides.groupBy(key).agg(F.max("e").alias("e"), F.max("f").alias("f")).filter("e <> f")
    return per.select(key, F.when(F.col("e") == 1, "missing").otherwise("unexpected").alias("side"))


def extraction_scores(*, checks: dict[str, tuple[Column, Column, Column]]) -> tuple[Column, Column]:
    """(accuracy, completeness) over named fields, each (expected, extracted, agrees).

    A field counts if a value is expected; without any, accuracy is 0 and completeness 1.
    """
    asked = F.array(*[expected.isNotNull() for expected, _, _ in checks.values()])
    right = F.array(*[expected.isNotNull() & F.coalesce(agrees, F.lit(False)) for expected, _, agrees in checks.values()])
    filled = F.array(*[expected.isNotNull() & extracted.isNotNull() for expected, extracted, _ in checks.values()])
    n = F.size(F.filter(asked, lambda x: x))
    share = lambda x: F.round(F.size(F.filter(x, lambda y: y)) / n, 3)
    return F.when(n == 0, 0.0).otherwise(share(right)), F.when(n == 0, 1.0).otherwise(share(filled))


def names_agree(found: Column, expected: Column) -> Column:
    """Whether a name, normalised, holds the expected one, normalised."""
    return F.contains(citation_form(found), citation_form(expected))


def classification_score(actual: Column, expected: Column) -> Column:
    """1 or 0; null where no label is expected."""
    return F.when(expected.isNotNull(), F.when(actual == expected, 1.0).otherwise(0.0))

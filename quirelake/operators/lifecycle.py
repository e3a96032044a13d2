"""Keeping an index and a case file up to date: batches, replacement, provenance, orders and corpus digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, json_string

# Fixed values.
MOST_MONEY_REFERENCES, CAPUT, SENTENCE_FROM = 50, 700, 200
ARTICLE_NUMBER = r"^Art\.\s*\d+(?:[º°])?(?:-[A-Z])?\.?(?:\s+|$)"
SEVERITIES = ("none", "low", "medium", "high", "critical")  # weakest first


def joined_vectors(chunks: DataFrame, vectors: DataFrame, *, chunk: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors, one to one; a chunk or a vector without its partner, or a repeated id, is an error."""
    tally = lambda side: F.count(side).over(Window.partitionBy(chunk))
    left, right = chunks.withColumn("__c", F.lit(1)), vectors.withColumn("__v", F.lit(1))
    both = left.join(right, chunk, "full").withColumns({"__n": tally("__c"), "__m": tally("__v")})
    wrong = F.raise_error(F.concat(F.lit("chunks and vectors differ at "), F.coalesce(F.col(chunk).cast("string"), F.lit("a null id"))))
    # The check is part of the predicate, so no plan can prune it away.
    checked = F.when((F.col("__n") == 1) & (F.col("__m") == 1), F.lit(True)).otherwise(wrong.cast("boolean"))
    return both.filter(checked).drop("__c", "__v", "__n", "__m")


def indexed(store: DataFrame, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, *, doc: str = "doc_id", chunk: str = "chunk_id") -> DataFrame:
    """The store after ``documents`` were indexed again: their old chunks go, also of those that are empty now."""
    return without_documents(store, documents, doc=doc).unionByName(joined_vectors(chunks, vectors, chunk=chunk).select(*store.columns))


def without_documents(store: DataFrame, documents: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """The store after ``documents`` were deleted."""
    return store.join(documents.select(doc).distinct(), doc, "left_anti")


def payload(rows: DataFrame, columns: list[str], name: str = "payload") -> DataFrame:
    """Everything of a chunk as one JSON column beside the rest; nulls are written out."""
    return rows.withColumn(name, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def restored(rows: DataFrame, schema: str, name: str = "payload") -> DataFrame:
    """Chunks out of their payload; where an older row has none, the columns beside it are taken."""
    read = rows.withColumn("__p", F.from_json(name, schema))
    fields = [f.name for f in read.schema["__p"].dataType.fields]
    own = lambda f: F.when(F.col("__p").isNotNull(), F.col("__p")[f]).otherwise(F.col(f)) if f in rows.columns else F.col("__p")[f]
    return read.select(*[own(f).alias(f) for f in fields])


def batch_outcome(asked: DataFrame, hits: DataFrame, failures: DataFrame, *, query: str = "query_id") -> DataFrame:
    """One row per query of a batch: status, hits and error; a failed query does not take its siblings along.

    ``failures``: query and error.  The hits of a failed query do not count.
    """
    errors = failures.groupBy(query).agg(F.min("error").alias("error"))
    counts = hits.groupBy(query).agg(F.count("*").alias("n"))
    rows = asked.select(query).join(errors, query, "left").join(counts, query, "left")
    failed = F.col("error").isNotNull()
    status = F.when(failed, "failed").when(F.col("n") > 0, "found").otherwise("empty")
    return rows.select(query, status.alias("status"), F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("hits"), "error")


def first_text(*candidates: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c, F.lit(" \t\n\r")), F.lit("")) for c in candidates])


def unit_of(chunk_id: Column) -> Column:
    """The statute unit that a legal chunk's id names; null for other chunks."""
    return F.nullif(F.regexp_extract(chunk_id, r":legal:(.+):part-[0-9]+$", 1), F.lit(""))


def with_current_ids(rows: DataFrame, aliases: DataFrame, *, key: str, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """Ids of earlier releases replaced by the current ones, where an alias is known."""
    known = aliases.groupBy(F.col(old).alias("__old")).agg(F.min(new).alias("__new"))
    return rows.join(known, F.col(key) == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key)).drop("__old", "__new")


def page_sources(retrieved: DataFrame, files: DataFrame, *, case: str, page: str = "page") -> DataFrame:
    """Retrieved pages with the evidence file that holds them; files: case, evidence, first, last.

    Pages of no file are left out.  A join on the case with a band residual.
    """
    band = (F.col(f"r.{case}") == F.col(f"f.{case}")) & F.col(f"r.{page}").between(F.col("f.first"), F.col("f.last"))
    return retrieved.alias("r").join(files.alias("f"), band).select("r.*", "f.evidence", (F.col(f"r.{page}") - F.col("f.first") + 1).alias("local_page"))


def money_references(mentions: DataFrame, *, document: str, page: str, amount: str, quote_sha256: str, order: str, most: int = MOST_MONEY_REFERENCES) -> DataFrame:
    """The first amounts of each document, each with an id that follows from file, page, amount and quote."""
    w = Window.partitionBy(document).orderBy(page, order)
    first = mentions.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)
    parts = [F.col(document), F.col(page).cast("string"), F.col(amount).cast("string"), F.col(quote_sha256)]
    return first.withColumn("reference_id", F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24))


def guarded_updates(updates: DataFrame, references: DataFrame, *, case: str, reference: str = "reference_id", amount: str = "amount") -> DataFrame:
    """Updates of a loss: ``accepted`` and the reference to store.

    ``updates``: case, amount, reference_id, names_reference (whether the update names one),
    old_amount, old_reference, has_amount.  A new amount without a reference clears the old one;
    a reference must be that of an accepted value of the same case and of the same amount.
    """
    named = F.when(F.col("names_reference"), F.col(reference)).when(F.col("has_amount"), F.lit(None)).otherwise(F.col("old_reference"))
    value = F.when(F.col("has_amount"), F.col(amount)).otherwise(F.col("old_amount"))
    rows = updates.withColumns({"__ref": named, "__value": value})
    known = references.groupBy(F.col(case).alias("__case"), F.col(reference).alias("__known")).agg(F.max(amount).alias("__amount"))
    found = rows.join(known, (F.col(case) == F.col("__case")) & (F.col("__ref") == F.col("__known")), "left")
    right = F.col("__ref").isNull() | F.coalesce(F.col("__amount") == F.col("__value"), F.lit(False))
    return found.select(case, F.col("__value").alias("amount"), F.when(right, F.col("__ref")).alias("reference_id"), right.alias("accepted"))


def corpus_digests(units: DataFrame, *, corpus: str, order: str, content: str) -> DataFrame:
    """A digest per corpus, equal only for equal units in equal order.

    Units are hashed where they lie; only the hashes meet, and these by blocks of
    4096 order numbers, so no task holds the units of a corpus.
    """
    hashed = units.select(corpus, order, F.sha2(F.concat_ws(":", F.col(order).cast("string"), F.coalesce(content, F.lit(""))), 256).alias("h"))
    joined = lambda key: F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"])), 256)
    blocks = hashed.groupBy(corpus, F.floor(F.col(order) / 4096).alias("b")).agg(joined(order).alias("h"), F.count("*").alias("k"))
    return blocks.groupBy(corpus).agg(joined("b").alias("corpus_sha256"), F.sum("k").alias("units"))


def canonical_corpus_sha256(provisions: DataFrame, *, corpus: str, position: str, content: str) -> DataFrame:
    """sha-256 of the canonical JSON of each corpus: its release, and its provisions in order.

    ``content`` is a struct column, nested as it likes; texts should stand in it by their
    hashes.  Provisions are written as JSON where they lie; those of one corpus meet in one
    row, which a hash over one document cannot avoid.  ``corpus_digests`` has no such bound.
    """
    kind = provisions.schema[content].dataType
    rows = provisions.select(corpus, position, canonical_json(F.col(content), kind).alias("json"))
    joined = rows.groupBy(corpus).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "json"))), lambda x: x["json"]), ",").alias("all"), F.count("*").alias("provisions"))
    payload = F.concat(F.lit('{"corpus_release_id":'), json_string(F.col(corpus).cast("string")), F.lit(',"provisions":['), "all", F.lit('],"schema_version":1}'))
    return joined.select(corpus, F.sha2(payload, 256).alias("corpus_sha256"), "provisions")


def chunk_totals(chunks: DataFrame, *, doc: str, section: str) -> DataFrame:
    """Chunks and distinct sections per document."""
    return chunks.groupBy(doc).agg(F.count("*").alias("chunks"), F.count_distinct(section).alias("sections"))


def provision_page(*, reference: Column, citation: Column, hierarchy: list[Column], status: Column, content: Column) -> Column:
    """One synthetic page of a provision for the index."""
    path = F.coalesce(F.nullif(F.concat_ws(" > ", *[F.nullif(x, F.lit("")) for x in hierarchy]), F.lit("")), F.lit("não informada"))
    head = F.concat_ws("\n", F.concat(F.lit("Citação: "), citation), F.concat(F.lit("Hierarquia: "), path), F.concat(F.lit("Status: "), F.upper(status)))
    return F.concat_ws("\n\n", F.concat(F.lit("REFERÊNCIA LEGAL "), F.upper(reference)), head, content)


def display_summary(reviewed: Column, caput: Column) -> Column:
    """A reviewed text, else the caput without its number, up to 700 characters and to the end of a sentence if that is not too near the start."""
    body = F.regexp_replace(caput, ARTICLE_NUMBER, "")
    head = F.substring(body, 1, CAPUT)
    # The last ". " of the head begins where the greedy prefix ends.
    at = F.length(F.regexp_extract(head, r"(?s)^(.*)\. ", 1))
    cut = F.when(head.rlike(r"(?s)\. ") & (at >= SENTENCE_FROM), F.substring(head, F.lit(1), at + 1)).otherwise(F.substring(head, 1, CAPUT - 3))
    return F.coalesce(F.nullif(reviewed, F.lit("")), F.when(F.length(body) <= CAPUT, body).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("..."))))


def reranked(candidates: DataFrame, score: Column, k: int, *, query: str = "query_id", chunk: str = "chunk_id") -> DataFrame:
    """Candidates in the order of a new score, ties by chunk; ``score`` is any column, a model's Arrow function included."""
    rows = candidates.withColumn("rerank_score", score)
    w = Window.partitionBy(query).orderBy(F.desc("rerank_score"), chunk)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def finding_order(severity: str = "severity", page: str = "page", category: str = "category", quote: str = "quote") -> list[Column]:
    """Sort keys of findings: strongest first, then page, category and quote."""
    return [F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity)).desc(), F.col(page), F.col(category), F.col(quote)]


def newest_runs(runs: DataFrame, most: int, *, at: str, run: str, heavy: tuple[str, ...] = ()) -> DataFrame:
    """The newest runs without their ``heavy`` columns: a top-k, not a sort of the log."""
    return runs.drop(*heavy).orderBy(F.desc(at), F.desc(run)).limit(most)


def retrieval_rows(traces: DataFrame, *, run: str, queries: str = "queries") -> DataFrame:
    """One row per result, in the order of the audit; queries without results stay as a row of nulls.

    ``queries``: array of structs (created_at, agent, query_index, results: array of structs).
    """
    asked = traces.select(run, F.explode_outer(queries).alias("q"))
    return asked.select(run, "q.created_at", "q.agent", "q.query_index", F.posexplode_outer("q.results").alias("position", "result"))


def money_sources(components: DataFrame, *, case: str) -> DataFrame:
    """Sources of the parts of a settlement, one row each: part, amount, origin and place.

    ``components``: array of structs (kind, amount, sources: array of structs (evidence, page)).
    """
    parts = components.select(case, F.explode("components").alias("c"))
    rows = parts.select(case, "c.kind", "c.amount", F.explode_outer("c.sources").alias("s"))
    return rows.select(case, "kind", "amount", F.when(F.col("s.evidence").isNotNull(), "evidence").otherwise("statement").alias("origin"), "s.evidence", "s.page")


def relevant_sets(labels: DataFrame, *, query: str, group: str = "group", item: str = "item", negative: str = "negative") -> DataFrame:
    """Per query the union of its relevance groups, and the items that are hard negatives as well, which is an error in a golden set."""
    per = labels.groupBy(query).agg(F.array_sort(F.collect_set(F.when(~F.col(negative), F.col(item)))).alias("relevant"), F.array_sort(F.collect_set(F.when(F.col(negative), F.col(item)))).alias("against"), F.count_distinct(F.when(~F.col(negative), F.col(group))).alias("groups"))
    return per.select(query, "relevant", F.array_intersect("relevant", "against").alias("contradictory"), "groups")

"""Scan of documents for prompt injection in three modes, with budgets, failing closed.

``rules``     the rules alone;
``balanced``  a reviewer also sees the passages that the rules or suspicious terms point at;
``strict``    a reviewer sees overlapping windows of every page.

In strict mode a document with more characters, or whose windows make more batches, than
the budgets allow is not reviewed at all: what was left out is counted, the scan counts
as incomplete, and an incomplete scan blocks the document.  The reviewer is a function
from candidates to findings (a model behind an Arrow function, or any plan); rows that
it returns with an ``error`` fail their document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bound
from ..functions.text import any_term, canonical_form
from ..sources.spread import spread
from ..sources.staging import staged
from . import casework, security

MODES = ("rules", "balanced", "strict")
MOST_CHARACTERS, MOST_BATCHES = 500_000, 64
MOST_CANDIDATES, PASSAGE = 20, 700

# Terms of control, terms for an AI system, and markers of a system message, in canonical form.
CONTROL_TERMS = r"\b(?:ignore|disregard|forget|override|bypass|reveal|show|print|call|invoke|execute|run|use|send|upload|transmit|respond|return|follow|obey|desconsidere|esqueca|ignore|revele|mostre|imprima|chame|invoque|execute|rode|use|envie|transmita|responda|retorne|siga|obedeca)\b"
TARGET_TERMS = r"\b(?:prompt|system|developer|assistant|chatgpt|model|instructions?|tools?|functions?|api\s+keys?|secrets?|sistema|desenvolvedor|assistente|modelo|instrucoes?|ferramentas?|funcoes?|chaves?\s+(?:da|de)\s+api|segredos?)\b"
MARKERS = security.RULES[-1][4]
TERMS = (CONTROL_TERMS, TARGET_TERMS, MARKERS)
#: Beginnings of the terms for an AI system and of the words in markers; most texts hold none of them.
HINTS = ("prompt", "system", "developer", "assist", "chatgpt", "model", "instruc", "tool", "func", "api", "secret", "sistema", "desenvolvedor", "ferramenta", "chave", "segredo")

#: From candidates (doc, page, n, passage) to rows (doc, page, n, category, severity, confidence, quote, error).
Reviewer = Callable[[DataFrame], DataFrame]


def first_match(form: Column, pattern: str) -> Column:
    """struct(a, b): where the first match begins and ends, counted from 0; null without one."""
    begin = F.regexp_instr(form, F.lit(pattern)) - 1
    return bound(begin, lambda a: F.when(a >= 0, F.struct(a.alias("a"), (a + F.length(F.regexp_extract(form, pattern, 0))).alias("b"))))


def source_place(text: Column, place: Column) -> Column:
    """Number of the source character that the folded character ``place`` comes from, both from 0.

    Folding drops characters and takes others apart, but goes character by character, so the
    place is found by halving: the longest source prefix whose form has at most ``place`` characters.
    """
    start = F.struct(F.lit(0).alias("low"), F.length(text).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        fits = F.length(canonical_form(F.substring(text, F.lit(1), middle))) <= place
        return bound(F.struct(fits.alias("f"), middle.alias("m")), lambda x: F.struct(F.when(x["f"], x["m"]).otherwise(s["low"]).alias("low"), F.when(x["f"], s["high"]).otherwise(x["m"] - 1).alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.length(text) + 2)).cast("int"))
    return F.least(F.aggregate(steps, start, halve, lambda s: s["low"]), F.length(text) - 1)


def window_around(text: Column, a: Column, b: Column, width: int = PASSAGE) -> Column:
    """At most ``width`` characters of a text with the middle of its part from ``a`` to before ``b`` in their middle."""
    start = F.greatest(F.lit(0), F.floor((a + b) / 2).cast("int") - width // 2)
    first = F.greatest(F.lit(0), F.least(start, F.length(text) - width))
    return F.when(F.length(text) <= width, text).otherwise(F.substring(text, first + 1, F.lit(width)))


def focused(text: Column, width: int = PASSAGE, terms: tuple[str, str, str] = TERMS) -> Column:
    """The window of a passage around its terms of control and of AI systems; null for a passage without both and without a marker.

    ``terms`` are the patterns of the three, for the canonical form.
    """

    def of(form: Column) -> Column:
        found = F.struct(*[first_match(form, p).alias(n) for n, p in zip("ctm", terms, strict=True)])
        return bound(found, window)

    def window(f: Column) -> Column:
        wanted = (f["c"].isNotNull() & f["t"].isNotNull()) | f["m"].isNotNull()
        a, b = F.least(f["c"]["a"], f["t"]["a"], f["m"]["a"]), F.greatest(f["c"]["b"], f["t"]["b"], f["m"]["b"])
        cut = bound(F.struct(source_place(text, a).alias("a"), (source_place(text, b - 1) + 1).alias("b")), lambda s: window_around(text, s["a"], s["b"], width))
        return F.when(wanted, F.when(F.length(text) <= width, text).otherwise(cut))

    return bound(canonical_form(text), of)


def suspicious_passages(pages: DataFrame, found: DataFrame, *, most: int = MOST_CANDIDATES) -> DataFrame:
    """Candidates of the balanced mode: quotes of findings, then focused passages; each text once a page, ``most`` a document.

    pages: doc, page, text; found: doc, page, severity, category, quote.
    """
    order = security.severity_rank(F.col("severity"))
    quotes = found.select("doc", "page", F.struct(F.lit(0).alias("kind"), (-order).cast("long").alias("a"), F.col("page").cast("long").alias("b"), F.concat_ws(":", "category", "quote").alias("c")).alias("at"), F.col("quote").alias("passage"))
    parts = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^.!?;]+[.!?;]?"), F.lit(0)), lambda p: F.trim(p, F.lit(" \t\n\r")))
    # Passages end at signs that are no letters, so what a passage matches its page matches too.
    hinted = bound(canonical_form(F.coalesce("text", F.lit(""))), lambda f: any_term(f, HINTS) & ((f.rlike(TARGET_TERMS) & f.rlike(CONTROL_TERMS)) | f.rlike(MARKERS)))
    split = pages.filter(hinted).select("doc", "page", F.posexplode(parts).alias("n", "part")).filter("part <> ''")
    shown = split.select("doc", "page", F.struct(F.lit(1).alias("kind"), F.col("page").cast("long").alias("a"), F.col("n").cast("long").alias("b"), F.lit("").alias("c")).alias("at"), focused(F.col("part")).alias("passage"))
    rows = quotes.unionByName(shown.filter("passage IS NOT NULL")).withColumn("passage", F.substring(F.trim(F.col("passage"), F.lit(" \t\n\r")), 1, PASSAGE)).filter("passage <> ''")
    once = rows.groupBy("doc", "page", canonical_form(F.col("passage")).alias("form")).agg(F.min(F.struct("at", "passage")).alias("x"))
    return casework.first_rows(once.select("doc", "page", "x.at", "x.passage"), ["doc"], ["at"], most, "n").select("doc", "page", "n", "passage")


def all_windows(pages: DataFrame, *, width: int = PASSAGE, step: int = casework.STEP) -> DataFrame:
    """Candidates of the strict mode: overlapping windows of every page; ``n`` is their place in the page."""
    rows = pages.select("doc", "page", F.explode(casework.windows_of(F.col("text"), width=width, step=step)).alias("w"))
    return rows.select("doc", "page", "w.n", "w.passage")


def batch_count(sizes: Column, most: int = casework.BATCH_CHARACTERS) -> Column:
    """Number of batches that blocks of these sizes make, filled in order; each costs one more character, a batch two."""
    start = F.struct(F.lit(1).cast("long").alias("n"), F.lit(2).cast("long").alias("used"))

    def step(s: Column, size: Column) -> Column:
        full = (s["used"] > 2) & (s["used"] + size > most)
        return F.struct((s["n"] + full.cast("long")).alias("n"), (F.when(full, F.lit(2)).otherwise(s["used"]) + size + 1).cast("long").alias("used"))

    return F.when(F.size(sizes) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(sizes, start, step, lambda s: s["n"]))


def block_size(page: Column, passage: Column) -> Column:
    """Characters that a candidate takes as JSON."""
    return (F.length(F.to_json(F.struct(page.alias("page"), passage.alias("text")))) + 3).cast("long")


def reviewable(pages: DataFrame, candidates: DataFrame | None, *, strict: bool, most_characters: int, most_batches: int) -> DataFrame:
    """Per document: characters, batches and, in strict mode, why it is not reviewed (``error``).

    At most ``most_characters / STEP`` sizes of a document meet in one row.  Without
    ``candidates`` these are all windows, whose sizes are taken where the page is read, so
    no window is shuffled; a document beyond its characters has no batches then.
    """
    text = F.coalesce("text", F.lit(""))
    blocks = F.lit(None).cast("array<struct<page:int,n:int,size:bigint>>")
    if candidates is None:
        sized = F.transform(casework.windows_of(text), lambda w: F.struct(F.col("page").cast("int").alias("page"), w["n"].cast("int").alias("n"), block_size(F.col("page"), w["passage"]).alias("size")))
        blocks = F.when(F.length(text) <= most_characters, sized)
    each = pages.select("doc", F.length(text).alias("c"), blocks.alias("blocks"))
    rows = each.groupBy("doc").agg(F.sum("c").alias("characters"), F.flatten(F.collect_list("blocks")).alias("blocks"))
    if candidates is not None:
        sized = candidates.groupBy("doc").agg(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), F.col("n").cast("int").alias("n"), block_size(F.col("page"), F.col("passage")).alias("size"))).alias("blocks"))
        rows = rows.drop("blocks").join(sized, "doc", "left")
    batches = F.coalesce(batch_count(F.transform(F.array_sort("blocks"), lambda b: b["size"])), F.lit(0).cast("long"))
    if candidates is None:
        batches = F.when(F.col("characters") <= most_characters, batches).otherwise(F.lit(0).cast("long"))
    rows = rows.select("doc", "characters", batches.alias("batches"))
    if not strict:
        return rows.withColumn("error", F.lit(None).cast("string"))
    over = lambda what, value, most: F.concat(F.lit(f"strict {what} budget exceeded: "), F.col(value).cast("string"), F.lit(f" > {most}"))
    error = F.when(F.col("characters") > most_characters, over("character", "characters", most_characters)).when(F.col("batches") > most_batches, over("batch", "batches", most_batches))
    return rows.withColumn("error", error)


def rows_of(pages: DataFrame, *, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """doc, page, text, without null texts."""
    return spread(pages.select(F.col(doc).alias("doc"), F.col(page).cast("int").alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text")))


def rule_findings(pages: DataFrame, *, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Findings of the rules and of hidden payloads, found once for scans in several modes."""
    rows = rows_of(pages, doc=doc, page=page, text=text)
    return staged(security.findings(rows, doc="doc", page="page").unionByName(security.hidden_findings(rows, doc="doc", page="page")), "findings")


def scan(pages: DataFrame, mode: str = "balanced", reviewer: Reviewer | None = None, *, doc: str = "doc_id", page: str = "page_no", text: str = "text", most_characters: int = MOST_CHARACTERS, most_batches: int = MOST_BATCHES, by_rule: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(assessments, findings) of all documents.

    Assessments: doc, mode, findings, risk, action, reviewed, complete, characters, batches,
    unreviewed (characters that a strict scan left out), error.  Findings of the rules, of
    hidden payloads and of the reviewer, each kind once, the strongest of equals.
    ``by_rule``: what ``rule_findings`` gave for the same pages.  Rule findings, budgets, the
    candidates of the balanced mode and what the reviewer says are staged: each text is
    scanned once and the reviewer asked once.
    """
    if mode not in MODES:
        raise ValueError(f"no scan mode {mode}")
    rows = rows_of(pages, doc=doc, page=page, text=text)
    by_rule = rule_findings(pages, doc=doc, page=page, text=text) if by_rule is None else by_rule
    strict = mode == "strict"
    candidates = None
    if mode == "rules":
        candidates = rows.select("doc", "page", F.lit(0).alias("n"), F.col("text").alias("passage")).filter("false")
    elif not strict:
        candidates = staged(suspicious_passages(rows, security.deduplicated(by_rule, doc="doc")), "candidates")
    budget = staged(reviewable(rows, candidates, strict=strict, most_characters=most_characters, most_batches=most_batches), "budget")
    ready = budget.filter("error IS NULL").select("doc")
    shown = all_windows(rows.join(ready, "doc", "left_semi")) if strict else candidates

    found, failed = by_rule, budget.select("doc", F.lit(None).cast("string").alias("failure")).filter("false")
    if reviewer is not None and mode != "rules":
        reviews = staged(reviewer(shown), "reviews")
        failed = reviews.filter("error IS NOT NULL").groupBy("doc").agg(F.min("error").alias("failure"))
        asked = all_windows(rows.join(reviews.select("doc", "page"), ["doc", "page"], "left_semi")) if strict else shown
        found = by_rule.unionByName(confirmed(reviews.filter("error IS NULL"), asked))
    found = security.deduplicated(found, doc="doc")

    joined = budget.join(failed, "doc", "left")
    cannot = F.lit("no reviewer") if strict and reviewer is None else F.lit(None).cast("string")
    stopped = F.coalesce("error", "failure", cannot) if strict else F.lit(None).cast("string")
    done = F.lit(False) if mode == "rules" or reviewer is None else F.col("failure").isNull() & F.col("error").isNull() & (F.lit(strict) | (F.col("batches") > 0))
    state = joined.select("doc", F.lit(mode).alias("mode"), done.alias("reviewed"), stopped.isNull().alias("complete"), "characters", "batches", F.when(stopped.isNotNull(), F.col("characters")).otherwise(0).cast("long").alias("unreviewed"), F.coalesce(stopped, F.col("failure")).alias("error"), stopped.isNotNull().alias("scan_failed"))
    risk = security.assessments(found, state, doc="doc")
    return state.drop("scan_failed").join(risk, "doc").withColumnRenamed("doc", doc), found.withColumnRenamed("doc", doc)


def confirmed(reviews: DataFrame, shown: DataFrame) -> DataFrame:
    """Findings of a reviewer whose quote stands in the passage it was shown, sure enough; critical counts as high."""
    sure = reviews.filter((F.col("confidence") >= casework.SEMANTIC_CONFIDENCE) & (F.col("severity") != "none")).withColumn("quote", F.trim("quote"))
    inside = sure.join(shown.withColumnRenamed("passage", "__passage"), ["doc", "page", "n"]).filter((F.col("quote") != "") & F.contains("__passage", F.col("quote")))
    severity = F.when(F.col("severity") == "critical", "high").otherwise(F.col("severity"))
    return inside.select("doc", "page", F.col("page").alias("page_end"), F.lit("semantic_review").alias("rule_id"), "category", severity.alias("severity"), "confidence", F.substring("quote", 1, 1000).alias("quote"))

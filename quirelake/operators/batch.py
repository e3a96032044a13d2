"""Retrieval of whole batches: embedding with captured failures, all three modes, one trace a query; indexing chain."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, fingerprint
from . import chunking, lifecycle, retrieval, security

MODES = ("dense", "lexical", "hybrid")
#: A model: vectors of texts.  What it raises for a text becomes the error of that text's query.
Embedder = Callable[[list[str]], list[list[float]]]


def embedded(rows: DataFrame, embed: Embedder, *, key: str, text: str = "text", size: int | None = None) -> DataFrame:
    """(key, vector, error), one row each: a text that fails does not take its batch along.

    A batch that fails as a whole is tried again text by text.  Blank texts, vectors of
    another length than ``size`` and vectors with a missing or non-finite number are failures.
    """
    kind = rows.schema[key].dataType.simpleString()

    def one(text: str | None) -> tuple[list[float] | None, str | None]:
        if text is None or not text.strip():
            return None, "empty query"
        try:
            return checked(embed([text])[0])
        except Exception as e:  # whatever a model raises belongs to its row
            return None, f"{type(e).__name__}: {e}"

    def checked(vector: list[float]) -> tuple[list[float] | None, str | None]:
        vector = [float(x) for x in vector]
        if size is not None and len(vector) != size:
            return None, f"vector of {len(vector)} components, not {size}"
        return (vector, None) if vector and all(abs(x) < float("inf") for x in vector) else (None, "vector is not finite")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            good = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            try:
                vectors = embed([texts[i] for i in good])
                if len(vectors) != len(good):
                    raise ValueError("another number of vectors than texts")
                results = {i: checked(v) for i, v in zip(good, vectors, strict=True)}
            except Exception:  # find the texts it is due to
                results = {}
            pairs = [results.get(i) or one(t) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v for v, _ in pairs], pa.list_(pa.float64())), pa.array([e for _, e in pairs], pa.string())], names=[key, "vector", "error"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<double>, error string")


def retrieve_batch(chunks: DataFrame, queries: DataFrame, k: int, *, mode: str, embed: Embedder | None = None, chunk: str = "chunk_id", query: str = "query_id", text: str = "text", vector: str = "vector", scope: str | None = None, weights: tuple[float, float] = (1.0, 1.0), size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, traces) of all queries in one plan.

    ``chunks``: chunk, text, vector; ``queries``: query, text and, without ``embed``, vector.
    With ``scope``, a column of both, a query sees the chunks of its scope only.  Hits: query,
    chunk, score, rank.  Traces: query, status (found, empty or failed), hits, error; a query
    that fails keeps its siblings.  The lexical mode needs no vectors.
    """
    if mode not in MODES or k < 1:
        raise ValueError("mode must be dense, lexical or hybrid, and k positive")
    near = [scope] if scope else []
    wide = retrieval.widened(k, hybrid=mode == "hybrid", reranked=False)
    blank = F.coalesce(collapse(F.col(text)), F.lit("")) == ""
    if mode == "lexical":
        state = queries.select(query, F.lit(None).cast("array<double>").alias("vector"), F.when(blank, F.lit("empty query")).alias("error"))
    elif embed is not None:
        state = embedded(queries, embed, key=query, text=text, size=size)
    else:
        wrong = F.when(blank, "empty query").when(F.col(vector).isNull() | F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(False)), "vector is not finite")
        if size is not None:
            wrong = wrong.when(F.size(vector) != size, F.concat(F.lit("vector of "), F.size(vector).cast("string"), F.lit(f" components, not {size}")))
        state = queries.select(query, F.col(vector).cast("array<double>").alias("vector"), wrong.alias("error"))
    good = queries.select(query, text, *near).join(state.filter("error IS NULL").select(query, "vector"), query)

    rankings: list[tuple[DataFrame, float]] = []
    if mode != "lexical":
        rankings.append((retrieval.dense(chunks.select(chunk, vector, *near), good.select(query, F.col("vector").alias(vector), *near), wide, item=chunk, query=query, vector=vector, scope=scope), weights[0]))
    if mode != "dense":
        rankings.append((retrieval.bm25(chunks.select(chunk, text, *near), good.select(query, text, *near), wide, doc=chunk, query=query, text=text, scope=scope), weights[1]))
    hits = retrieval.rrf(rankings, k, query=query, item=chunk) if mode == "hybrid" else rankings[0][0].filter(F.col("rank") <= k)
    hits = hits.select(query, chunk, "score", "rank")
    return hits, lifecycle.batch_outcome(queries, hits, state.filter("error IS NOT NULL").select(query, "error"), query=query)


def all_or_raise(hits: DataFrame, traces: DataFrame, *, query: str = "query_id") -> DataFrame:
    """The hits, or an error that names the failed queries once their traces are there: at most ten are named."""
    failed = traces.filter("status = 'failed'").orderBy(query).limit(10).select(query, "error").collect()
    if failed:
        raise ValueError("retrieval failed for " + "; ".join(f"{r[0]}: {r[1]}" for r in failed))
    return hits


def effective_configuration(k: Column, *, mode: str, chunker: str, sanitizer: str, corpus: str, embedding: str, instruction: str | None = None, reranker: str | None = None, weights: tuple[float, float] = (1.0, 1.0), multiplier: int = 4) -> Column:
    """What a retrieval really used, as one struct; what a mode does not use is null."""
    if mode not in MODES:
        raise ValueError("mode must be dense, lexical or hybrid")
    hybrid = mode == "hybrid"
    only = lambda v, kind, used: F.lit(v if used else None).cast(kind)
    checked = F.when(k < 1, F.raise_error(F.lit("k must be positive")).cast("int")).otherwise(k.cast("int"))
    wide = checked * multiplier if hybrid or reranker else checked
    mark = fingerprint(*[F.lit(x) for x in (chunker, sanitizer, corpus, embedding)])
    return F.struct(
        F.lit(mode).alias("mode"), checked.alias("k"), wide.alias("candidates"), F.lit(multiplier).alias("multiplier"), F.lit(embedding).alias("embedding"),
        only(instruction, "string", True).alias("instruction"), F.sha2(only(instruction, "string", True), 256).alias("instruction_sha256"), mark["parts"].alias("index_version"),
        only(retrieval.RRF_CONSTANT, "int", hybrid).alias("rrf_constant"), only(weights[0], "double", hybrid).alias("dense_weight"), only(weights[1], "double", hybrid).alias("lexical_weight"), only(reranker, "string", True).alias("reranker"),
    )


def prepared(pages: DataFrame, *, doc: str = "doc_id", page: str = "page_no", text: str = "text", target: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of documents whose flagged passages are masked: doc, chunk_id, text, section, page_start, page_end."""
    rows = pages.select(doc, page, text)
    found = security.deduplicated(security.findings(rows, doc=doc, page=page, text=text).unionByName(security.hidden_findings(rows, doc=doc, page=page, text=text)), doc=doc)
    return chunking.chunks(security.masked(rows, found, doc=doc, text=text), target=target, overlap=overlap, doc=doc, page=page, text=text)


def index_documents(store: DataFrame, pages: DataFrame, embed: Embedder, *, doc: str = "doc_id", **options) -> DataFrame:
    """The store after the documents of ``pages`` were sanitised, cut into chunks, embedded and put in place of their old chunks.

    A document without text loses its chunks; a chunk that cannot be embedded is an error,
    before anything of the store is replaced.
    """
    chunks = prepared(pages, doc=doc, **options)
    vectors = embedded(chunks, embed, key="chunk_id")
    failed = F.raise_error(F.concat(F.lit("no vector for "), F.col("chunk_id"), F.lit(": "), F.col("error"))).cast("boolean")
    vectors = vectors.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(failed)).drop("error")
    return lifecycle.indexed(store, chunks, vectors, pages.select(doc), doc=doc)

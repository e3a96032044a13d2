"""Results of any shape: hits and conclusions out of JSON that differs from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bound
from ..functions.text import article_of_unit

#: Levels of objects and lists in which conclusions are looked for; deeper ones are an error.
MOST_LEVELS = 12


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _text(value: Column) -> Column:
    return F.when(~F.is_variant_null(value), F.try_variant_get(value, "$", "string"))


def hit(value: Column) -> Column:
    """A retrieval hit out of a variant: struct(provision_id, unit_id, score, status, error).

    A text is the id of a unit or article.  An object may have the fields itself, in its
    ``metadata``, or in its ``chunk`` and the metadata of that; the first place that names
    a field decides, also where its value is null.
    """

    def of_text(v: Column) -> Column:
        stable = F.lower(F.trim(F.try_variant_get(v, "$", "string"), F.lit(" \t\n\r")))
        return bound(stable, lambda s: made(article_of_unit(s), F.when(s != article_of_unit(s), s), F.lit(0.0), F.lit("unknown")))

    def of_object(v: Column) -> Column:
        within = lambda path: F.try_variant_get(v, path, "variant")
        own = F.when(within("$.metadata").isNotNull() & (_kind(within("$.metadata")) == "OBJECT") & (F.schema_of_variant(within("$.metadata")) != "OBJECT<>"), within("$.metadata")).otherwise(within("$.chunk.metadata"))
        pick = lambda name: F.coalesce(within(f"$.{name}"), F.try_variant_get(own, f"$.{name}", "variant"), within(f"$.chunk.{name}"))
        fields = F.struct(*[_text(pick(n)).alias(n) for n in ("provision_id", "unit_id", "chunk_id", "score", "status")])
        return bound(fields, of_fields)

    def of_fields(f: Column) -> Column:
        by_chunk = f["provision_id"].isNull() & F.startswith(f["chunk_id"], F.lit("br-"))
        provision = F.when(by_chunk, article_of_unit(f["chunk_id"])).otherwise(f["provision_id"])
        unit = F.when(by_chunk, f["chunk_id"]).otherwise(f["unit_id"])
        return made(provision, unit, F.coalesce(F.try_cast(f["score"], "double") if hasattr(F, "try_cast") else f["score"].try_cast("double"), F.lit(0.0)), F.coalesce(f["status"], F.lit("unknown")))

    def made(provision: Column, unit: Column, score: Column, status: Column) -> Column:
        error = F.when(provision.isNull(), F.lit("a hit needs a provision_id"))
        return F.struct(provision.alias("provision_id"), unit.cast("string").alias("unit_id"), score.alias("score"), status.alias("status"), error.alias("error"))

    none = F.lit(None).cast("string")
    return F.when(_kind(value) == "STRING", of_text(value)).when(_kind(value) == "OBJECT", of_object(value)).otherwise(made(none, none, F.lit(0.0), F.lit("unknown")))


def hits(rows: DataFrame, *, key: str, results: str) -> DataFrame:
    """One row a hit: the key, ``position`` from 1 and the fields of ``hit``.

    ``results`` is a column of JSON texts, each a list of hits of any shape; a text that is
    no list gives one row that says so in ``error``.
    """
    parsed = rows.select(key, F.try_parse_json(results).alias("v"))
    listed = F.when(_kind(F.col("v")) == "ARRAY", F.try_variant_get("v", "$", "array<variant>"))
    spread = parsed.select(key, listed.alias("list")).select(key, "list", F.posexplode_outer("list").alias("n", "value"))
    broken = F.struct(F.lit(None).cast("string").alias("provision_id"), F.lit(None).cast("string").alias("unit_id"), F.lit(0.0).alias("score"), F.lit("unknown").alias("status"), F.lit("no list of hits").alias("error"))
    found = F.when(F.col("list").isNull(), broken).otherwise(hit(F.col("value")))
    # An empty list has no hits and no error.
    kept = spread.filter(F.col("list").isNull() | F.col("n").isNotNull())
    return kept.select(key, (F.coalesce("n", F.lit(0)) + 1).alias("position"), found.alias("h")).select(key, "position", "h.*")


def _children(value: Column) -> Column:
    """Values inside an object (by key) or a list (in order)."""
    members = F.transform(F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))), lambda k: F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), k))
    none = F.array().cast("array<variant>")
    return F.when(_kind(value) == "OBJECT", members).when(_kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")).otherwise(none)


def conclusions(rows: DataFrame, *, key: str, document: str, levels: int = MOST_LEVELS) -> DataFrame:
    """(key, statement, confidence, citations) of all conclusions of a JSON text, however deep and wherever they stand.

    A conclusion is an object with a text ``statement`` and a number ``confidence``; the
    number of its citations is counted.  Every agent's or report's shape is walked the same way.
    """
    nodes = rows.select(key, F.array(F.try_parse_json(document)).alias("level"))
    is_one = lambda v: F.coalesce((_kind(v) == "OBJECT") & F.try_variant_get(v, "$.statement", "string").isNotNull() & F.try_variant_get(v, "$.confidence", "double").isNotNull(), F.lit(False))
    found = F.array().cast("array<variant>")
    level = F.filter(F.col("level"), lambda v: v.isNotNull())
    for _ in range(levels):
        nodes = nodes.withColumn("found", F.concat(F.col("found") if "found" in nodes.columns else found, F.filter(level, is_one)))
        nodes = nodes.withColumn("level", F.flatten(F.transform(level, _children)))
        level = F.filter(F.col("level"), lambda v: v.isNotNull() & _kind(v).isin("OBJECT", "ARRAY"))
    deeper = F.exists(level, lambda v: F.size(_children(v)) > 0)
    checked = F.when(deeper, F.raise_error(F.lit(f"more than {levels} levels")).cast("array<variant>")).otherwise(F.col("found"))
    each = nodes.select(key, F.explode(checked).alias("c"))
    cited = F.coalesce(F.size(F.try_variant_get("c", "$.citations", "array<variant>")), F.lit(0))
    return each.select(key, F.try_variant_get("c", "$.statement", "string").alias("statement"), F.try_variant_get("c", "$.confidence", "double").alias("confidence"), F.greatest(cited, F.lit(0)).alias("citations"))

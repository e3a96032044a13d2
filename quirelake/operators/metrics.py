"""Ranking metrics, standard and graded, with safety rates and group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown(score: Column, places: int = 3) -> Column:
    """A score as it is displayed; metrics themselves stay unrounded."""
    return F.format_number(score, places).cast("double")


def _ideal(gains: Column, k: int) -> Column:
    top = F.slice(F.sort_array(gains, asc=False), 1, k)
    return F.aggregate(F.zip_with(top, F.sequence(F.lit(1), F.greatest(F.size(top), F.lit(1))), lambda g, r: F.coalesce(g, F.lit(0.0)) / F.log2(r + 1.0)), F.lit(0.0), lambda a, x: a + x)


def ranking_metrics(ranking: DataFrame, groups: DataFrame, k: int, *, query: str = "query_id", item: str = "item") -> DataFrame:
    """Per query: precision, recall, hit_rate, mrr, ndcg at k.

    ``ranking``: query, item, rank.  ``groups``: query, grp, item; the items of a
    group are equivalent, and a rank is relevant if it is some group's first hit.
    A repeated item keeps its rank but is never relevant again.
    """
    first = ranking.filter(F.col("rank") <= k).groupBy(query, item).agg(F.min("rank").alias("rank"))
    hits = first.join(groups, [query, item]).groupBy(query, "grp").agg(F.min("rank").alias("rank"))
    per = hits.groupBy(query).agg(F.collect_set("rank").alias("ranks"), F.count("*").alias("found"))
    total = groups.groupBy(query).agg(F.count_distinct("grp").alias("wanted"))
    joined = total.join(per, query, "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    dcg = F.aggregate(F.array_sort("ranks"), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    return joined.select(
        query,
        (F.size("ranks") / F.lit(float(k))).alias("precision"),
        (F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"),
        (F.size("ranks") > 0).cast("double").alias("hit_rate"),
        F.coalesce(1.0 / F.array_min("ranks"), F.lit(0.0)).alias("mrr"),
        F.round(dcg / ideal, 9).alias("ndcg"),
    )


def unresolved(groups: DataFrame, known: DataFrame, *, query: str = "query_id", item: str = "item") -> DataFrame:
    """Groups none of whose items exist: judgments that must not be scored."""
    flagged = known.select(item).distinct().withColumn("__known", F.lit(1))
    return groups.join(flagged, item, "left").groupBy(query, "grp").agg(F.count("__known").alias("n")).filter("n = 0")


def graded_metrics(hits: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """Per case: recall, article_recall, mrr, ndcg, subdivision_precision, article_precision.

    ``hits``: case_id, rank, unit_id, article_id, status.  ``judgments``: case_id,
    article_id, unit_id or null, grade.  A judgment with a unit matches that unit,
    one without matches any unit of its article; a rank gains from new matches only.
    """
    unique = unique_hits(hits, k)
    j = judgments.withColumn("j", F.row_number().over(Window.partitionBy("case_id").orderBy("article_id", "unit_id", "grade")))
    match = (F.col("h.case_id") == F.col("j.case_id")) & F.when(F.col("j.unit_id").isNotNull(), F.col("h.unit_id") == F.col("j.unit_id")).otherwise(F.col("h.article_id") == F.col("j.article_id"))
    met = unique.alias("h").join(j.alias("j"), match).groupBy("j.case_id", "j.j", "j.grade").agg(F.min("h.rank").alias("rank"))
    gains = met.groupBy("case_id", "rank").agg(F.max("grade").alias("grade"), F.count("*").alias("n"))
    per = gains.groupBy("case_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("ranks"), F.min("rank").alias("first"), F.sum("n").alias("met"))
    articles = unique.join(judgments.select("case_id", "article_id").distinct(), ["case_id", "article_id"], "left_semi").groupBy("case_id").agg(F.count_distinct("article_id").alias("articles"))
    wanted = judgments.groupBy("case_id").agg(F.count("*").alias("wanted"), F.count_distinct("article_id").alias("wanted_articles"), F.collect_list(F.pow(F.lit(2.0), F.col("grade")) - 1).alias("ideal"))
    joined = wanted.join(per, "case_id", "left").join(articles, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "case_id",
        (zero("met") / F.col("wanted")).alias("recall"),
        (zero("articles") / F.col("wanted_articles")).alias("article_recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / _ideal(F.col("ideal"), k), 9).alias("ndcg"),
        (zero("ranks") / F.lit(float(k))).alias("subdivision_precision"),
        (zero("articles") / F.lit(float(k))).alias("article_precision"),
    )


def unique_hits(hits: DataFrame, k: int) -> DataFrame:
    """First occurrence of each unit in the first k ranks; ranks are not closed up."""
    w = Window.partitionBy("case_id", "unit_id").orderBy("rank")
    return hits.filter(F.col("rank") <= k).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


INACTIVE, UNKNOWN = ["revoked", "vetoed"], ["unknown"]


def safety_rates(hits: DataFrame, negatives: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Per case: hard_negative, inactive and unknown-status share of the unique hits (0 without hits)."""
    unique = unique_hits(hits, k).join(negatives.groupBy("case_id").agg(F.collect_set("negative_id").alias("negatives")), "case_id", "left")
    bad = F.exists(F.coalesce("negatives", F.array().cast("array<string>")), lambda n: (F.col("unit_id") == n) | (F.col("article_id") == n) | F.startswith(F.col("unit_id"), F.concat(n, F.lit("-"))))
    per = unique.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.col("status").isin(INACTIVE)).alias("inactive"), F.count_if(F.col("status").isNull() | F.col("status").isin(UNKNOWN)).alias("unknown"))
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(0.0))
    return cases.select("case_id").join(per, "case_id", "left").select("case_id", *[rate(c).alias(f"{name}_rate") for c, name in (("bad", "hard_negative"), ("inactive", "inactive"), ("unknown", "unknown_status"))])


def abstention(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """For cases without ground: 1 if nothing was returned, else 0."""
    n = hits.groupBy("case_id").agg(F.count("*").alias("n"))
    return cases.filter("no_applicable_ground").join(n, "case_id", "left").select("case_id", F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(0.0).alias("abstention"))


def failed_metrics(cases: DataFrame, names: list[tuple[str, bool]]) -> DataFrame:
    """Fail-closed rows for cases whose retrieval failed: the worst value of each metric."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(0.0 if higher else 1.0).alias("score"), F.lit("higher_is_better" if higher else "lower_is_better").alias("direction")) for n, higher in names])
    return cases.select("case_id", F.explode(rows).alias("m")).select("case_id", "m.*")


def summary(metrics: DataFrame) -> DataFrame:
    """Per metric name: mean score, number of cases; a name must have one direction."""
    checked = F.when(F.count_distinct("direction") > 1, F.raise_error(F.lit("a metric has two directions")).cast("double")).otherwise(F.avg("score"))
    return metrics.groupBy("name").agg(checked.alias("score"), F.count("*").alias("cases"))


def group_summary(cases: DataFrame, *, category: str, slices: str, value: str, failed: str) -> DataFrame:
    """Mean and failure rate by category and by each slice of a case."""
    tags = F.concat(F.array(F.struct(F.lit("category").alias("kind"), F.col(category).alias("grp"))), F.transform(slices, lambda s: F.struct(F.lit("slice").alias("kind"), s.alias("grp"))))
    return cases.select(F.explode(tags).alias("t"), value, failed).groupBy("t.kind", "t.grp").agg(F.count("*").alias("cases"), F.avg(value).alias("score"), F.avg(F.col(failed).cast("double")).alias("failure_rate"))

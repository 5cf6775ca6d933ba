"""Retrieval evaluation of many queries at once: per-query metrics, macro averages, negatives, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("hit", "rr", "ndcg", "ndcg_binary", "precision", "recall")


def score_queries(listed: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, hit, rr, ndcg, ndcg_binary, precision, recall) for every query that has gold rows.

    ``listed`` has query_id, row and a 0-based rank without repetitions; ``gold``
    query_id, row and grade (1 to 3).  A query without results scores 0.  Gains are 2^grade - 1, discounts
    log2(place + 1); the ideal list has the gold grades in falling order.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "row")
    wanted = gold.withColumn("place", F.row_number().over(order))
    cut = F.array(*[F.lit(k) for k in ks])
    gain = lambda grade: F.pow(F.lit(2.0), grade) - 1
    ideal = wanted.withColumn("k", F.explode(cut)).groupBy("query_id", "k").agg(
        F.count("*").alias("n_gold"),
        F.sum(F.when(F.col("place") <= F.col("k"), gain(F.col("grade")) / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"),
        F.sum(F.when(F.col("place") <= F.col("k"), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal_binary"),
    )
    found = listed.join(gold, ["query_id", "row"]).select("query_id", (F.col("rank") + 1).alias("at"), "grade", F.explode(cut).alias("k")).where("at <= k")
    got = found.groupBy("query_id", "k").agg(
        F.count("*").alias("n"), F.min("at").alias("first"),
        F.sum(gain(F.col("grade")) / F.log2(F.col("at") + 1)).alias("dcg"), F.sum(1 / F.log2(F.col("at") + 1)).alias("dcg_binary"),
    )
    each = ideal.join(got, ["query_id", "k"], "left")
    part = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 9)
    return each.select(
        "query_id", F.col("k").cast("long").alias("k"),
        part(F.col("n").isNotNull().cast("double")).alias("hit"), part(1 / F.col("first")).alias("rr"),
        part(F.col("dcg") / F.col("ideal")).alias("ndcg"), part(F.col("dcg_binary") / F.col("ideal_binary")).alias("ndcg_binary"),
        part(F.col("n") / F.col("k")).alias("precision"), part(F.col("n") / F.col("n_gold")).alias("recall"),
    )


def macro(scores: DataFrame, *keys: str) -> DataFrame:
    """(k, keys, n, metrics): plain means over queries, each query with the same weight."""
    return scores.groupBy("k", *keys).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def score_negatives(listed: DataFrame, negatives: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """One row per query that should find nothing: top1_score, leak, above_threshold_rate, foreign_gold, n_returned.

    ``foreign_gold``: its first row is a gold row of another query that can be answered; gold (query_id, row) of the
    query itself or of other negatives does not count.  Queries without results get zeros.
    """
    own = listed.join(negatives.select("query_id"), "query_id", "left_semi")
    # A row is foreign to a query if it is gold of two queries, or of one that is not the query itself.
    answered = gold.join(negatives.select("query_id"), "query_id", "left_anti").groupBy("row").agg(F.min("query_id").alias("one"), F.max("query_id").alias("other"))
    marked = own.join(answered, "row", "left").withColumn("is_gold", (F.col("one") != F.col("query_id")) | (F.col("other") != F.col("query_id")))
    first = F.col("rank") == 0
    each = marked.groupBy("query_id").agg(
        F.max(F.when(first, F.col("score"))).alias("top1_score"), F.avg((F.col("score") >= threshold).cast("double")).alias("above"),
        F.max(F.when(first & F.col("is_gold"), 1.0)).alias("foreign"), F.count("*").alias("n"),
    )
    full = negatives.select("query_id").join(each, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return full.select(
        "query_id", zero("top1_score").alias("top1_score"), (zero("top1_score") >= threshold).cast("double").alias("leak"),
        F.round(zero("above"), 9).alias("above_threshold_rate"), zero("foreign").alias("foreign_gold"), F.coalesce("n", F.lit(0)).cast("long").alias("n_returned"),
    )


def negative_summary(each: DataFrame) -> DataFrame:
    """Means of ``score_negatives`` and the 90th percentile (linear interpolation) of the first scores."""
    means = ("leak", "above_threshold_rate", "foreign_gold", "n_returned", "top1_score")
    return each.agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(f"mean_{m}") for m in means), F.round(F.percentile("top1_score", 0.9), 6).alias("p90_top1_score"))


def item_diff(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(query_id, rr_before, rr_after, verdict) of queries that both runs have."""
    a = before.where(F.col("k") == k).select("query_id", F.col("rr").alias("rr_before"))
    b = after.where(F.col("k") == k).select("query_id", F.col("rr").alias("rr_after"))
    verdict = F.when(F.col("rr_after") > F.col("rr_before"), "better").when(F.col("rr_after") < F.col("rr_before"), "worse").otherwise("same")
    return a.join(b, "query_id").withColumn("verdict", verdict)


def aggregate_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(k, metric, before, after, delta) over the union of both runs' metrics; a missing one counts as 0."""
    long = lambda df, name: df.unpivot(["k"], list(METRICS), "metric", name)
    both = long(before, "before").join(long(after, "after"), ["k", "metric"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("k", "metric", zero("before").alias("before"), zero("after").alias("after"), F.round(zero("after") - zero("before"), 6).alias("delta"))


def non_empty_rate(listed: DataFrame, queries: DataFrame) -> DataFrame:
    """(n_queries, n_empty, rate): how many queries have any result."""
    with_any = queries.select("query_id").join(listed.select("query_id").distinct().withColumn("any", F.lit(1)), "query_id", "left")
    return with_any.agg(F.count("*").alias("n_queries"), F.count_if(F.col("any").isNull()).alias("n_empty"), F.round(F.coalesce(F.avg(F.coalesce("any", F.lit(0))), F.lit(0.0)), 9).alias("rate"))


def upper_median(scores: DataFrame, group: str, value: str) -> DataFrame:
    """(group, base): of each group's n values in order the one at place n div 2, counted from 0; nulls do not count.

    Counts of values are combined before the shuffle. Right for groups of under 10^9 values.
    """
    return scores.groupBy(group).agg(F.expr(f"percentile_disc(0.500000001) WITHIN GROUP (ORDER BY {value})").alias("base"))

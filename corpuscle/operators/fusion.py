"""Fusing, re-scoring and cutting ranked lists; all of them by query_id, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_term(rank: Column, k: float, weight: float = 1.0) -> Column:
    """1 / (k + (rank + 1) / weight - 1) with a 0-based rank; weight 1 is the plain 1 / (k + rank)."""
    return 1.0 / (k + (rank + 1) / weight - 1)


def fuse(dense: DataFrame, sparse: DataFrame, k: float = 60, limit: int = 20, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(query_id, row, rrf, dense_rank, sparse_rank, path, rank): reciprocal rank fusion of two ranked lists.

    Ranks are 0-based, null where a path lacks the row; one union and one aggregation
    bring the paths together.  Ties go to the smaller row.
    """
    empty = F.lit(None).cast("long")
    both = dense.select("query_id", "row", F.col("rank").alias("d"), empty.alias("s")).unionByName(sparse.select("query_id", "row", empty.alias("d"), F.col("rank").alias("s")))
    ranks = both.groupBy("query_id", "row").agg(F.min("d").alias("dense_rank"), F.min("s").alias("sparse_rank"))
    score = F.coalesce(weighted_term(F.col("dense_rank"), k, weights[0]), F.lit(0.0)) + F.coalesce(weighted_term(F.col("sparse_rank"), k, weights[1]), F.lit(0.0))
    path = F.when(F.col("sparse_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "sparse").otherwise("both")
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "row")
    fused = ranks.withColumn("rrf", F.round(score, 9)).withColumn("path", path)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("rank", (F.col("rank") - 1).cast("long"))


def single_path(dense: DataFrame, sparse: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, row, score, rank, path) of queries that only one path answers: its own scores, unfused.

    Queries with both paths are left to ``fuse``; those with none do not appear.
    """
    both = dense.withColumn("path", F.lit("dense")).unionByName(sparse.withColumn("path", F.lit("sparse")))
    single = both.groupBy("query_id").agg(F.count_distinct("path").alias("n")).where("n = 1").select("query_id")
    return both.join(single, "query_id", "left_semi").where(F.col("rank") < limit)


def effective_k(top_k: int, fusion_k: int, dense_k: int, sparse_k: int) -> int:
    """How many results can come out at most; 0 stands for the default of 5."""
    return min(top_k or 5, fusion_k, dense_k + sparse_k)


def threshold_floor(scored: DataFrame, least_score: float, least_kept: int, top_k: int) -> DataFrame:
    """Rows of score ``least_score`` or more; if fewer than ``least_kept``, the first ones anyway; then the first ``top_k``.

    ``scored`` has query_id, row and score; ties go to the smaller row.  Null scores come last and
    never pass the threshold.  Adds the new 0-based ``rank``.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "row")
    passing = F.count_if(F.col("score") >= least_score).over(Window.partitionBy("query_id"))
    placed = scored.withColumns({"place": F.row_number().over(order), "passing": passing})
    kept = placed.where((F.col("score") >= least_score) | ((F.col("passing") < least_kept) & (F.col("place") <= least_kept)))
    return kept.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top_k).withColumn("rank", F.col("rank").cast("long")).drop("place", "passing")


def within_budget(listed: DataFrame, size: str, budget: int) -> DataFrame:
    """The longest prefix of each query's list (by ``rank``) whose sizes fit the budget, but always its first row.

    Adds ``used``, the running size.  As sizes are not negative, a row over the budget
    ends the list.
    """
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = listed.withColumn("used", F.sum(size).over(order).cast("long"))
    return used.where((F.col("rank") == 0) | (F.col("used") <= budget))


def first_occurrences(listed: DataFrame, key: str, k: int) -> DataFrame:
    """Each key once within the first ``k`` places of a query, renumbered from 0."""
    first = listed.where(F.col("rank") < k).groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).cast("long"))


def tie_bands(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, lo, hi): the 1-based places that the best gold row of a query may have among equal scores; null without one."""
    best = scored.join(gold.select("query_id", "row"), ["query_id", "row"], "left_semi").groupBy("query_id").agg(F.max("score").alias("best"))
    compared = scored.join(best, "query_id", "left")
    counted = compared.groupBy("query_id").agg(
        F.max("best").alias("best"), F.count_if(F.col("score") > F.col("best")).alias("above"), F.count_if(F.col("score") == F.col("best")).alias("level")
    )
    there = F.col("best").isNotNull()
    return counted.select("query_id", F.when(there, F.col("above") + 1).alias("lo"), F.when(there, F.col("above") + F.col("level")).alias("hi"))

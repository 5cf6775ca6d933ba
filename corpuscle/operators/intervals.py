"""Continuous periods and gaps of overlapping, nested and gapped intervals.

Starts and ends are sorted independently: with the k-th smallest start paired with
the k-th smallest end, a gap lies after rank r exactly where start r+1 lies beyond end r
and its next day.  Equal days are counted before anything is sorted, so an entity
brings at most one row per calendar day to its window, however many intervals it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.days import FOREVER, day_text, parse_day


def day_counts(intervals: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, day, starts, ends): intervals that start on a day, and that ended the day before."""
    edge = lambda day, starts, ends: F.struct(day.alias("day"), F.lit(starts).alias("s"), F.lit(ends).alias("e"))
    edges = intervals.select(
        F.col(key).alias("entity"),
        F.explode(F.array(edge(F.col(first).cast("long"), 1, 0), edge(F.col(last).cast("long") + 1, 0, 1))).alias("edge"),
    )
    return edges.groupBy("entity", F.col("edge.day").alias("day")).agg(F.sum("edge.s").alias("starts"), F.sum("edge.e").alias("ends"))


def periods_and_gaps(intervals: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Merge day-number intervals of each ``key`` into periods, and list the gaps.

    ``first`` and ``last`` are day numbers, both inclusive; rows with a null key or day,
    or with ``last`` before ``first``, are ignored.  Intervals that overlap, nest or follow
    on the next day form one period; repeated rows change only ``n_intervals``.  Returns
    (key, kind, first_day, last_day, n_intervals) with day numbers; gaps have 0 intervals.
    An empty input gives an empty result.
    """
    valid = intervals.where(F.col(key).isNotNull() & (F.col(first) <= F.col(last)))
    order = Window.partitionBy("entity").orderBy("day")
    open_after = day_counts(valid, key, first, last).select(
        "entity", "day", "starts", "ends",
        F.sum("starts").over(order).alias("begun"),
        F.sum("ends").over(order).alias("over"),
    )
    # A boundary: rank `over` of the ends equals the rank of the starts, before or after this day.
    opens = F.col("begun") - F.col("starts") == F.col("over") - F.col("ends")
    closes = F.col("begun") == F.col("over")
    bounds = open_after.where(opens != closes).select(
        "entity", "day",
        F.when(opens, "period").otherwise("gap").alias("kind"),
        F.lead("day").over(order).alias("next_day"),
        (F.lead("begun").over(order) - F.col("begun") + F.col("starts")).alias("n"),
    )
    return bounds.where(F.col("next_day").isNotNull()).select(
        F.col("entity").alias(key), "kind",
        F.col("day").alias("first_day"), (F.col("next_day") - 1).alias("last_day"),
        F.when(F.col("kind") == "period", F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_intervals"),
    )


def effective_intervals(chunks: DataFrame, key: str = "rule_no") -> DataFrame:
    """(key, first, last) of chunks whose written days make an interval that counts.

    Unreadable days count as absent.  A row without a first day, one that runs
    backwards, and a superseded row without a last day do not count; any other row
    without a last day is open until 9999-12-31.  Rows with a null key are left out.
    """
    days = chunks.select(F.col(key), "status", parse_day(F.col("effective_from")).alias("first"), parse_day(F.col("effective_to")).alias("until"))
    ends = F.coalesce("until", F.when(F.coalesce("status", F.lit("")) != "superseded", F.lit(FOREVER)))
    return days.select(key, "first", ends.alias("last")).where(F.col(key).isNotNull() & (F.col("first") <= F.col("last")))


def rule_periods(chunks: DataFrame, key: str = "rule_no") -> DataFrame:
    """(key, kind, first_day, last_day, n_intervals) of chunks, days as ``YYYY-MM-DD``."""
    found = periods_and_gaps(effective_intervals(chunks, key), key, "first", "last")
    return found.withColumns({"first_day": day_text(F.col("first_day")), "last_day": day_text(F.col("last_day"))})

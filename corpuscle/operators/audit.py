"""The log of an agent's calls: outcomes, repeated calls, latest records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outcomes(log: DataFrame) -> DataFrame:
    """(call_id, tool, actor, n_records, outcome): one row per call.

    Outcome: denied before failed before done, ``open`` where only the intent is known and
    ``orphan`` where the intent is missing.  Repeated records count once (by phase, ts and detail);
    records without call_id are left out.
    """
    once = log.where(F.col("call_id").isNotNull()).select("call_id", "ts", "phase", "tool", "actor", "ok", "detail").distinct()
    has = lambda phase: F.max(F.when(F.col("phase") == phase, 1).otherwise(0)) == 1
    each = once.groupBy("call_id").agg(
        F.min("tool").alias("tool"), F.min("actor").alias("actor"), F.count("*").alias("n_records"), has("intent").alias("asked"),
        has("result").alias("ended"), has("denied").alias("refused"), F.min(F.when(F.col("phase") == "result", F.coalesce("ok", F.lit(False)))).alias("good"),
    )
    outcome = (
        F.when(~F.col("asked"), "orphan").when(F.col("refused"), "denied").when(F.col("ended") & ~F.col("good"), "failed").when(F.col("ended"), "done").otherwise("open")
    )
    return each.select("call_id", "tool", "actor", "n_records", outcome.alias("outcome"))


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` records (1 to 1000) by time, then number."""
    return log.where(F.col("ts").isNotNull()).orderBy(F.desc("ts"), F.desc("rec_no")).limit(max(1, min(1000, n)))


def repeated_calls(log: DataFrame) -> DataFrame:
    """(rec_no, actor, tool, arg, nth): intents of an actor that ask the same tool for the same thing again, without case."""
    asked = log.where((F.col("phase") == "intent") & F.col("tool").isNotNull())
    order = Window.partitionBy("actor", F.lower("tool"), F.trim("arg")).orderBy("ts", "rec_no")
    return asked.withColumn("nth", F.row_number().over(order).cast("long")).where("nth > 1").select("rec_no", "actor", "tool", "arg", "nth")


def by_tool(log: DataFrame) -> DataFrame:
    """(tool, phase, n, n_actors) of the log's records, repeated ones counted once."""
    once = log.select("call_id", "ts", "phase", "tool", "actor", "detail").distinct()
    return once.groupBy("tool", "phase").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("n_actors"))

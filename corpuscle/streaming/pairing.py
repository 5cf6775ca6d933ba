"""The audit log as a stream: intents meet their results under a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscle.session import shared_dir

#: How late records may come, and within what time an outcome belongs to its intent.
LATE, WITHIN = "1 hour", "1 hour"


def log_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of a growing Parquet log, with ``at`` as their event time; unreadable times are left out.

    ``path`` is a folder or a pattern of files (a pattern also if it matches one file only).
    """
    return spark.readStream.schema(schema).parquet(path).withColumn("at", F.try_to_timestamp("ts")).where("at IS NOT NULL AND call_id IS NOT NULL")


def paired_calls(log: DataFrame, late: str = LATE, within: str = WITHIN) -> DataFrame:
    """(call_id, tool, seconds, outcome): each intent with every outcome that came up to ``within`` after it, repeated records once.

    Outcome is done, failed or denied; an intent that had none by the time that none can come any more (the
    watermark has passed it by ``within``) comes out as open, without seconds.
    """
    once = log.withWatermark("at", late).dropDuplicates(["call_id", "phase", "tool", "at", "ok"])
    intents = once.where("phase = 'intent'").select(F.col("call_id"), "tool", F.col("at").alias("asked_at"))
    ends = once.where("phase IN ('result', 'denied')").select(F.col("call_id").alias("result_of"), F.col("at").alias("ended_at"), "phase", "ok")
    near = (F.col("call_id") == F.col("result_of")) & (F.col("ended_at") >= F.col("asked_at")) & (F.col("ended_at") <= F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    outcome = F.when(F.col("result_of").isNull(), "open").when(F.col("phase") == "denied", "denied").when(F.coalesce("ok", F.lit(False)), "done").otherwise("failed")
    return intents.join(ends, near, "left_outer").select("call_id", "tool", (F.unix_timestamp("ended_at") - F.unix_timestamp("asked_at")).alias("seconds"), outcome.alias("outcome"))


def drain(paired: DataFrame) -> DataFrame:
    """Run a stream of paired calls over all that is there, and give one row per call: its least delay and its outcome.

    Denied comes before failed, failed before done, and open counts only if there is nothing else.
    """
    folder = f"{shared_dir(paired.sparkSession)}/corpuscle/{uuid.uuid4().hex}"
    query = paired.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/pairs")
    query.awaitTermination()
    pairs = paired.sparkSession.read.schema(paired.schema).parquet(f"{folder}/pairs")
    order = F.array_position(F.array(*map(F.lit, ("denied", "failed", "done", "open"))), F.col("outcome"))
    return pairs.groupBy("call_id", "tool").agg(F.min("seconds").alias("seconds"), F.min_by("outcome", order).alias("outcome"))

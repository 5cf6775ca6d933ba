"""Session helpers: shared working storage, size-checked broadcasts, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that `sized_broadcast` brings to the driver and sends to every executor.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and Spark runs on one machine (tests) a local
    folder is made and remembered in the session; on a cluster it must be set, else this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpuscle.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("corpuscle.shared.dir", folder)
    return folder


def plain_unions(spark: SparkSession) -> None:
    """Let unions forget how their sides are partitioned.

    Spark 4.1 otherwise pairs the sides' partitions one by one, and fails ("Can't zip RDDs
    with unequal numbers of partitions") where adaptive execution has merged the partitions of
    one side further than those of the other.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike a checkpoint the copy is columnar, so later readers take only the
    columns they need.  Its folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuscle/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else unchanged.

    The check fetches ``most + 1`` rows at the most, never the whole table; a larger
    table is left to a shuffled join.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


#: Rows of one key that one task joins; keys with more are dealt to several tasks.
KEY_ROWS = 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where a few keys may hold most rows of ``left``.

    Keys with over ``most`` rows of ``left`` are counted first (with map-side combining); the rows of such a key are dealt to several
    parts by their hash, and the rows of ``right`` are sent to each part.  ``how`` is inner or left_semi.
    """
    most = most or KEY_ROWS
    counts = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    parts = sized_broadcast(counts.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    names = [c for c in left.columns if c != key]
    dealt = left.join(parts, key, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*names), F.col("_parts"))).cast("int")).drop("_parts")
    sent = right.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(sent, [key, "_part"], how).drop("_part")

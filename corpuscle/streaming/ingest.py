"""Documents as a stream: every micro-batch replaces the chunks of the documents that it brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpuscle.operators.segment import chunk_documents
from corpuscle.operators.store import latest, replace_documents

#: Parts of the chunk table by the hash of doc_id; a batch writes the parts anew that its documents lie in, and no others.
BUCKETS = 64
_MANIFEST = "bucket int, batch long"


def bucket_of(doc: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")


def ingest_stream(documents: DataFrame, table: str, buckets: int = BUCKETS):
    """Start a query that keeps the chunk table at ``table`` up to date with a stream of (doc_id, doc_row, text, loaded_at).

    A batch writes the parts of the table (by hash of doc_id) that its documents lie in as they are after it, into a folder of its own, and then a
    manifest of those parts; the table is, for every part, what the newest manifest that has it says (see ``current``).
    A document that comes again loses all of its old chunks, also if it became blank.  Repeating a batch
    overwrites its own folders with the same content, and the query's state lies in ``table``, so a restarted query loses and doubles
    nothing.  The number of buckets must stay the same for a table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = latest(batch, ["doc_id"], F.desc_nulls_last("loaded_at"), F.desc("doc_row"))
        chunks = chunk_documents(newest, "doc_row", "text").join(newest.select("doc_row", "doc_id"), "doc_row").withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
        touched = newest.select(bucket_of(F.col("doc_id"), buckets).alias("bucket")).distinct()
        before = current(spark, table, number - 1)
        merged = chunks
        if before is not None:
            # At most ``buckets`` numbers are sent to the table's parts, of which the others are not read.
            kept = before.withColumn("bucket", bucket_of(F.col("doc_id"), buckets)).join(F.broadcast(touched), "bucket", "left_semi")
            merged = replace_documents(kept, chunks, reloaded=newest)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/batch={number}")
        touched.coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", f"{table}/_state").trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, batch: int | None = None) -> DataFrame | None:
    """The chunk table after a batch (the last one by default); null if nothing was written before.

    Parts are found by a join of the manifest (at most one row for each part and batch) with the folders' names, so only the newest version of each is read.
    """
    try:
        manifest = spark.read.schema(_MANIFEST).option("basePath", f"{table}/manifest").parquet(f"{table}/manifest")
    except AnalysisException:
        return None
    newest = manifest.where(F.lit(True) if batch is None else F.col("batch") <= batch).groupBy("bucket").agg(F.max("batch").alias("batch"))
    if not newest.limit(1).count():
        return None
    data = spark.read.option("basePath", f"{table}/data").parquet(f"{table}/data")
    return data.join(F.broadcast(newest), ["bucket", "batch"]).drop("bucket", "batch")

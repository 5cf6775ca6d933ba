"""The chunk table: incremental ingest, upserts, deletions, status changes and listings.

All changes are plans from the old to the new state of a table; nothing is updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.ids import content_hash
from corpuscle.functions.status import is_superseded, plain_status


def latest(df: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row for each key: the first in the given order.  Null keys count as one key."""
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """Incoming rows (the newest of each key) and the existing rows whose key did not come."""
    new = latest(incoming, keys, *newest_first)
    same = reduce(lambda a, b: a & b, (F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    return existing.alias("e").join(new.select(*keys).alias("n"), same, "left_anti").unionByName(new)


def replace_documents(existing: DataFrame, incoming: DataFrame, doc: str = "doc_id", reloaded: DataFrame | None = None) -> DataFrame:
    """Incoming documents take the place of all rows of the same documents, so shrunken ones leave nothing behind.

    ``reloaded`` lists the documents that came (by ``doc``); one that became blank has no incoming rows and loses all of its old ones.
    """
    came = incoming if reloaded is None else reloaded
    return existing.join(came.select(doc).distinct(), doc, "left_anti").unionByName(incoming)


def delete_documents(existing: DataFrame, gone: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of all documents but those listed."""
    return existing.join(gone.select(doc).distinct(), doc, "left_anti")


def document_state(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(doc_id, state): new, unchanged or changed, by the multiset of (chunk_index, hash) of each document.

    ``stored`` and ``incoming`` have doc_id, chunk_index and h.  The same content under another
    document does not make a document unchanged, and a removed or repeated chunk changes it.
    """
    side = lambda df, n: df.select("doc_id", "chunk_index", "h", F.lit(n).alias("d"))
    pieces = side(stored, -1).unionByName(side(incoming, 1)).groupBy("doc_id", "chunk_index", "h").agg(F.sum("d").alias("d"), F.max("d").alias("in"), F.min("d").alias("was"))
    each = pieces.groupBy("doc_id").agg(F.max("in").alias("in"), F.min("was").alias("was"), F.max(F.abs("d")).alias("d"))
    state = F.when(F.col("was") > 0, "new").when(F.col("d") == 0, "unchanged").otherwise("changed")
    return each.where(F.col("in") > 0).select("doc_id", state.alias("state"))


def hash_state(text: str = "text", stored: str = "content_hash") -> Column:
    """ok, missing or stale: whether the stored hash is that of the text."""
    return F.when(F.col(stored).isNull(), "missing").when(F.col(stored).eqNullSafe(content_hash(F.col(text))), "ok").otherwise("stale")


def list_documents(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, status, mixed, doc_version, title): superseded if any chunk is, version and title of the first chunk that has one."""
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("chunk_index", "chunk_row")))
    superseded = is_superseded(F.col("status"))
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.when(F.max(superseded), "superseded").otherwise("current").alias("status"),
        (F.max(superseded) != F.min(superseded)).alias("mixed"), first("doc_version").alias("doc_version"), first("title").alias("title"),
    )


def mark_superseded(chunks: DataFrame, marked: DataFrame, reason: str) -> DataFrame:
    """Chunks of the marked documents become superseded and remember their status; documents of mixed status are denied.

    Adds previous_status, superseded_reason and outcome (marked, unchanged, denied, or null for other documents).
    A document that is superseded already stays as it is.
    """
    known = list_documents(chunks).join(marked.select("doc_id").distinct(), "doc_id", "left_semi")
    outcome = F.when(F.col("mixed"), "denied").when(F.col("status") == "superseded", "unchanged").otherwise("marked")
    out = chunks.join(known.select("doc_id", outcome.alias("outcome")), "doc_id", "left")
    hit = F.coalesce(F.col("outcome") == "marked", F.lit(False))
    return out.withColumns({
        "previous_status": F.when(hit, plain_status(F.col("status"))), "superseded_reason": F.when(hit, F.lit(reason)),
        "status": F.when(hit, "superseded").otherwise(F.col("status")),
    })


def restore(chunks: DataFrame, restored: DataFrame) -> DataFrame:
    """Marked chunks of the given documents get their previous status (current if unknown) back."""
    wanted = chunks.join(restored.select("doc_id").distinct().withColumn("_back", F.lit(True)), "doc_id", "left")
    hit = F.coalesce(F.col("_back"), F.lit(False)) & is_superseded(F.col("status"))
    return wanted.withColumns({
        "status": F.when(hit, F.coalesce("previous_status", F.lit("current"))).otherwise(F.col("status")),
        "previous_status": F.when(~hit, F.col("previous_status")), "superseded_reason": F.when(~hit, F.col("superseded_reason")),
    }).drop("_back")


def set_payload(chunks: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Chunks with new values of some fields.

    ``changes`` has doc_id, chunk_index (null: all chunks of the document) and the fields; a null value leaves the field as it is, a change of one
    chunk comes before one of its whole document, and of several changes the greatest value counts.  Documents and chunks that are not
    listed stay as they are.  Adds ``n_set``, the number of fields that were set.
    """
    greatest = [F.max(f).alias(f) for f in fields]
    renamed = lambda df, mark: df.select(*(F.col(c).alias(f"{mark}{c}" if c in fields else c) for c in df.columns))
    whole = renamed(changes.where("chunk_index IS NULL").groupBy("doc_id").agg(*greatest), "_d_")
    single = renamed(changes.where("chunk_index IS NOT NULL").groupBy("doc_id", "chunk_index").agg(*greatest), "_c_")
    both = chunks.join(whole, "doc_id", "left").join(single, ["doc_id", "chunk_index"], "left")
    new = {f: F.coalesce(f"_c_{f}", f"_d_{f}") for f in fields}
    count = sum((F.when(value.isNotNull(), 1).otherwise(0) for value in new.values()), F.lit(0)).cast("long")
    out = both.withColumn("n_set", count)
    for f, value in new.items():
        out = out.withColumn(f, F.coalesce(value, F.col(f)))
    return out.select(*chunks.columns, "n_set")


def backfill_status(chunks: DataFrame) -> DataFrame:
    """Missing or empty statuses become current; others stay as written."""
    return chunks.withColumn("status", F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("current")))


def fetch_chunks(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Chunks of exact (doc_id, chunk_index) keys; repeated keys bring a chunk once."""
    return chunks.join(keys.select("doc_id", "chunk_index").distinct(), ["doc_id", "chunk_index"], "left_semi")

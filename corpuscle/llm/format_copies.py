"""Duplicates hidden by formatting: one record per reduced text, with its number of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.canonical import reduced_text
from corpuscle.session import shared_table, sized_broadcast

#: Groups with over this share of all rows (and over HOT_ROWS) are joined by broadcast: fewer than 1 / HOT_SHARE exist.
HOT_SHARE = 0.001
HOT_ROWS = 10_000


def fingerprints(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, h, check): 128-bit hash of the reduced text, and an independent 64-bit check of it.

    Rows whose text is null or reduces to nothing have no fingerprint.
    """
    reduced = df.select(F.col(row).cast("long").alias("row"), reduced_text(F.col(text)).alias("reduced")).where("reduced <> ''")
    return reduced.select("row", F.unhex(F.md5("reduced")).alias("h"), F.xxhash64("reduced", F.length("reduced")).alias("check"))


def collapse_copies(marks: DataFrame) -> DataFrame:
    """(h, check, first_row, n_copies) of fingerprints: one record for each distinct reduced text.

    Counts are combined before the shuffle, so a group that holds a third of all rows
    arrives as one row per task.  The check is part of the key: two texts whose 128-bit
    hashes collide stay two records (``hash_collisions`` lists them).  Repeated rows count
    as copies; no rows give no records.
    """
    return marks.groupBy("h", "check").agg(F.min("row").alias("first_row"), F.count("*").alias("n_copies"))


def hash_collisions(groups: DataFrame) -> DataFrame:
    """(h, n_texts) of 128-bit hashes that more than one reduced text has."""
    return groups.groupBy("h").agg(F.count("*").alias("n_texts")).where("n_texts > 1")


def join_groups(marks: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``marks`` with the columns of their group; ``groups`` has ``h``, ``check`` and ``n_copies``.

    Hot groups (see HOT_SHARE; their number has that bound) meet their rows by broadcast,
    so that no task gets all rows of a hot group; the rest is shuffled by the hash.
    """
    is_hot = F.col("n_copies") > max(HOT_ROWS, int(total * HOT_SHARE))
    key = ["h", "check"]
    hot = sized_broadcast(groups.where(is_hot), int(1 / HOT_SHARE))
    cold = marks.join(hot.select(*key), key, "left_anti").join(groups.where(~is_hot), key)
    return cold.unionByName(marks.join(hot, key))


def format_copies(df: DataFrame, row: str, text: str) -> DataFrame:
    """(first_row, copy_row): each row but the first of its group, with the group's first (smallest) row.

    Rows with null, blank or mark-only texts belong to no group.  If ``row`` is not unique,
    its repetitions equal to the first row are left out.
    """
    marks = shared_table(fingerprints(df, row, text))
    many = collapse_copies(marks).where("n_copies > 1")
    pairs = join_groups(marks, many, marks.count()).where("row <> first_row")
    return pairs.select("first_row", F.col("row").alias("copy_row"))


def collapsed_records(df: DataFrame, row: str, text: str) -> DataFrame:
    """(first_row, n_copies): one record per distinct reduced text, with how many rows have it."""
    return collapse_copies(fingerprints(df, row, text)).select("first_row", "n_copies")

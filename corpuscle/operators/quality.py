"""Checks on question sets and on runs: counts, warnings, fingerprints, settings without effect, saturation, misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses of an item, known types, the length of a snippet, the least length of a question.
STATUSES = ("keep", "draft", "drop")
TYPES = ("single_hop", "multi_hop", "lexical", "semantic", "ambiguous", "contextual", "negative")
SNIPPET_CHARS, QUESTION_CHARS = 30, 4
#: Shares of hits from which a cut is saturated, and up to which it is near zero.
SATURATED, NEAR_ZERO = 0.99, 0.05


def selected(items: DataFrame, drafts: bool = False) -> DataFrame:
    """Items that are scored: those to keep, with the drafts if asked."""
    return items.where(F.col("status").isin("keep", "draft") if drafts else F.col("status") == "keep")


def is_negative(items_expected: str = "expected") -> Column:
    """Whether an item expects nothing."""
    return F.coalesce(F.size(items_expected), F.lit(0)) <= 0


def question_counts(items: DataFrame) -> DataFrame:
    """(kind, name, n): items of each status (0 for the known ones without any), kept items of each type, distinct files and the greatest chunk index of kept gold."""
    spark = items.sparkSession
    zeros = spark.createDataFrame([("status", s, 0) for s in STATUSES], "kind string, name string, n long")
    status = items.select(F.lit("status").alias("kind"), F.col("status").alias("name"), F.lit(1).cast("long").alias("n")).unionByName(zeros)
    types = selected(items).select(F.lit("type").alias("kind"), F.col("type").alias("name"), F.lit(1).cast("long").alias("n"))
    gold = selected(items).select(F.explode("expected").alias("g")).agg(F.count_distinct("g.file").alias("files"), F.coalesce(F.max("g.chunk_index"), F.lit(-1)).cast("long").alias("max_chunk_index"))
    counted = status.unionByName(types).groupBy("kind", "name").agg(F.sum("n").alias("n"))
    return counted.unionByName(gold.unpivot([], ["files", "max_chunk_index"], "name", "n").select(F.lit("gold").alias("kind"), "name", "n"))


def question_warnings(items: DataFrame) -> DataFrame:
    """(id, warning): what does not fail a question set, but should be seen.

    Unfinished drafts (nothing expected, but not of type negative); and, of kept items, unknown types, short questions, gold rows without a snippet
    or with one of over twice the usual length.  A warning appears once for each gold row that it is about.
    """
    unfinished = items.where((F.col("status") == "draft") & is_negative() & ~F.col("type").eqNullSafe("negative")).select("id", F.lit("unfinished draft").alias("warning"))
    kept = selected(items)
    own = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "unknown type"),
        F.when(F.coalesce(F.length("question"), F.lit(0)) < QUESTION_CHARS, "short question"),
    ))
    gold = kept.select("id", F.explode("expected").alias("g"))
    size = F.coalesce(F.length("g.snippet"), F.lit(0))
    about = gold.select("id", F.when(size == 0, "gold without snippet").when(size > 2 * SNIPPET_CHARS, "long snippet").alias("warning")).where("warning IS NOT NULL")
    return unfinished.unionByName(kept.select("id", F.explode(own).alias("warning"))).unionByName(about)


def combined_hash(written: Column) -> Column:
    """An aggregate that tells sets of texts apart, whatever their order: the exclusive or of 60 bits of each one's SHA-1."""
    return F.bit_xor(F.conv(F.substring(F.sha1(written.cast("binary")), 1, 15), 16, 10).cast("long"))


def set_fingerprint(items: DataFrame) -> DataFrame:
    """(n, fingerprint) of the kept items; neither their order nor items that are not kept change it, nor a grade of 1 that is written out."""
    gold = F.transform("expected", lambda g: F.concat_ws("|", g["file"], g["chunk_index"].cast("string"), F.when(g["grade"] != 1, g["grade"].cast("string")), g["snippet"]))
    written = F.concat_ws("\n", "id", "question", "type", F.array_join(F.coalesce(gold, F.array().cast("array<string>")), "\n"))
    return selected(items).agg(F.count("*").alias("n"), combined_hash(written).alias("fingerprint"))


def same_runs(ranked: DataFrame, settings: DataFrame) -> DataFrame:
    """(run, same_as): runs whose lists are equal row by row to those of an earlier run with other settings: a setting without effect.

    ``ranked`` has run, query_id, row and rank, ``settings`` run and settings.  Runs are compared by a combined hash of their rows.
    """
    prints = ranked.groupBy("run").agg(F.count("*").alias("n"), combined_hash(F.concat_ws("|", F.col("query_id").cast("string"), F.col("row").cast("string"), F.col("rank").cast("string"))).alias("h"))
    known = prints.join(settings, "run")
    first = known.groupBy("n", "h").agg(F.min(F.struct("run", "settings")).alias("f"))
    return known.join(first, ["n", "h"]).where((F.col("run") != F.col("f.run")) & (F.col("settings") != F.col("f.settings"))).select("run", F.col("f.run").alias("same_as"))


def same_aggregates(one: DataFrame, other: DataFrame, metrics: list[str]) -> DataFrame:
    """(k, same): whether two runs' means are equal to the last bit; a cut that only one has is not."""
    both = one.select("k", "n", *metrics).join(other.select("k", *(F.col(c).alias(f"o_{c}") for c in ("n", *metrics))), "k", "full")
    same = F.lit(True)
    for c in ("n", *metrics):
        same = same & F.coalesce(F.col(c) == F.col(f"o_{c}"), F.lit(False))
    return both.select("k", same.alias("same"))


def saturation(means: DataFrame) -> DataFrame:
    """(k, hit, note) of macro means: ``too easy`` or ``near zero`` at the least cut, ``saturated`` at a deeper one, else ``telling``."""
    marked = means.withColumn("head", F.min("k").over(Window.partitionBy()))  # one row for each cut
    note = (
        F.when((F.col("k") == F.col("head")) & (F.col("hit") >= SATURATED), "too easy").when((F.col("k") == F.col("head")) & (F.col("hit") <= NEAR_ZERO), "near zero")
        .when(F.col("hit") >= SATURATED, "saturated").otherwise("telling")
    )
    return marked.select("k", "hit", note.alias("note"))


def misses(listed: DataFrame, kept: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, best_rank, n_returned, n_dropped): answerable queries whose best gold row is missing or behind the first ``k``.

    ``listed`` are all candidates with a 0-based rank, ``kept`` (query_id, row) those that a threshold left; ``n_dropped`` says how many gold
    rows were found but cut by it, which is another fault than not finding them.
    """
    wanted = gold.select("query_id", "row").distinct()
    left = kept.select("query_id", "row").withColumn("left", F.lit(True))
    each = listed.select("query_id", "row", "rank").join(left, ["query_id", "row"], "left").join(wanted.withColumn("gold", F.lit(True)), ["query_id", "row"], "left")
    order = each.groupBy("query_id").agg(
        F.min(F.when(F.col("gold") & F.col("left"), F.col("rank") + 1)).alias("best_rank"), F.count("left").alias("n_returned"), F.count_if(F.col("gold") & F.col("left").isNull()).alias("n_dropped"),
    )
    full = wanted.select("query_id").distinct().join(order, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.where(F.col("best_rank").isNull() | (F.col("best_rank") > k)).select("query_id", F.col("best_rank").cast("long").alias("best_rank"), zero("n_returned"), zero("n_dropped"))

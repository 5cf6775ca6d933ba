"""Queries on question sets and runs: counts, warnings, fingerprints, settings without effect, saturation, misses.

The question set is made from the asking chunks: their title is the question, the visible chunks of their document are its gold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.status import visible
from corpuscle.operators import evaluate, fusion, quality
from corpuscle.plans import retrieval
from corpuscle.session import shared_table
from corpuscle.sources.tables import table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """(id, question, type, status, expected): dropped where the chunk is superseded, a draft without a known version."""
    chunks = table(spark, folder, "chunks")
    about = chunks.select(F.col("chunk_row").alias("row"), F.struct(F.col("source").alias("file"), "chunk_index", F.substring("text", 1, quality.SNIPPET_CHARS).alias("snippet")).alias("c"))
    gold = retrieval._visible_gold(spark, folder).join(about, "row")
    listed = gold.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("c.file", "c.chunk_index", "grade", "c.snippet"))).alias("expected"))
    status = F.when(~visible(F.col("status")), "drop").when(F.coalesce("doc_version", F.lit("")) == "", "draft").otherwise("keep")
    kind = F.when(F.col("doc_version") == "v1", "lexical").when(F.col("doc_version") == "v2", "semantic").otherwise("other")
    asked = chunks.where(retrieval.ASKED).join(listed, F.col("chunk_row") == F.col("query_id"), "left")
    return asked.select(F.concat(F.lit("q"), F.col("chunk_row").cast("string")).alias("id"), F.col("title").alias("question"), kind.alias("type"), status.alias("status"), "expected")


def question_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.question_counts(_items(spark, folder))


def question_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return quality.question_warnings(_items(spark, folder)).groupBy("id", "warning").agg(F.count("*").alias("n"))


def question_views(spark: SparkSession, folder: str) -> DataFrame:
    """Kept items and those with drafts, by whether they expect anything."""
    items = _items(spark, folder)
    each = [quality.selected(items, drafts).select(F.lit(name).alias("view"), quality.is_negative().alias("negative")) for name, drafts in (("kept", False), ("with_drafts", True))]
    return reduce(DataFrame.unionByName, each).groupBy("view", "negative").agg(F.count("*").alias("n"))


def set_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return quality.set_fingerprint(_items(spark, folder))


def same_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Four ways of fusing the same two searches; equal weights are the plain fusion under another name."""
    seen = table(spark, folder, "chunks").where(visible(F.col("status")))
    dense, sparse = (shared_table(path(spark, folder, retrieval.PATH_K, seen)) for path in (retrieval._dense, retrieval._sparse))
    runs = {"plain": (60, (1.0, 1.0)), "weighted": (60, (1.0, 1.0)), "steep": (2, (1.0, 1.0)), "dense_first": (60, (2.0, 1.0))}
    lists = [fusion.fuse(dense, sparse, k, retrieval.FUSED_K, w).select(F.lit(name).alias("run"), "query_id", "row", "rank") for name, (k, w) in runs.items()]
    settings = spark.createDataFrame([(name, name) for name in runs], "run string, settings string")
    return quality.same_runs(reduce(DataFrame.unionByName, lists), settings)


def saturation(spark: SparkSession, folder: str) -> DataFrame:
    return quality.saturation(retrieval.macro_scores(spark, folder))


def same_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """The dense search against the fusion, at every cut that either has."""
    gold = retrieval._gold(spark, folder)
    dense = evaluate.macro(evaluate.score_queries(retrieval._dense(spark, folder, 10), gold, [1, 5, 10]))
    return quality.same_aggregates(dense, retrieval.macro_scores(spark, folder), list(evaluate.METRICS))


def misses(spark: SparkSession, folder: str) -> DataFrame:
    """Queries whose gold is not among the first five fused candidates of a cosine of 0.5 or more."""
    listed = shared_table(retrieval._hybrid(spark, folder).select("query_id", "row", "rank"))
    chunks = table(spark, folder, "chunks")
    queries = chunks.where(retrieval.ASKED).select(F.col("chunk_row").alias("query_id"), F.col("dense").alias("vector"))
    from corpuscle.operators import search

    scored = search.cosines(listed.select("query_id", "row"), queries, chunks.select(F.col("chunk_row").alias("row"), F.col("dense").alias("vector")), retrieval.WIDTH)
    return quality.misses(listed, scored.where("score >= 0.5"), retrieval._visible_gold(spark, folder), 5)


NAMES = "question_counts question_warnings question_views set_fingerprint same_runs saturation same_aggregates misses".split()
QUERIES = {name: globals()[name] for name in NAMES}

_SEEN_GOLD = f"""{retrieval._GOLD}, seen_gold AS (SELECT gold.* FROM gold JOIN chunks ON chunk_row = "row" WHERE coalesce(status, '') <> 'superseded')"""
_ITEMS = f"""WITH {_SEEN_GOLD}, golds AS (SELECT query_id, source AS file, chunk_index, grade, left(text, 30) AS snippet FROM seen_gold JOIN chunks ON chunk_row = "row"),
items AS (SELECT 'q' || chunk_row AS id, chunk_row, title AS question, CASE doc_version WHEN 'v1' THEN 'lexical' WHEN 'v2' THEN 'semantic' ELSE 'other' END AS type,
  CASE WHEN coalesce(status, '') = 'superseded' THEN 'drop' WHEN coalesce(doc_version, '') = '' THEN 'draft' ELSE 'keep' END AS status FROM chunks WHERE chunk_row % 100 = 0),
kept AS (SELECT * FROM items WHERE status = 'keep'), kept_gold AS (SELECT id, golds.* FROM golds JOIN kept ON chunk_row = query_id)"""
_RUNS = f"""{retrieval._BASE}, runs AS (SELECT 'plain' AS run, * FROM fused UNION ALL SELECT 'weighted', * FROM ({retrieval._fuse(60, 1, 1)}) UNION ALL SELECT 'steep', * FROM ({retrieval._fuse(2)}) UNION ALL SELECT 'dense_first', * FROM ({retrieval._fuse(60, 2, 1)})),
lists AS (SELECT run, list((query_id, "row", "rank") ORDER BY query_id, "rank") AS l FROM runs GROUP BY run)"""
ORACLES = {
    "question_counts": f"""{_ITEMS} SELECT 'status' AS kind, s AS name, count(id) AS n FROM (SELECT unnest(['keep', 'draft', 'drop']) AS s) LEFT JOIN items ON status = s GROUP BY ALL
      UNION ALL SELECT 'type', type, count(*) FROM kept GROUP BY ALL UNION ALL SELECT 'gold', 'files', count(DISTINCT file) FROM kept_gold UNION ALL SELECT 'gold', 'max_chunk_index', coalesce(max(chunk_index), -1) FROM kept_gold""",
    "question_warnings": f"""{_ITEMS} SELECT id, warning, count(*) AS n FROM (SELECT id, 'unfinished draft' AS warning FROM items WHERE status = 'draft' AND chunk_row NOT IN (SELECT query_id FROM golds)
      UNION ALL SELECT id, 'unknown type' FROM kept WHERE type = 'other' UNION ALL SELECT id, 'short question' FROM kept WHERE coalesce(length(question), 0) < 4
      UNION ALL SELECT id, 'gold without snippet' FROM kept_gold WHERE coalesce(snippet, '') = '') GROUP BY ALL""",
    "question_views": f"""{_ITEMS} SELECT 'kept' AS "view", chunk_row NOT IN (SELECT query_id FROM golds) AS negative, count(*) AS n FROM kept GROUP BY ALL
      UNION ALL SELECT 'with_drafts', chunk_row NOT IN (SELECT query_id FROM golds), count(*) FROM items WHERE status <> 'drop' GROUP BY ALL""",
    "set_fingerprint": f"""{_ITEMS}, written AS (SELECT id, string_agg(concat_ws('|', file, chunk_index, CASE WHEN grade <> 1 THEN grade END, snippet), chr(10) ORDER BY encode(file), chunk_index, grade, encode(snippet) NULLS FIRST) AS g FROM kept_gold GROUP BY ALL)
      SELECT count(*) AS n, bit_xor(CAST('0x' || left(sha1(concat_ws(chr(10), k.id, question, type, coalesce(g, ''))), 15) AS BIGINT)) AS fingerprint FROM kept k LEFT JOIN written USING (id)""",
    "same_runs": f"{_RUNS} SELECT a.run, min(b.run) AS same_as FROM lists a JOIN lists b ON a.l = b.l AND b.run < a.run GROUP BY a.run",
    "saturation": f"""{retrieval._BASE}, {retrieval._GOLD}, {retrieval._ALL}, m AS (SELECT k, round(avg(hit), 6) AS hit FROM scored GROUP BY k)
      SELECT k, hit, CASE WHEN k = 1 AND hit >= 0.99 THEN 'too easy' WHEN k = 1 AND hit <= 0.05 THEN 'near zero' WHEN hit >= 0.99 THEN 'saturated' ELSE 'telling' END AS note FROM m""",
    "same_aggregates": f"""{retrieval._BASE}, {retrieval._GOLD}, {retrieval._ALL}, {retrieval._scores('d10', '[1, 5, 10]', 'plain')}, a AS (SELECT k, {retrieval._MEANS} FROM plain GROUP BY k), b AS (SELECT k, {retrieval._MEANS} FROM scored GROUP BY k)
      SELECT k, coalesce({' AND '.join(f'a.{c} = b.{c}' for c in ('n', *evaluate.METRICS))}, false) AS same FROM a FULL JOIN b USING (k)""",
    "misses": f"""{retrieval._BASE}, {_SEEN_GOLD}, l AS (SELECT f.query_id, f."row", f."rank", coalesce(c.score, 0) >= 0.5 AS stays FROM fused f LEFT JOIN cosines c USING (query_id, "row")),
      e AS (SELECT query_id, min(CASE WHEN stays AND g."row" IS NOT NULL THEN "rank" + 1 END) AS best_rank, count(*) FILTER (stays) AS n_returned, count(*) FILTER (NOT stays AND g."row" IS NOT NULL) AS n_dropped
        FROM l LEFT JOIN (SELECT DISTINCT query_id, "row" FROM seen_gold) g USING (query_id, "row") GROUP BY query_id)
      SELECT query_id, best_rank, coalesce(n_returned, 0) AS n_returned, coalesce(n_dropped, 0) AS n_dropped FROM (SELECT DISTINCT query_id FROM seen_gold) LEFT JOIN e USING (query_id) WHERE best_rank IS NULL OR best_rank > 5""",
}

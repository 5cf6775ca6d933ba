"""Queries of the retrieval paths, their fusion, cuts and evaluation.

The query set is every chunk whose row number is divisible by 100, asked against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.models import embed, rerank_score
from corpuscle.functions.status import visible
from corpuscle.functions.text import citation, clip, embed_text
from corpuscle.functions.vectors import norm
from corpuscle.operators import evaluate, fusion, search
from corpuscle.session import shared_table
from corpuscle.sources.tables import table

WIDTH, PATH_K, FUSED_K, FINAL_K = 64, 50, 20, 5
ASKED = "chunk_row % 100 = 0"


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


def _dense(spark: SparkSession, folder: str, k: int, seen: DataFrame | None = None) -> DataFrame:
    chunks = _chunks(spark, folder)
    corpus = chunks if seen is None else seen
    return search.dense_topk(
        chunks.where(ASKED).select(F.col("chunk_row").alias("query_id"), F.col("dense").alias("vector")),
        corpus.select(F.col("chunk_row").alias("row"), F.col("dense").alias("vector")), k, WIDTH, skip_self=True,
    )


def _sparse(spark: SparkSession, folder: str, k: int, seen: DataFrame | None = None) -> DataFrame:
    chunks = _chunks(spark, folder)
    corpus = chunks if seen is None else seen
    return search.sparse_topk(
        chunks.where(ASKED).select(F.col("chunk_row").alias("query_id"), F.col("sparse").alias("weights")),
        corpus.select(F.col("chunk_row").alias("row"), F.col("sparse").alias("weights")), k, skip_self=True,
    )


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, 10)


def sparse_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _sparse(spark, folder, 10)


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The titles of the asking chunks against the texts of all."""
    chunks = _chunks(spark, folder)
    corpus = chunks.where("text IS NOT NULL").select(F.col("chunk_row").alias("row"), search.terms(F.col("text")).alias("terms"), F.length("text").alias("length"))
    queries = chunks.where(ASKED).where("title IS NOT NULL").select(F.col("chunk_row").alias("query_id"), search.terms(F.col("title")).alias("terms"))
    return search.bm25_topk(queries, corpus, 10, skip_self=True)


def filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, 10, _chunks(spark, folder).where(visible(F.col("status"))))


def _hybrid(spark: SparkSession, folder: str, k: float = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    seen = _chunks(spark, folder).where(visible(F.col("status")))
    return fusion.fuse(_dense(spark, folder, PATH_K, seen), _sparse(spark, folder, PATH_K, seen), k, FUSED_K, weights)


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder)


def single_path(spark: SparkSession, folder: str) -> DataFrame:
    seen = _chunks(spark, folder).where(visible(F.col("status")))
    return fusion.single_path(_dense(spark, folder, PATH_K, seen), _sparse(spark, folder, PATH_K, seen))


def weighted_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, weights=(2.0, 1.0))


def rrf_k2_vs_k60(spark: SparkSession, folder: str) -> DataFrame:
    """Both fusions from one search of each path."""
    seen = _chunks(spark, folder).where(visible(F.col("status")))
    dense, sparse = (shared_table(path(spark, folder, PATH_K, seen)) for path in (_dense, _sparse))
    rank = lambda k, name: fusion.fuse(dense, sparse, k, FUSED_K).select("query_id", "row", F.col("rank").alias(name))
    return rank(2, "rank_k2").join(rank(60, "rank_k60"), ["query_id", "row"], "full")


def path_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("n_queries"))


def _rescored(spark: SparkSession, folder: str) -> DataFrame:
    """Fused candidates with a second score: the exact cosine of every one, 0 only where a vector is unusable."""
    fused, chunks = _hybrid(spark, folder).select("query_id", "row"), _chunks(spark, folder)
    queries = chunks.where(ASKED).select(F.col("chunk_row").alias("query_id"), F.col("dense").alias("vector"))
    return search.cosines(fused, queries, chunks.select(F.col("chunk_row").alias("row"), F.col("dense").alias("vector")), WIDTH)


def rerank_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.threshold_floor(_rescored(spark, folder), 0.9, 1, FINAL_K)


def threshold_floor(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.threshold_floor(_rescored(spark, folder), 0.97, 2, FINAL_K)


def rerank_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """Fused candidates re-scored by the default scorer on the texts, cut at a threshold with a floor of one."""
    texts = _chunks(spark, folder).select(F.col("chunk_row").alias("row"), "text")
    pairs = _hybrid(spark, folder).select("query_id", "row").join(texts, "row").join(texts.select(F.col("row").alias("query_id"), F.col("text").alias("asked")), "query_id")
    scored = pairs.select("query_id", "row", F.round(rerank_score(F.col("asked"), F.col("text")), 9).alias("score"))
    return fusion.threshold_floor(scored, 0.3, 1, FINAL_K)


def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Size and norm of what the default embedder makes of each chunk with its context."""
    made = _chunks(spark, folder).select("chunk_row", embed(embed_text(F.col("text"), F.col("context"))).alias("e"))
    return made.select("chunk_row", F.size("e.sparse").cast("long").alias("n_features"), F.round(norm(F.col("e.dense")), 5).alias("norm"))


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _chunks(spark, folder).select(F.col("chunk_row").alias("row"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    listed = _hybrid(spark, folder).select("query_id", "row", "rank").join(sizes, "row")
    return fusion.within_budget(listed, "size", 1500)


def format_hits(spark: SparkSession, folder: str) -> DataFrame:
    top = _hybrid(spark, folder).where(F.col("rank") < FINAL_K).select("query_id", "row", "rank")
    chunks = _chunks(spark, folder).select(F.col("chunk_row").alias("row"), "text", citation(F.col("title"), F.col("source"), F.col("doc_id"), F.col("chunk_index")).alias("cited"))
    line = F.concat_ws(" ", F.concat((F.col("rank") + 1).cast("string"), F.lit(".")), "cited", clip(F.coalesce("text", F.lit("")), 80))
    listed = top.join(chunks, "row").select("query_id", F.struct("rank", line.alias("line")).alias("l"))
    return listed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["line"]), "\n").alias("shown"))  # noqa: E741


def window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _chunks(spark, folder).select(F.col("chunk_row").alias("row"), "doc_id")
    return fusion.first_occurrences(_hybrid(spark, folder).join(docs, "row"), "doc_id", 10)


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows of a query: the other chunks of its document; grade 2 for its neighbours, else 1."""
    keys = _chunks(spark, folder).select("chunk_row", "doc_id", "chunk_index")
    asked = keys.where(ASKED).select(F.col("chunk_row").alias("query_id"), "doc_id", F.col("chunk_index").alias("own"))
    others = asked.join(keys, "doc_id").where("chunk_row <> query_id")
    return others.select("query_id", F.col("chunk_row").alias("row"), F.when(F.abs(F.col("chunk_index") - F.col("own")) <= 1, 2).otherwise(1).alias("grade"))


def score_queries(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.score_queries(_hybrid(spark, folder), _gold(spark, folder), [1, 3, 5, 10])


def macro_scores(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.macro(score_queries(spark, folder))


def macro_by_type(spark: SparkSession, folder: str) -> DataFrame:
    kinds = _chunks(spark, folder).select(F.col("chunk_row").alias("query_id"), F.coalesce("doc_version", F.lit("none")).alias("type"))
    return evaluate.macro(score_queries(spark, folder).join(kinds, "query_id"), "type")


def item_diff(spark: SparkSession, folder: str) -> DataFrame:
    dense = evaluate.score_queries(_dense(spark, folder, 10), _gold(spark, folder), [10])
    return evaluate.item_diff(dense, score_queries(spark, folder), 10)


def aggregate_diff(spark: SparkSession, folder: str) -> DataFrame:
    dense = evaluate.score_queries(_dense(spark, folder, 10), _gold(spark, folder), [1, 5, 10])
    return evaluate.aggregate_diff(evaluate.macro(dense), macro_scores(spark, folder))


def tie_bands(spark: SparkSession, folder: str) -> DataFrame:
    coarse = _dense(spark, folder, PATH_K).select("query_id", "row", F.round("score", 1).alias("score"))
    return fusion.tie_bands(coarse, _gold(spark, folder))


def _visible_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows that the visible collection has."""
    seen = _chunks(spark, folder).where(visible(F.col("status"))).select(F.col("chunk_row").alias("row"))
    return _gold(spark, folder).join(seen, "row", "left_semi")


def score_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Negatives are the asking chunks to whose document the visible collection has nothing else."""
    gold = _visible_gold(spark, folder)
    asked = _chunks(spark, folder).where(ASKED).select(F.col("chunk_row").alias("query_id"))
    negatives = asked.join(gold.select("query_id").distinct(), "query_id", "left_anti")
    return evaluate.score_negatives(_dense(spark, folder, 10), negatives, gold, 0.95)


def negative_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.negative_summary(score_negatives(spark, folder))


def negative_strength(spark: SparkSession, folder: str) -> DataFrame:
    first = shared_table(_sparse(spark, folder, 1).select("query_id", "score", F.lit("all").alias("g")))
    both = first.join(evaluate.upper_median(first, "g", "score"), "g")
    return both.select("query_id", "score", "base", (F.col("score") >= F.col("base") * 0.8).alias("flagged"))


def non_empty(spark: SparkSession, folder: str) -> DataFrame:
    queries = _chunks(spark, folder).where(ASKED).select(F.col("chunk_row").alias("query_id"))
    return evaluate.non_empty_rate(_sparse(spark, folder, 1), queries)


NAMES = (
    "dense_topk sparse_topk bm25_topk filtered_topk hybrid_rrf single_path weighted_rrf rrf_k2_vs_k60 path_shares rerank_threshold rerank_lexical threshold_floor embed_chunks context_budget format_hits "
    "window_dedup score_queries macro_scores macro_by_type item_diff aggregate_diff tie_bands score_negatives negative_summary negative_strength non_empty"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_UNITS = """
units AS (SELECT chunk_row, coalesce(status, '') <> 'superseded' AS seen, list_transform(dense, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks
  WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
cosines AS (SELECT q.chunk_row AS query_id, c.chunk_row AS "row", c.seen, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)), 9) AS score
  FROM units q JOIN units c ON c.chunk_row <> q.chunk_row WHERE q.chunk_row % 100 = 0),
tokens AS (SELECT chunk_row, coalesce(status, '') <> 'superseded' AS seen, unnest(map_entries(sparse)) AS e FROM chunks),
products AS (SELECT q.chunk_row AS query_id, c.chunk_row AS "row", c.seen, round(sum(CAST(q.e.value AS DOUBLE) * CAST(c.e.value AS DOUBLE)), 9) AS score
  FROM tokens q JOIN tokens c ON c.e.key = q.e.key AND c.chunk_row <> q.chunk_row WHERE q.chunk_row % 100 = 0 AND q.e.value > 0 AND c.e.value > 0 GROUP BY ALL)
"""


def _rank(source: str, k: int, seen: str = "true") -> str:
    return f'SELECT query_id, "row", score, n - 1 AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "row") AS n FROM {source} WHERE {seen}) WHERE n <= {k}'


def _fuse(k: float = 60, dense: float = 1, sparse: float = 1) -> str:
    term = lambda c, w: f"coalesce(1 / ({k} + ({c} + 1) / {w:.1f} - 1), 0)"
    return f"""SELECT query_id, "row", rrf, dense_rank, sparse_rank, path, n - 1 AS "rank" FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, "row") AS n FROM (
        SELECT query_id, "row", round({term('d."rank"', dense)} + {term('s."rank"', sparse)}, 9) AS rrf, d."rank" AS dense_rank, s."rank" AS sparse_rank,
          CASE WHEN s."rank" IS NULL THEN 'dense' WHEN d."rank" IS NULL THEN 'sparse' ELSE 'both' END AS path
        FROM d50 d FULL JOIN s50 s USING (query_id, "row"))) WHERE n <= 20"""


_BASE = f"""WITH {_UNITS}, d10 AS ({_rank('cosines', 10)}), d50 AS ({_rank('cosines', 50, 'seen')}), s50 AS ({_rank('products', 50, 'seen')}), fused AS ({_fuse()})"""
_GOLD = """gold AS (SELECT q.chunk_row AS query_id, c.chunk_row AS "row", CASE WHEN abs(c.chunk_index - q.chunk_index) <= 1 THEN 2 ELSE 1 END AS grade
  FROM chunks q JOIN chunks c ON c.doc_id = q.doc_id AND c.chunk_row <> q.chunk_row WHERE q.chunk_row % 100 = 0)"""
_RESCORED = """rescored AS (SELECT f.query_id, f."row", coalesce(d.score, 0) AS score FROM fused f LEFT JOIN cosines d USING (query_id, "row"))"""


def _scores(listed: str, ks: str, name: str) -> str:
    return f"""{name} AS (SELECT i.query_id, i.k, CAST(coalesce(CASE WHEN n > 0 THEN 1 END, 0) AS DOUBLE) AS hit, round(coalesce(1 / first, 0), 9) AS rr, round(coalesce(dcg / ideal, 0), 9) AS ndcg,
        round(coalesce(dcgb / idealb, 0), 9) AS ndcg_binary, round(coalesce(n / i.k, 0), 9) AS precision, round(coalesce(n / n_gold, 0), 9) AS recall
      FROM (SELECT query_id, k, count(*) AS n_gold, sum(CASE WHEN p <= k THEN (pow(2, grade) - 1) / log2(p + 1) ELSE 0 END) AS ideal, sum(CASE WHEN p <= k THEN 1 / log2(p + 1) ELSE 0 END) AS idealb
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, "row") AS p FROM gold), (SELECT CAST(unnest({ks}) AS BIGINT) AS k) GROUP BY ALL) i
      LEFT JOIN (SELECT query_id, k, count(*) AS n, min("rank" + 1) AS first, sum((pow(2, grade) - 1) / log2("rank" + 2)) AS dcg, sum(1 / log2("rank" + 2)) AS dcgb
            FROM {listed} JOIN gold USING (query_id, "row"), (SELECT CAST(unnest({ks}) AS BIGINT) AS k) WHERE "rank" < k GROUP BY ALL) f USING (query_id, k))"""


_MEANS = "count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.METRICS)
_ALL = _scores("fused", "[1, 3, 5, 10]", "scored")
_FLOOR = """SELECT query_id, "row", score, r - 1 AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "row") AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "row") AS p, count(*) FILTER (score >= {t}) OVER (PARTITION BY query_id) AS c FROM rescored)
  WHERE score >= {t} OR (c < {k} AND p <= {k})) WHERE r <= 5"""
_NEGATIVES = """seen_gold AS (SELECT gold.* FROM gold JOIN chunks ON chunk_row = "row" WHERE coalesce(status, '') <> 'superseded'),
  negatives AS (SELECT c.chunk_row AS query_id, coalesce(max(CASE WHEN "rank" = 0 THEN score END), 0) AS top1_score, CASE WHEN coalesce(max(CASE WHEN "rank" = 0 THEN score END), 0) >= 0.95 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS leak,
  round(coalesce(avg(CASE WHEN score >= 0.95 THEN 1.0 WHEN score IS NOT NULL THEN 0.0 END), 0), 9) AS above_threshold_rate,
  CASE WHEN max(CASE WHEN "rank" = 0 AND EXISTS (SELECT 1 FROM seen_gold g WHERE g."row" = d10."row" AND g.query_id <> c.chunk_row) THEN 1 END) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS foreign_gold, count("row") AS n_returned
  FROM chunks c LEFT JOIN d10 ON d10.query_id = c.chunk_row WHERE c.chunk_row % 100 = 0 AND c.chunk_row NOT IN (SELECT query_id FROM seen_gold) GROUP BY ALL)"""

ORACLES = {
    "dense_topk": f"{_BASE} SELECT * FROM d10",
    "sparse_topk": f"{_BASE} {_rank('products', 10)}",
    "bm25_topk": f"""WITH written AS (SELECT chunk_row, 'text' AS kind, text AS w, length(text) AS len FROM chunks UNION ALL SELECT chunk_row, 'title', title, 0 FROM chunks WHERE chunk_row % 100 = 0),
      parts AS (SELECT chunk_row, kind, len, unnest(regexp_extract_all(regexp_replace(lower(w), '([{search.HAN}]+)', ' \\1 ', 'g'), '[\\pL\\pN]+')) AS w FROM written),
      every AS (SELECT chunk_row, kind, len, unnest(CASE WHEN regexp_matches(w, '^[{search.HAN}]{{2}}') THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END) AS term FROM parts),
      words AS (SELECT * FROM every WHERE kind = 'text'), asked AS (SELECT DISTINCT chunk_row, term FROM every WHERE kind = 'title'),
      tf AS (SELECT chunk_row, len, term, count(*) AS tf FROM words GROUP BY ALL), n AS (SELECT count(DISTINCT chunk_row) AS n FROM words), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      bm AS (SELECT q.chunk_row AS query_id, c.chunk_row AS "row", round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * c.tf * 2.5 / (c.tf + 1.5 * (0.25 + 0.75 * c.len / 512))), 9) AS score
        FROM asked q JOIN tf c ON q.term = c.term AND q.chunk_row <> c.chunk_row JOIN df ON df.term = q.term, n GROUP BY ALL) {_rank('bm', 10)}""",
    "filtered_topk": f"{_BASE} {_rank('cosines', 10, 'seen')}",
    "hybrid_rrf": f"{_BASE} SELECT * FROM fused",
    "single_path": f"""{_BASE}, every AS (SELECT *, 'dense' AS path FROM d50 UNION ALL SELECT *, 'sparse' FROM s50) SELECT query_id, "row", score, "rank", path FROM every
      WHERE "rank" < 20 AND query_id IN (SELECT query_id FROM every GROUP BY query_id HAVING count(DISTINCT path) = 1)""",
    "weighted_rrf": f"{_BASE} {_fuse(60, 2, 1)}",
    "rrf_k2_vs_k60": f'{_BASE}, two AS ({_fuse(2)}) SELECT query_id, "row", t."rank" AS rank_k2, f."rank" AS rank_k60 FROM two t FULL JOIN fused f USING (query_id, "row")',
    "path_shares": f"{_BASE} SELECT path, count(*) AS n, count(DISTINCT query_id) AS n_queries FROM fused GROUP BY path",
    "rerank_threshold": f"{_BASE}, {_RESCORED} {_FLOOR.format(t=0.9, k=1)}",
    "threshold_floor": f"{_BASE}, {_RESCORED} {_FLOOR.format(t=0.97, k=2)}",
    "context_budget": f"""{_BASE} SELECT * FROM (SELECT query_id, "row", "rank", size, CAST(sum(size) OVER (PARTITION BY query_id ORDER BY "rank") AS BIGINT) AS used
      FROM fused JOIN (SELECT chunk_row AS "row", coalesce(length(text), 0) AS size FROM chunks) USING ("row")) WHERE "rank" = 0 OR used <= 1500""",
    "format_hits": f"""{_BASE} SELECT query_id, string_agg(("rank" + 1) || '. ' || coalesce(nullif(title, ''), nullif(source, ''), doc_id) || ' (块 ' || chunk_index || ') ' ||
      CASE WHEN length(text) > 80 THEN left(text, 80) || '…（省略 ' || (length(text) - 80) || ' 字）' ELSE coalesce(text, '') END, chr(10) ORDER BY "rank") AS shown
      FROM fused JOIN chunks ON chunk_row = "row" WHERE "rank" < 5 GROUP BY query_id""",
    "window_dedup": f"""{_BASE} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS "rank" FROM (
      SELECT query_id, doc_id, min("rank") AS r FROM fused JOIN chunks ON chunk_row = "row" WHERE "rank" < 10 GROUP BY ALL)""",
    "score_queries": f"{_BASE}, {_GOLD}, {_ALL} SELECT * FROM scored",
    "macro_scores": f"{_BASE}, {_GOLD}, {_ALL} SELECT k, {_MEANS} FROM scored GROUP BY k",
    "macro_by_type": f"{_BASE}, {_GOLD}, {_ALL} SELECT k, coalesce(doc_version, 'none') AS type, {_MEANS} FROM scored JOIN chunks ON chunk_row = query_id GROUP BY ALL",
    "item_diff": f"""{_BASE}, {_GOLD}, {_ALL}, {_scores('d10', '[10]', 'plain')} SELECT query_id, p.rr AS rr_before, s.rr AS rr_after,
      CASE WHEN s.rr > p.rr THEN 'better' WHEN s.rr < p.rr THEN 'worse' ELSE 'same' END AS verdict FROM plain p JOIN scored s USING (query_id, k)""",
    "aggregate_diff": f"""{_BASE}, {_GOLD}, {_ALL}, {_scores('d10', '[1, 5, 10]', 'plain')}, a AS (SELECT k, {_MEANS} FROM plain GROUP BY k), b AS (SELECT k, {_MEANS} FROM scored GROUP BY k),
      la AS (UNPIVOT (SELECT * EXCLUDE n FROM a) ON * EXCLUDE k INTO NAME metric VALUE x), lb AS (UNPIVOT (SELECT * EXCLUDE n FROM b) ON * EXCLUDE k INTO NAME metric VALUE y)
      SELECT k, metric, coalesce(x, 0) AS before, coalesce(y, 0) AS after, round(coalesce(y, 0) - coalesce(x, 0), 6) AS delta FROM la FULL JOIN lb USING (k, metric)""",
    "tie_bands": f"""{_BASE}, {_GOLD}, t AS (SELECT query_id, "row", round(score, 1) AS score FROM ({_rank('cosines', 50)})),
      b AS (SELECT query_id, max(score) AS best FROM t SEMI JOIN gold USING (query_id, "row") GROUP BY ALL)
      SELECT query_id, CASE WHEN max(best) IS NOT NULL THEN count(*) FILTER (score > best) + 1 END AS lo, CASE WHEN max(best) IS NOT NULL THEN count(*) FILTER (score >= best) END AS hi
      FROM t LEFT JOIN b USING (query_id) GROUP BY query_id""",
    "score_negatives": f"{_BASE}, {_GOLD}, {_NEGATIVES} SELECT * FROM negatives",
    "negative_summary": f"""{_BASE}, {_GOLD}, {_NEGATIVES} SELECT count(*) AS n, round(avg(leak), 6) AS mean_leak, round(avg(above_threshold_rate), 6) AS mean_above_threshold_rate,
      round(avg(foreign_gold), 6) AS mean_foreign_gold, round(avg(n_returned), 6) AS mean_n_returned, round(avg(top1_score), 6) AS mean_top1_score,
      round(quantile_cont(top1_score, 0.9), 6) AS p90_top1_score FROM negatives""",
    "negative_strength": f"""{_BASE}, t AS ({_rank('products', 1)}), m AS (SELECT list_sort(list(score))[len(list(score)) // 2 + 1] AS base FROM t)
      SELECT query_id, score, base, score >= base * 0.8 AS flagged FROM t, m""",
    "non_empty": f"""{_BASE}, t AS ({_rank('products', 1)}) SELECT count(*) AS n_queries, count(*) FILTER (q IS NULL) AS n_empty, round(avg(CASE WHEN q IS NULL THEN 0 ELSE 1 END), 9) AS rate
      FROM chunks LEFT JOIN (SELECT DISTINCT query_id AS q FROM t) ON q = chunk_row WHERE chunk_row % 100 = 0""",
}

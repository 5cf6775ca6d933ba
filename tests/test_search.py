"""Search, fusion and evaluation on hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import evaluate, fusion, search
from corpuscle.plans import retrieval


def test_dense_topk_ties_and_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [3.0, 0.0])]
    corpus = spark.createDataFrame(rows, "row long, vector array<float>")
    queries = corpus.where("row in (1, 3, 4, 5)").withColumnRenamed("row", "query_id")
    got = {(r.query_id, r["row"]): (r.score, r.rank) for r in search.dense_topk(queries, corpus, 2, 2, skip_self=True).collect()}
    assert got == {(1, 2): (1.0, 0), (1, 8): (1.0, 1), (3, 1): (0.0, 0), (3, 2): (0.0, 1)}
    assert search.dense_topk(queries.limit(0), corpus, 2, 2).count() == 0
    assert search.dense_topk(queries, corpus.limit(0), 2, 2).count() == 0


def test_query_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, [math.sin(i), math.cos(i * 1.7), math.sin(i * 0.3)]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "row long, vector array<float>")
    queries = corpus.withColumnRenamed("row", "query_id")
    whole = sorted(search.dense_topk(queries, corpus, 3, 3).collect())
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert sorted(search.dense_topk(queries, corpus, 3, 3).collect()) == whole


def test_sparse_and_bm25(spark):
    corpus = spark.createDataFrame([(1, {1: 0.5, 2: 1.0}), (2, {2: 2.0, 3: -1.0}), (3, None), (4, {3: 1.0})], "row long, weights map<int,float>")
    queries = spark.createDataFrame([(9, {2: 1.0, 3: 1.0})], "query_id long, weights map<int,float>")
    assert [(r["row"], r.score, r.rank) for r in search.sparse_topk(queries, corpus, 5).orderBy("rank").collect()] == [(2, 2.0, 0), (1, 1.0, 1), (4, 1.0, 2)]
    docs = spark.createDataFrame([(1, ["a", "b", "a"], 3), (2, ["b"], 1), (3, [], 0)], "row long, terms array<string>, length int")
    asked = spark.createDataFrame([(9, ["a", "a", "z"])], "query_id long, terms array<string>")
    (hit,) = search.bm25_topk(asked, docs, 5).collect()
    expected = math.log(1 + 1.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 512))
    assert (hit["row"], hit.rank) == (1, 0) and hit.score == pytest.approx(expected, abs=1e-8)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, row long, score double, rank long")


def test_fusion_and_weights(spark):
    dense, sparse = ranked(spark, [(1, 10, 0.9, 0), (1, 11, 0.8, 1)]), ranked(spark, [(1, 11, 3.0, 0), (1, 12, 2.0, 1)])
    got = {r["row"]: r for r in fusion.fuse(dense, sparse).collect()}
    assert got[11].rrf == pytest.approx(1 / 61 + 1 / 60, abs=1e-9) and got[11].rank == 0 and got[11].path == "both"
    assert got[10].sparse_rank is None and got[12].dense_rank is None
    heavy = {r["row"]: r.rrf for r in fusion.fuse(dense, sparse, weights=(2.0, 1.0)).collect()}
    assert heavy[10] == pytest.approx(1 / (60 + 1 / 2 - 1), abs=1e-9)
    assert fusion.effective_k(0, 20, 50, 50) == 5 and fusion.effective_k(30, 20, 8, 8) == 16


def test_unions_of_unevenly_merged_sides(spark):
    many = spark.range(20_000).select((F.col("id") % 50).alias("query_id"), F.col("id").alias("row"), F.rand(1).alias("score"))
    few = many.where("query_id = 7")
    dense, sparse = search.ranked(many, 30, "row"), search.ranked(few, 30, "row")
    alone = fusion.single_path(dense, sparse)
    assert alone.select("query_id").distinct().count() == 49 and alone.where("path = 'sparse'").count() == 0
    assert fusion.fuse(dense, sparse).select("query_id").distinct().count() == 50


def test_threshold_floor_budget_and_dedup(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.2), (1, 3, 0.2), (2, 4, 0.1), (2, 5, None), (2, 6, 0.1)], "query_id long, row long, score double")
    kept = {(r.query_id, r["row"], r.rank) for r in fusion.threshold_floor(scored, 0.5, 2, 5).collect()}
    assert kept == {(1, 1, 0), (1, 2, 1), (2, 4, 0), (2, 6, 1)}
    listed = spark.createDataFrame([(1, 0, 900), (1, 1, 200), (1, 2, 10), (2, 0, 5000), (2, 1, 1)], "query_id long, rank long, size long")
    assert {(r.query_id, r.rank) for r in fusion.within_budget(listed, "size", 1000).collect()} == {(1, 0), (2, 0)}
    names = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id long, rank long, key string")
    assert {(r.key, r.rank) for r in fusion.first_occurrences(names, "key", 3).collect()} == {("a", 0), ("b", 1)}


def test_tie_bands(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.1), (2, 5, 0.3)], "query_id long, row long, score double")
    gold = spark.createDataFrame([(1, 3), (1, 4)], "query_id long, row long")
    assert {tuple(r) for r in fusion.tie_bands(scored, gold).collect()} == {(1, 2, 3), (2, None, None)}


def test_metrics_by_hand(spark):
    listed = ranked(spark, [(1, 2, 0.9, 0), (1, 1, 0.8, 1), (1, 3, 0.7, 2)])
    gold = spark.createDataFrame([(1, 1, 3), (1, 9, 1), (2, 7, 1)], "query_id long, row long, grade int")
    got = {(r.query_id, r.k): r for r in evaluate.score_queries(listed, gold, [1, 3]).collect()}
    one = got[(1, 3)]
    ideal = 7 / 1 + 1 / math.log2(3)
    assert (one.hit, one.rr, one.precision, one.recall) == (1.0, 0.5, pytest.approx(1 / 3, abs=1e-9), 0.5)
    assert one.ndcg == pytest.approx(7 / math.log2(3) / ideal, abs=1e-8)
    assert got[(1, 1)].hit == 0.0 and got[(2, 3)].ndcg == 0.0
    (mean,) = evaluate.macro(evaluate.score_queries(listed, gold, [3])).collect()
    assert mean.n == 2 and mean.hit == 0.5


def test_negatives_and_differences(spark):
    listed = ranked(spark, [(5, 1, 0.97, 0), (5, 2, 0.5, 1), (6, 3, 0.2, 0)])
    negatives = spark.createDataFrame([(5,), (6,), (7,)], "query_id long")
    gold = spark.createDataFrame([(9, 1), (6, 3)], "query_id long, row long")  # gold of another query, and of a negative itself
    got = {r.query_id: tuple(r)[1:] for r in evaluate.score_negatives(listed, negatives, gold, 0.95).collect()}
    assert got == {5: (0.97, 1.0, 0.5, 1.0, 2), 6: (0.2, 0.0, 0.0, 0.0, 1), 7: (0.0, 0.0, 0.0, 0.0, 0)}
    before = spark.createDataFrame([(1, 5, 0.5), (2, 5, 1.0)], "query_id long, k long, rr double")
    after = spark.createDataFrame([(1, 5, 1.0), (3, 5, 1.0)], "query_id long, k long, rr double")
    assert [tuple(r) for r in evaluate.item_diff(before, after, 5).collect()] == [(1, 0.5, 1.0, "better")]
    values = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", 2.0), ("g", 4.0), ("g", None)], "g string, v double")
    assert evaluate.upper_median(values, "g", "v").first().base == 3.0
    assert evaluate.non_empty_rate(listed, negatives).first().rate == pytest.approx(2 / 3, abs=1e-8)
    assert evaluate.macro(evaluate.score_queries(listed.limit(0), gold.limit(0).select(F.lit(1).alias("query_id"), "row", F.lit(1).alias("grade")), [3])).count() == 0


def test_rescoring_takes_the_vectors_of_sparse_candidates(spark, tmp_path):
    vector = [1.0] * 64
    rows = [(100, vector, {"1": 1.0}, None), *((r, vector, {}, None) for r in range(101, 161)), (205, vector, {"1": 1.0}, None), (206, None, {"1": 1.0}, None)]
    spark.createDataFrame(rows, "chunk_row long, dense array<float>, sparse map<string,float>, status string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["row"]: r.score for r in retrieval._rescored(spark, str(tmp_path)).where("query_id = 100").collect()}
    assert got[205] == 1.0 and got[206] == 0.0 and got[101] == 1.0


def test_dense_search_in_tiles_equals_one_block(spark, monkeypatch):
    """More queries than a block: tiles of queries and rows, no query on the driver, one read of the table."""
    import numpy as np

    rnd = np.random.RandomState(0)
    vectors = rnd.standard_normal((300, 4)).round(1).tolist()  # many ties
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "row long, vector array<float>").withColumn("query_id", F.col("row"))
    ask = lambda: {tuple(r) for r in search.dense_topk(df.select("query_id", "vector"), df.select("row", "vector"), 5, 4, skip_self=True).collect()}
    whole = ask()
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    monkeypatch.setattr(search, "TILE_QUERIES", 70)
    monkeypatch.setattr(search, "TILE_ROWS", 90)
    assert ask() == whole and len(whole) == 1500
    plan = search.dense_topk(df.select("query_id", "vector"), df.select("row", "vector"), 5, 4)._jdf.queryExecution().toString()
    assert plan.count("FlatMapCoGroupsInArrow") >= 1


def test_terms_of_chinese_and_other_words(spark):
    df = spark.createDataFrame([("锅炉给水泵 GB/T-12，阀 A",), (None,), ("。",)], "t string")
    assert [r.w for r in df.select(search.terms(F.col("t")).alias("w")).collect()] == [["锅炉", "炉给", "给水", "水泵", "gb", "t", "12", "阀", "a"], None, []]


def test_spread_join_splits_keys_that_hold_most_rows(spark):
    from corpuscle.session import spread_join

    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), (None, 4)], "k string, y long")
    got = spread_join(left, right, "k", most=50)
    assert got.count() == 334 * 2 + 0 + (1 if 5 % 3 else 0)
    assert {(r.k, r.x, r.y) for r in got.collect()} == {(r.k, r.x, r.y) for r in left.join(right, "k").collect()}
    assert spread_join(left, right.select("k"), "k", "left_semi", most=50).count() == left.join(right, "k", "left_semi").count()


def test_bm25_sums_products_where_rows_lie(spark, monkeypatch):
    """Every query's k best by brute force, in one part and in several; products of queries and rows are neither joined nor shuffled."""
    import numpy as np

    rnd = np.random.RandomState(1)
    docs = [(i, [f"w{int(x)}" for x in rnd.zipf(1.4, rnd.randint(0, 12)) % 40], int(rnd.randint(1, 900))) for i in range(300)]  # many ties
    docs += [(300 + i, docs[i][1], docs[i][2]) for i in range(60)] + [(360, None, 5), (361, ["w0", None, "w0"], 9)]
    asks = [(i * 3, list(dict.fromkeys([f"w{int(x)}" for x in rnd.randint(0, 45, 6)]))) for i in range(90)] + [(1, None), (2, []), (4, ["nowhere", "w1", "w1", None])]
    df = {}
    for _, words, _ in docs:
        for w in set(words or []):
            df[w] = df.get(w, 0) + 1
    n, expected = sum(bool(words) for _, words, _ in docs), set()
    for q, asked in asks:
        scores = {}
        for r, words, length in docs:
            for w in sorted({w for w in asked or [] if w} & set(words or []) - {None}):
                tf = words.count(w)
                scores[r] = scores.get(r, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 512))
        best = sorted((-round(s, 9), r) for r, s in scores.items() if r != q)[:4]
        expected |= {(q, r, round(-s, 6), i) for i, (s, r) in enumerate(best)}
    corpus = spark.createDataFrame(docs, "row long, terms array<string>, length int").repartition(3)
    queries = spark.createDataFrame(asks, "query_id long, terms array<string>")
    ask = lambda: search.bm25_topk(queries, corpus, 4, skip_self=True)
    got = lambda: {(r.query_id, r["row"], round(r.score, 6), r["rank"]) for r in ask().collect()}
    assert got() == expected and len(expected) > 300
    plan = ask()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(search, "ASKED_TERMS", 150)
    assert got() == expected
    assert search.bm25_topk(queries.limit(0), corpus, 4).count() == 0 and search.bm25_topk(queries, corpus.limit(0), 4).count() == 0


@pytest.mark.parametrize("rows, queries, hits", [(4096, 256, 1_000_000), (7, 256, 1), (50, 3, 40)])
def test_tiles_of_lexical_search_give_the_same(monkeypatch, rows, queries, hits):
    import numpy as np

    for name, value in (("_TERM_ROWS", rows), ("_TERM_QUERIES", queries), ("_HITS", hits)):
        monkeypatch.setattr(search, name, value)
    rnd = np.random.RandomState(2)
    weights = rnd.randint(0, 3, (200, 12)) / 2  # many ties; rows without a term
    asked = rnd.rand(20, 12) < 0.3
    asked[5] = False  # has no term of the table
    ids, lines = np.arange(20) * 7, np.split(np.nonzero(asked)[1], np.cumsum(asked.sum(1))[:-1])
    found = search._BestByTerms(ids, np.concatenate([[0], np.cumsum(asked.sum(1))]), np.concatenate(lines), 12, 5, True)
    for part in (slice(0, 120), slice(120, 200)):
        own = weights[part]
        found.add(np.arange(200)[part], np.concatenate([[0], np.cumsum((own > 0).sum(1))]), np.nonzero(own)[1], own[own > 0])
    score = asked.astype(float) @ weights.T
    expected = [(int(q), int(r), float(s)) for i, q in enumerate(ids) for s, r in sorted((-score[i, r], r) for r in range(200) if r != q and score[i, r] > 0)[:5]]
    assert sorted(zip(*(c.to_pylist() for c in found.columns()), strict=True)) == sorted((q, r, -s) for q, r, s in expected)

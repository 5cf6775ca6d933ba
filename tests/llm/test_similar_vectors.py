"""Neighbours against brute force, ties, copies and unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from corpuscle.llm import similar_vectors as sv


def clusters(n, seed=0, width=16):
    rnd = np.random.RandomState(seed)
    centres = rnd.standard_normal((n // 12, width))
    return (centres[rnd.randint(0, len(centres), n)] + 0.25 * rnd.standard_normal((n, width))).astype(np.float32)


def brute(rows, vectors, k):
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    out = set()
    for i in range(len(rows)):
        cos = np.round(unit @ unit[i], 9)
        cos[i] = -9
        for j in np.lexsort((rows, -cos))[:k]:
            out.add((rows[i], rows[j]))
    return out


def frame(spark, rows, vectors):
    return spark.createDataFrame([(int(r), None if v is None else [float(x) for x in v]) for r, v in zip(rows, vectors, strict=True)], "chunk_row long, dense array<float>")


def found(df, k=5, width=16, spec=sv.ForestSpec()):
    return {(r["row"], r.near) for r in sv.nearest_vectors(df, "chunk_row", "dense", width, k, spec).collect()}


def test_recall_in_many_leaves(spark):
    vectors, rows = clusters(3000), np.arange(3000) * 7 + 1
    got = found(frame(spark, rows, vectors), spec=sv.ForestSpec(leaf_rows=64, bucket_rows=16, sample_rows=1500))
    truth = brute(rows, vectors, 5)
    assert len(got & truth) >= 0.9 * len(truth)


def test_leaves_stay_bounded_however_small_the_sample(spark):
    """Fifty times as many rows as the sample supports levels for: overfull leaves are split on, and neighbours are still found."""
    vectors, rows = clusters(6400), np.arange(6400)
    spec = sv.ForestSpec(trees=12, uses=6, leaf_rows=64, bucket_rows=16, sample_rows=128)
    unit = sv._unit(vectors.astype(float)).astype(np.float32)
    forest = sv.fit_forest(unit[:128], 6400, spec)
    assert forest.depth == 3
    leaves = spark.createDataFrame([(int(r), v.tolist(), int(x)) for r, v, own in zip(rows, vectors, forest.leaves(unit), strict=True) for x in own], "row long, vector array<float>, leaf long").withColumn("spare", F.lit(False))
    split, shift = sv.split_overfull(leaves, forest, 16)
    sizes = [r["count"] for r in split.groupBy("leaf").count().collect()]
    assert max(sizes) <= sv.OVERFULL * spec.leaf_rows and sum(sizes) == 6 * 6400 and shift > forest.depth
    assert split.select("row", F.shiftright("leaf", shift).alias("tree")).distinct().count() == 6 * 6400
    got = found(frame(spark, rows, vectors), spec=spec)
    truth = brute(rows, vectors, 5)
    assert len(got & truth) >= 0.9 * len(truth)


def test_small_table_is_exact_with_ties_and_copies(spark):
    vectors = [[1, 0, 0], [2, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0], None, [], [0, 0, 0], [float("nan"), 1, 0], [float("inf"), 1, 0], [1, 0]] + [[1, 0, 0]] * 12
    rows = np.arange(len(vectors)) + 1
    df = frame(spark, rows, vectors).withColumns({"row": F.lit(1), "h": F.lit(2), "leaf": F.lit(3), "vector": F.lit(4)})
    usable = [i for i, v in enumerate(vectors) if v and len(v) == 3 and np.isfinite(v).all() and any(v)]
    assert found(df, 5, 3) == brute(rows[usable], np.array([vectors[i] for i in usable], np.float32), 5)
    pairs = [tuple(r) for r in sv.similar_pairs(sv.nearest_vectors(df, "chunk_row", "dense", 3, 5)).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_empty_and_single(spark):
    df = frame(spark, [1], [[1, 0, 0]])
    assert found(df, 5, 3) == set() and found(df.limit(0), 5, 3) == set() and found(df, 5, 64) == set()


def test_chi_square_quantiles():
    for dims, confidence, known in ((10, 0.99, 23.209), (8, 0.95, 15.507), (4, 0.9, 7.779)):
        assert abs(sv.chi_square(confidence, dims) / known - 1) < 0.01


def test_many_ties_go_to_the_smaller_rows():
    rnd = np.random.RandomState(3)
    lengths = rnd.uniform(0.1, 9, 200)
    vectors = (lengths[:, None] * rnd.standard_normal(16)).astype(np.float32)  # parallel, all of another length
    rows = rnd.permutation(200) + 1
    unit = sv._unit(vectors.astype(float))
    spec = sv.ForestSpec()
    ids, cos = sv.nearest(rows, unit, rnd.standard_normal((16, spec.dims)).astype(np.float32), 5, spec)
    assert (cos == 1).all()
    for row, near in zip(rows, ids, strict=True):
        assert near.tolist() == [r for r in range(1, 8) if r != row][:5]


def parallels(n, others, seed=5, width=16):
    """Vectors near one direction: ``n`` of them parallel, all of another length, the others about it or elsewhere."""
    rnd = np.random.RandomState(seed)
    ray = rnd.standard_normal(width)
    vectors = np.concatenate([rnd.uniform(0.1, 9, n)[:, None] * ray, ray + 0.3 * rnd.standard_normal((others, width))])
    return vectors.astype(np.float32), rnd.permutation(len(vectors)) * 3 + 1


def test_crowded_direction_is_dealt_to_parts(spark, monkeypatch):
    """Most rows parallel: they answer each other exactly, and no part holds more than a bound."""
    vectors, rows = parallels(1200, 200)
    spec = sv.ForestSpec(trees=8, leaf_rows=256, bucket_rows=16)
    seen = []
    deal = sv.deal_spare
    monkeypatch.setattr(sv, "deal_spare", lambda leaves, n: seen.append(deal(leaves, n)) or seen[-1])
    got = found(frame(spark, rows, vectors), spec=spec)
    assert len(seen) == 1
    parts = [r["count"] for r in seen[0].groupBy("leaf", "part").count().collect()]
    assert len(parts) > 4 and max(parts) <= 4 * spec.leaf_rows
    truth = brute(rows, vectors, 5)
    assert len(got & truth) >= 0.95 * len(truth)
    own = set(rows[:1200].tolist())
    assert {p for p in got if p[0] in own} == {p for p in truth if p[0] in own}


def test_parallel_rows_of_a_leaf_answer_by_their_first(spark):
    vectors, rows = parallels(600, 100)
    unit = sv._unit(vectors.astype(float))
    spec = sv.ForestSpec(bucket_rows=16)
    ids, _ = sv.nearest(rows, unit, np.random.RandomState(1).standard_normal((16, spec.dims)).astype(np.float32), 5, spec)
    truth = brute(rows, vectors, 5)
    got = {(int(r), int(x)) for r, near in zip(rows, ids, strict=True) for x in near}
    assert len(got & truth) >= 0.98 * len(truth)

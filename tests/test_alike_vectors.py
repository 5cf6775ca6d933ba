"""Pairs of alike vectors against brute force: no cap on partners, every row asked, copies linked to their first row."""

import numpy as np

from corpuscle.operators import alike_vectors as av
from corpuscle.operators import graph
from corpuscle.plans import graphs


def crowd(seed=0, width=16):
    """Clusters of up to 60 rows at all distances around the threshold, rescaled copies, identical copies, lone rows."""
    rnd = np.random.RandomState(seed)
    tight = [c + s * rnd.standard_normal((60, width)) for c, s in zip(rnd.standard_normal((12, width)), np.linspace(0.05, 0.4, 12), strict=True)]
    parts = np.concatenate([*tight, rnd.standard_normal((300, width)), 3.7 * tight[0][:20]]).astype(np.float32)
    return np.concatenate([parts, np.repeat(parts[:3], 30, axis=0)])


def brute(vectors, least):
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    first = {v.tobytes(): i for i, v in reversed(list(enumerate(vectors)))}
    lead = [first[v.tobytes()] for v in vectors]
    a, b = np.nonzero(np.triu(np.round(unit @ unit.T, 9) >= least, 1))
    return {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if lead[i] == i and lead[j] == j} | {(f, i) for i, f in enumerate(lead) if f != i}


def frame(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, (90_001, None), (90_002, [0.0] * 16), (90_003, [float("nan")] * 16), (90_004, [1.0])], "chunk_row long, dense array<float>")


def groups(df):
    return {(r.id, r.group_id) for r in graph.components(df).collect()}


def test_equal_to_brute_force(spark, monkeypatch):
    vectors = crowd()
    df, truth = frame(spark, vectors), brute(vectors, 0.97)
    partners = np.bincount([i for p in truth for i in p])
    assert partners.max() > 20 and len(truth) > 2000
    for sample, block in ((16_384, 8192), (400, 16), (3, 100)):  # few centres and small blocks change the work only
        monkeypatch.setattr(av, "SAMPLE_ROWS", sample)
        monkeypatch.setattr(av, "BLOCK_ROWS", block)
        got = [tuple(r) for r in av.alike_vectors(df, "chunk_row", "dense", 16, 0.97).collect()]
        assert len(got) == len(set(got)) and set(got) == truth
    pairs = spark.createDataFrame(sorted(truth), "a long, b long")
    assert groups(av.alike_vectors(df, "chunk_row", "dense", 16, 0.97, links_only=True)) == groups(pairs)


def test_empty_and_single(spark):
    df = frame(spark, crowd()[:1])
    assert av.alike_vectors(df, "chunk_row", "dense", 16, 0.97).count() == 0
    assert av.alike_vectors(df.limit(0), "chunk_row", "dense", 16, 0.97).count() == 0


def test_query_asks_every_row(spark):
    got = graphs.vector_dupes(spark, "/root/testdata/sf0.001")
    assert got.where("a % 100 <> 0 AND b % 100 <> 0").count() > 0

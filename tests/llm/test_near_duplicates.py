"""The trie join against brute force, with hot paths, copies and edges."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpuscle.llm import near_duplicates as nd


def grams(t):
    return {t[i : i + 5] for i in range(max(1, len(t) - 4))}


def brute(rows, similarity):
    out = set()
    for i, (level, a, x) in enumerate(rows):
        for other, b, y in rows[i + 1 :]:
            if level == other and x and y and x != y and a != b:
                g, h = grams(x), grams(y)
                if len(g & h) >= similarity * len(g | h):
                    out.add((level, min(a, b), max(a, b)))
    return out


def family(seed, n, length=160, edits=6):
    rnd = random.Random(seed)
    base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rnd.randint(0, edits)):
            text[rnd.randrange(length)] = rnd.choice("abcdefghijklmnopqrstuvwxyz")
        out.append("".join(text))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "level string, row long, text string")


def test_pairs_match_brute_force(spark):
    texts = [t for s in range(12) for t in family(s, 5)]
    rows = [("chunk" if i % 4 else "other", i + 1, t) for i, t in enumerate(texts)]
    got = {tuple(r) for r in nd.similar_pairs(table(spark, rows), 0.6).collect()}
    truth = brute(rows, 0.6)
    assert truth and got <= truth and len(got) >= 0.97 * len(truth)


def test_edges_and_copies(spark):
    rows = [("c", 1, "abcdefghij"), ("c", 2, "ABCDE fghij"), ("c", 3, "abcdefghijk"), ("d", 4, "abcdefghijk"), ("c", 5, None), ("c", 6, " 。"), ("c", 7, "ab"), ("c", 8, "a b"), ("c", 9, "abc")]
    df = table(spark, rows).withColumns({"h": F.lit(1), "a": F.lit(2), "path": F.lit(3)})
    assert {tuple(r) for r in nd.similar_pairs(df, 0.6).collect()} == {("c", 1, 3), ("c", 2, 3)}
    assert nd.similar_pairs(df.limit(0), 0.6).count() == 0
    groups = {r["row"]: (r.class_row, r.group_row, r.n_links) for r in nd.similar_groups(df, 0.6).where("level = 'c'").collect()}
    assert groups == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 1), 7: (7, 7, 0), 8: (7, 7, 0), 9: (9, 9, 0)}


def test_crowded_paths_lose_nothing(spark, monkeypatch):
    """Paths of over 16 texts are made longer (ROUNDS 4), or cut into blocks at once (ROUNDS 0)."""
    rows = [("c", i, t) for i, t in enumerate(sorted(set(family(3, 120, edits=9))))]
    truth = brute(rows, 0.6)
    whole = {tuple(r) for r in nd.similar_pairs(table(spark, rows), 0.6).collect()}
    assert whole <= truth and len(whole) >= 0.99 * len(truth)
    monkeypatch.setattr(nd, "PATH_TEXTS", 16)
    longer = {tuple(r) for r in nd.similar_pairs(table(spark, rows), 0.6).collect()}
    assert longer <= truth and len(longer) >= 0.99 * len(truth)
    monkeypatch.setattr(nd, "ROUNDS", 0)
    assert {tuple(r) for r in nd.similar_pairs(table(spark, rows), 0.6).collect()} == whole


def test_a_crowded_class_is_dealt_to_several_tasks(spark, monkeypatch):
    """A third of all rows under one text: every copy meets every partner once, no key has over TASK_COPIES rows."""
    monkeypatch.setattr(nd, "TASK_COPIES", 8)
    text = family(5, 1)[0]
    rows = [("c", i, text.upper() if i % 2 else text) for i in range(60)] + [("c", 100 + i, text[:-1] + str(i)) for i in range(3)] + [("c", 200 + i, t) for i, t in enumerate(family(9, 60, edits=0)[:1])]
    got = [tuple(r) for r in nd.similar_pairs(table(spark, rows), 0.8).collect()]
    want = {("c", i, 100 + k) for i in range(60) for k in range(3)} | {("c", 100, 101), ("c", 100, 102), ("c", 101, 102)}
    assert len(got) == len(set(got)) and set(got) == want
    members = nd.members(nd.signatures(table(spark, rows)))
    sizes = members.groupBy("class_row", F.pmod(F.xxhash64("row"), F.ceil(F.col("n_copies") / nd.TASK_COPIES))).count()
    assert max(r["count"] for r in sizes.collect()) < 3 * nd.TASK_COPIES


def test_one_budget_rule_for_every_size(monkeypatch):
    rnd = np.random.RandomState(1)
    base = rnd.randint(0, 256, nd.BITS // 8, dtype=np.uint8)
    tails = base ^ np.packbits(rnd.rand(300, nd.BITS) < 0.12, axis=1)
    tails = np.ascontiguousarray(tails[np.lexsort([tails.view(">u8")[:, 1], tails.view(">u8")[:, 0]])])
    found = []
    for most in (1, 64, 1 << 40):
        monkeypatch.setattr(nd, "LEAF_PAIRS", most)
        i, j = nd._traverse(tails, np.array([[0, 300, 0, 300]]), nd.bit_budgets(0.8))
        found.append({(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)})
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) < 300 * 299 // 2


def test_traversal_equals_comparing_all():
    rnd = np.random.RandomState(0)
    base = rnd.randint(0, 256, (40, nd.BITS // 8), dtype=np.uint8)
    tails = np.concatenate([base, base ^ (rnd.rand(40, nd.BITS // 8) < 0.1).astype(np.uint8) * 3])
    words = tails.view(">u8")
    tails = np.ascontiguousarray(tails[np.lexsort([words[:, 1], words[:, 0]])])
    budgets = np.full(nd.BITS + 1, 20, np.int32)  # the same at every depth
    n = len(tails)
    i, j = nd._traverse(tails, np.array([[0, n, 0, n]]), budgets)
    bits = np.unpackbits(tails, axis=1).astype(int)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if (bits[a] != bits[b]).sum() <= 20}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want)


def test_signature_of_long_and_short_texts():
    hashes = nd._signatures(["ab", "x" * 700_000 + "y", "abcde"])
    assert hashes.shape == (3, nd.HASHES) and (hashes[0] != hashes[2]).any()

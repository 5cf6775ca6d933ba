"""Schedules and mixtures: windows, shares, repetitions and edges."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import mixture as mx


@pytest.mark.parametrize("blocks", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 99}, {"x": 7}, {"a": 33, "b": 33, "c": 34}, {"a": 1, "b": 1, "c": 1000, "d": 17}])
def test_every_block_within_its_window(blocks):
    slots = mx.pfair_slots(blocks)
    total = sum(blocks.values())
    assert [s for s, _, _ in slots] == list(range(total))
    seen = dict.fromkeys(blocks, 0)
    for slot, source, j in slots:
        weight = Fraction(blocks[source], total)
        assert j == seen[source] and j / weight // 1 <= slot < -(-(j + 1) / weight // 1)
        seen[source] += 1
        assert all(abs(seen[s] - (slot + 1) * Fraction(blocks[s], total)) < 1 for s in blocks)


def mixed(spark, texts, targets):
    a = spark.createDataFrame(texts, "doc_id long, source string, n_tokens long").withColumns({"key": F.lit(1), "part": F.lit(2), "slot": F.lit(3)})
    b = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mx.mixture(a, b), b


def test_shares_repeats_and_shortage(spark):
    texts = [(i, " Big " if i % 2 else "BIG", 100) for i in range(400)] + [(1000 + i, "small", 50) for i in range(40)] + [(2000, "tiny", 10), (2001, None, 70), (2002, "big", 0), (2003, "none", 500)]
    out, targets = mixed(spark, texts, [("big", 0.6, 1), ("small", 0.3, 10), ("tiny", 0.1, 3)])
    rows = out.collect()
    total = 400 * 100 + 40 * 50 + 10 + 70 + 500
    assert abs(sum(r.n_tokens for r in rows) - total) <= 0.02 * total
    shares = {r.source: r for r in mx.shares(out, targets).collect()}
    assert shares["tiny"].n_tokens == 30 and shares["tiny"].most_uses == 3 and shares["small"].most_uses <= 10
    assert shares["big"].share / shares["small"].share == pytest.approx(2, rel=0.02)
    uses = {}
    for r in rows:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        assert r.use_no <= {"big": 1, "small": 10, "tiny": 3}[r.source]
    small = [uses.get(1000 + i, 0) for i in range(40)]
    assert max(small) - min(small) <= 1 and 2001 not in uses and 2003 not in uses


def test_cycles_go_on_within_one_block(spark, monkeypatch):
    """Blocks of bounded size: many cycles, each block of a source filled, and every source less than one block from its share after every slot."""
    monkeypatch.setattr(mx, "CYCLE", 16)
    monkeypatch.setattr(mx, "LEAST_BLOCK", 100)
    monkeypatch.setattr(mx, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(mx, "PART_TOKENS", 1000)
    texts = [(i, "abc"[i % 3], 10) for i in range(2400)]
    out, _ = mixed(spark, texts, [("a", 0.5, 3), ("b", 0.3, 3), ("c", 0.2, 3)])
    rows = sorted((r.slot, r.source, r.n_tokens, r.start_token) for r in out.collect())
    owner = {}
    for slot, source, _, _ in rows:
        assert owner.setdefault(slot, source) == source
    n = max(owner) + 1
    assert n == 240 and len(owner) == n and sum(r[2] for r in rows) == 24_000
    total = {s: list(owner.values()).count(s) for s in "abc"}
    seen = dict.fromkeys("abc", 0)
    for slot in range(n):
        seen[owner[slot]] += 1
        assert all(abs(seen[s] - (slot + 1) * total[s] / n) < 1 for s in "abc")
    sequence = {s: [r[3] for r in rows if r[1] == s] for s in "abc"}
    assert all(x == sorted(x) and len(x) == len(set(x)) for x in sequence.values())


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mx, "SOURCES", 1)
    with pytest.raises(ValueError, match="more than 1 sources"):
        mixed(spark, [(1, "a", 5)], [("a", 0.5, 1), ("b", 0.5, 1)])


def test_no_texts_no_targets(spark):
    out, targets = mixed(spark, [], [("a", 1.0, 1)])
    assert out.count() == 0 and mx.shares(out, targets).first().share == 0.0
    assert mixed(spark, [(1, "a", 5)], [])[0].count() == 0
    assert [r.doc_id for r in mixed(spark, [(1, "a", 5)], [("A ", 1.0, 1)])[0].collect()] == [1]


def test_repeated_documents_count_once(spark):
    counts = spark.createDataFrame([(1, 5), (1, 5), (2, 3)], "doc_id long, n_tokens long")
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, source string")
    assert {tuple(r) for r in mx.sized_sources(counts, docs).select("doc_id", "source", "n_tokens").collect()} == {(1, "a", 5), (2, None, 3)}

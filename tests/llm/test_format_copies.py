"""Reduced texts and their groups against a character-by-character restatement."""

import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.llm import format_copies
from corpuscle.llm.canonical import reduced_text


def plain(text):
    wide = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if c == "　" else c for c in text).lower()
    solid = "".join(c for c in wide if not c.isspace() and c not in "​‌‍﻿")
    digit = lambda i: 0 <= i < len(solid) and solid[i] in "0123456789"
    return "".join(c for i, c in enumerate(solid) if not unicodedata.category(c).startswith("P") or digit(i - 1) and digit(i + 1))


def reduced(text):
    items = [x for x in (p.strip() for p in re.split("[；;\n]", text)) if x]
    if len(items) >= 3 and all(re.fullmatch("[^：:]{1,12}[：:][^：:]+", x) for x in items):
        return "".join(sorted(map(plain, items)))
    return plain(text)


TEXTS = st.lists(st.one_of(st.none(), st.text("aB1２，,.:：;；\n ​　（x", max_size=24)), max_size=20)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_reduced_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    for r in df.select("text", reduced_text(F.col("text")).alias("r")).collect():
        assert r.r == (None if r.text is None else reduced(r.text))


def test_fields_in_any_order(spark):
    df = spark.createDataFrame([("名称：A；编号：1.5；人：乙",), ("人: 乙;\n编号:1.5 ; 名称:ａ。",), ("人:乙;编号:1.5",)], "t string")
    a, b, c = (r[0] for r in df.select(reduced_text(F.col("t"))).collect())
    assert a == b == "人乙名称a编号1.5" and c == "人乙编号1.5"


ROWS = [(1, "Ａ，b"), (2, "a b"), (3, "AB"), (4, "1.2"), (5, "12"), (6, None), (7, ""), (8, " ，。"), (9, "。、"), (10, "x" * 200_000), (11, "X " * 200_000)]


def test_groups_and_edges(spark):
    df = spark.createDataFrame(ROWS, "chunk_row long, text string").withColumns({"row": F.lit(1), "h": F.lit("x"), "check": F.lit(0), "first_row": F.lit(3)})
    assert {tuple(r) for r in format_copies.format_copies(df, "chunk_row", "text").collect()} == {(1, 2), (1, 3), (10, 11)}
    assert {tuple(r) for r in format_copies.collapsed_records(df, "chunk_row", "text").collect()} == {(1, 3), (4, 1), (5, 1), (10, 2)}
    assert format_copies.format_copies(df.limit(0), "chunk_row", "text").count() == 0


def test_hot_group_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(format_copies, "HOT_ROWS", 100)
    df = spark.range(3000).select(F.col("id").alias("r"), F.when(F.col("id") % 3 == 0, "Hot!").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int").cast("string"))).alias("t"))
    got = format_copies.format_copies(df, "r", "t").collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(reduced(r.t), []).append(r.r)
    assert {tuple(r) for r in got} == {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_collisions_stay_apart(spark):
    marks = spark.createDataFrame([(1, bytearray(b"h"), 5), (2, bytearray(b"h"), 6), (3, bytearray(b"h"), 5)], "row long, h binary, check long")
    groups = format_copies.collapse_copies(marks)
    assert {(r.first_row, r.n_copies) for r in groups.collect()} == {(1, 2), (2, 1)}
    assert format_copies.hash_collisions(groups).first().n_texts == 2

"""Pieces of texts: limits, coverage, overlaps and the stretches that must be cut."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.llm import pieces


def oversized(text, size):
    out, last = set(), 0
    marks = list(re.finditer("[\r\n]|[。！？；!?;…][。！？；!?;…」』”’）)》〉】〕｝\"'\\]}]*", text))
    for end in [m.end() for m in marks] + [len(text)]:
        stretch = text[last:end]
        if len(stretch.strip()) > size:
            out.add(last + len(stretch) - len(stretch.lstrip()))
        last = end
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["甲乙丙", "一二三四五，六七八九", "。", "！”", "\n", "\r\n", "## 附则", " ", "x" * 30, "；", "第一章 总则", "1.2 范围"]), max_size=60).map("".join))
def test_pieces_of_any_text(text):
    got = pieces.split_text(text, 40, 8)
    covered = set()
    for start, end, *_ in got:
        assert 0 < end - start <= 40 and text[start:end].strip() == text[start:end]
        covered |= set(range(start, end))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    for a, b in zip(got, got[1:], strict=False):
        assert b[0] > a[0] and a[1] - b[0] <= 8 and (a[2] == b[2] or b[0] >= a[1])
    assert {p[3] for p in got if p[3] is not None} == oversized(text, 40)


def test_balanced_and_natural():
    text = "".join("句" * 99 + "。" for _ in range(12))
    got = pieces.split_text(text)
    assert [(s, e) for s, e, *_ in got][0] == (0, 400) and len(got) == 3 and all(cut == "natural" for *_, cut in got)
    soft = pieces.split_text("字" * 300 + "，" + "字" * 400)
    assert soft[0][:2] == (0, 301) and soft[0][4] == "soft" and soft[0][3] == 0


def test_frame_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "短。"), (5, "无" * 100_000), (5, "无" * 100_000)]
    df = spark.createDataFrame(rows, "doc_row long, text string").withColumns({"doc": F.lit(1), "start_pos": F.lit(2), "cut": F.lit("x")})
    got = pieces.split_texts(df, "doc_row", "text")
    assert {r.doc_row for r in got.collect()} == {4, 5} and got.agg(F.max(F.length("text"))).first()[0] <= 512
    assert [tuple(r) for r in pieces.oversized_stretches(got, "doc_row").collect()] == [(5, 0)]
    assert pieces.split_texts(df.limit(0), "doc_row", "text").count() == 0

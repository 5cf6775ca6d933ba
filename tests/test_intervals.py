"""Periods and gaps against a plain sweep, and days in many notations."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.functions.days import day_text, parse_day
from corpuscle.operators.intervals import periods_and_gaps, rule_periods


def sweep(rows):
    out, by_key = set(), {}
    for key, first, last in rows:
        if key is not None and first is not None and last is not None and first <= last:
            by_key.setdefault(key, []).append((first, last))
    for key, spans in by_key.items():
        spans.sort()
        start, end, n = *spans[0], 1
        for first, last in spans[1:]:
            if first <= end + 1:
                end, n = max(end, last), n + 1
            else:
                out |= {(key, "period", start, end, n), (key, "gap", end + 1, first - 1, 0)}
                start, end, n = first, last, 1
        out.add((key, "period", start, end, n))
    return out


SPANS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 30)), st.one_of(st.none(), st.integers(0, 30))), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SPANS)
def test_periods_match_a_sweep(spark, rows):
    df = spark.createDataFrame(rows, "k string, f long, l long")
    assert {tuple(r) for r in periods_and_gaps(df, "k", "f", "l").collect()} == sweep(rows)


def test_days_in_many_notations(spark):
    written = {
        "2013-05-20": "2013-05-20", " 2013-5-2 ": "2013-05-02", "2013/10/19": "2013-10-19", "2014.03.05": "2014-03-05", "20090328": "2009-03-28", "2012年6月2日": "2012-06-02",
        "2009-03-11T00:00:00": "2009-03-11", "２０１２年１２月３１日": "2012-12-31", "二〇一二年十二月三十一日": "2012-12-31", "2021-02-30": None, "0000-00-00": None, "待定": None, "": None,
        "9999-12-31": "9999-12-31", "2012-13-01": None, "123": None, "2012-1": None,
    }
    df = spark.createDataFrame([(w,) for w in written], "w string")
    got = {r.w: r.d for r in df.select("w", day_text(parse_day(F.col("w"))).alias("d")).collect()}
    assert got == written


def test_rule_periods_of_chunks(spark):
    rows = [
        ("r", "2020-01-01", "2020-01-31", "superseded"), ("r", "2020/2/1", "2020-02-10", None), ("r", "2020-03-01", None, "superseded"), ("r", "2020-04-01", "长期", "current"),
        ("r", "2020-05-01", "2020-04-01", "current"), ("s", None, "2020-01-01", "current"), (None, "2020-01-01", "2020-01-02", "current"), ("t", "2020-01-01", "2020-01-01", "current"),
        ("t", "2020-01-01", "2020-01-01", "current"),
    ]
    df = spark.createDataFrame(rows, "rule_no string, effective_from string, effective_to string, status string").withColumn("entity", F.lit(1)).withColumn("day", F.lit(2))
    assert {tuple(r) for r in rule_periods(df).collect()} == {
        ("r", "period", "2020-01-01", "2020-02-10", 2), ("r", "gap", "2020-02-11", "2020-03-31", 0), ("r", "period", "2020-04-01", "9999-12-31", 1), ("t", "period", "2020-01-01", "2020-01-01", 2),
    }
    assert rule_periods(df.limit(0)).count() == 0


def test_one_key_holds_most_rows_in_few_window_rows(spark):
    day = dt.date(2020, 1, 1).toordinal()
    df = spark.range(50_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.lit(day) + F.col("id") % 5 * 3).alias("f"))
    got = periods_and_gaps(df.withColumn("l", F.col("f")), "k", "f", "l").where("k = 'hot'").collect()
    assert sorted(r.kind for r in got) == ["gap"] * 4 + ["period"] * 5
    assert sum(r.n_intervals for r in got) == df.where("k = 'hot'").count()

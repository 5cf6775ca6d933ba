"""Queries on the intervals in which chunks are effective."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.operators.intervals import rule_periods
from corpuscle.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return rule_periods(table(spark, folder, "chunks")).select("rule_no", "kind", "first_day", "last_day")


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    return rule_periods(table(spark, folder, "chunks"))


QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods}


def _day(column: str) -> str:
    plain = f"translate(trim({column}), '０１２３４５６７８９', '0123456789')"
    parts = f"regexp_extract({plain}, '^([0-9]{{4}})(?:[-/.年]([0-9]{{1,2}})[-/.月]([0-9]{{1,2}})日?|([0-9]{{2}})([0-9]{{2}}))(?:T.*)?$', ['y', 'm', 'd', 'm2', 'd2'])"
    return f"(SELECT try_cast(p.y || '-' || lpad(p.m || p.m2, 2, '0') || '-' || lpad(p.d || p.d2, 2, '0') AS DATE) FROM (SELECT {parts} AS p))"


_PERIODS = f"""
WITH days AS (SELECT rule_no, status, {_day('effective_from')} AS a, {_day('effective_to')} AS b FROM chunks WHERE rule_no IS NOT NULL),
spans AS (SELECT rule_no, a AS f, coalesce(b, DATE '9999-12-31') AS t, count(*) AS c FROM days
          WHERE a IS NOT NULL AND (b IS NOT NULL OR status IS DISTINCT FROM 'superseded') AND coalesce(b, DATE '9999-12-31') >= a GROUP BY ALL),
seen AS (SELECT *, max(t) OVER (PARTITION BY rule_no ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR f > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rule_no ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS run FROM seen),
periods AS (SELECT rule_no, run, min(f) AS f, max(t) AS t, sum(c) AS n FROM runs GROUP BY rule_no, run),
gaps AS (SELECT p.rule_no, p.t + 1 AS f, lead(p.f) OVER (PARTITION BY p.rule_no ORDER BY p.f) - 1 AS t FROM periods AS p),
every AS (SELECT rule_no, 'period' AS kind, f, t, n FROM periods UNION ALL SELECT rule_no, 'gap', f, t, 0 FROM gaps WHERE t IS NOT NULL)
"""
_OUT = "rule_no, kind, strftime(f, '%Y-%m-%d') AS first_day, strftime(t, '%Y-%m-%d') AS last_day"
ORACLES = {
    "p4_found": f"{_PERIODS} SELECT {_OUT} FROM every",
    "p4_periods": f"{_PERIODS} SELECT {_OUT}, CAST(n AS BIGINT) AS n_intervals FROM every",
}

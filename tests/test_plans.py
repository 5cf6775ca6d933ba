"""The catalog: every query has a plan without cross joins, reads what it needs, and imports without a session."""

import subprocess
import sys
from pathlib import Path

import pytest

from corpuscle.plans import catalog

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[1]
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data here")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_no_cross_joins(spark):
    slow = {"stream_audit"}
    for name, query in catalog.queries().items():
        if name not in slow:
            text = plan(query(spark, FOLDER))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scans_are_narrow(spark):
    text = plan(catalog.queries()["visible_chunks"](spark, FOLDER))
    assert "PushedFilters: [Or(IsNull(status),Not(EqualTo(status,superseded)))]" in text
    assert "ReadSchema: struct<chunk_row:bigint,status:string>" in text
    text = plan(catalog.queries()["p4_found"](spark, FOLDER))
    assert "ReadSchema: struct<rule_no:string,status:string,effective_from:string,effective_to:string>" in text


def test_ranks_are_cut_before_the_shuffle(spark):
    assert plan(catalog.queries()["sparse_topk"](spark, FOLDER)).count("WindowGroupLimit") >= 2

"""Every registered query against its SQL, and the shape of every plan."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from compare import compare, duck

OWN = {name: build for name, build in entry.queries().items() if build.__module__.startswith("panelforecast.queries")}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(OWN)))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(OWN[name](spark, sf_dir), entry.oracle_sql()[name], con) == ""


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(OWN))
def test_plan_has_no_cross_join_and_no_python(spark, sf_dir, name):
    out = OWN[name](spark, sf_dir)
    if name not in entry.oracle_sql():
        assert out.count() > 0  # the others' rows are held against SQL
    plan = plan_of(out)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "ArrowEval", "BatchEvalPython"):
        assert node not in plan


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = plan_of(OWN["scan_table"](spark, sf_dir))
    assert "o_orderpriority" not in plan and "o_totalprice" in plan


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

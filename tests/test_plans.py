"""Plan guards: no registered query may plan a cartesian product or a nested-loop join,
and scans read only the columns a query uses."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from evalspark.plans.registry import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


def test_scan_prunes_columns(spark):
    df = E.queries()["m2_tpot"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("event_type" not in s for s in schemas)  # m2 never reads event_type

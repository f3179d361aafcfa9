"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, FOLDER)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert differences(result, duck, sql) == []


@pytest.mark.parametrize(
    "name", ["bm25_topk", "hybrid_retrieve", "vector_topk", "rerank_topk", "manifest_reasons", "chunk_ids"]
)
def test_no_cross_joins(spark, name):
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_candidates_go_to_the_chunks(spark):
    """The chunk table is the streamed side: its text is not shuffled for the join."""
    plan = contract.queries()["hybrid_retrieve"](spark, FOLDER)._jdf.queryExecution().executedPlan()
    joins = [line for line in plan.toString().splitlines() if "Join [chunk_id" in line]
    assert joins and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

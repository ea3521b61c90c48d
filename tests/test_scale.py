"""Work that must be spread over all cores, or stay small, however large a table is."""

import pytest
from pyspark.sql import functions as F

from sievework.plans import queries as plans
from sievework.plans import relational
from sievework.sources import readers
from test_plans import plan

SF = "/root/testdata/sf0.001"
QUERIES = plans.queries()


def before_python(text):
    """The nodes of a plan below its Python node, by the plan's tree."""
    tree = text.split("\n\n")[0]
    return tree[tree.index("ArrowEvalPython") :]


@pytest.mark.parametrize("name", ["reward_matches", "reward_soft_matches", "progress_windows", "reward_by_keys"])
def test_rows_are_dealt_before_python(spark, name):
    """The table is one row group, which one task would read and parse."""
    assert "Exchange" in before_python(plan(QUERIES[name](spark, SF)))


def test_parts_grow_with_the_rows(spark, monkeypatch):
    def parts():
        sizes = [r["count"] for r in relational._completions(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) - min(sizes) <= 1
        return len(sizes)

    assert parts() == spark.sparkContext.defaultParallelism == 8
    monkeypatch.setattr(readers, "TASK_ROWS", 10)
    assert parts() == 20

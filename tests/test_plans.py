"""Plans that should hold at scale: one pass, pruned scans, sums before shuffles."""

import pytest

from sievework.operators import scoring
from sievework.plans import queries as plans
from sievework.sources import generators

SF = "/root/testdata/sf0.001"
QUERIES = plans.queries()


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["crosstab", "counts_by_type", "value_counts", "group_sizes", "frequent_groups"])
def test_native_reports_run_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "HashAggregate" in text


@pytest.mark.parametrize("name", ["key_scores", "reward_components", "json_validity", "cleaning_decisions", "eval_by_type", "eval_summary", "reward_by_keys", "reward_combined"])
def test_texts_are_parsed_once(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("ArrowEvalPython (") == 1


def test_no_query_plans_a_cartesian_product(spark):
    for name, run in QUERIES.items():
        text = plan(run(spark, SF))
        assert "CartesianProduct" not in text and "CrossJoin" not in text and "BroadcastNestedLoopJoin Cross" not in text, name


def test_scans_read_the_columns_they_need(spark):
    text = plan(QUERIES["group_advantage"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:bigint,l_quantity:" in text or "l_quantity" in text
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["framed_prompts"](spark, SF))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in text


def test_diagnosis_parses_in_one_node(spark):
    rows = generators.completions(spark.read.parquet(f"{SF}/part.parquet"))
    assert plan(scoring.diagnosed(rows)).count("ArrowEvalPython (") == 1

"""The driver's contract."""

import __spark_entry__ as entry
import bench


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_smoke_query(spark):
    found = entry.entry(spark)
    assert found.count() > 0
    assert found.columns == ["id", "output_type", "render_score", "key_validation_score", "final_eval_score"]


def test_bench_names_exist():
    known = set(entry.queries())
    assert {name for name in bench.HEADLINES if not name.startswith("op") and name != "pipeline"} <= known

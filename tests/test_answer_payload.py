"""The native payload of an answer is the kernel's, and reports of escapes run no Python."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.functions import formats
from sievework.operators import reports
from sievework.plans import queries as plans
from sievework.sources import writers
from test_plans import plan

SF = "/root/testdata/sf0.001"
FENCE = "```"
PIECES = [
    FENCE, f"{FENCE}xml", f"{FENCE}json ", f"{FENCE}a+b", f"{FENCE}\x1c", "\n", "\n", "\n", "\r\n", "\r", "\x85", " ", " ", "\t", "\xa0", "\u3000", "\x1d",
    "output:", "Output : ", "ANSWER\xa0:", "fınal:", "FİNAL:", "anſwer:", "final: x", "the answer:", "output", ":", "<a>&amp;</a>", "< b", "{\"k\": [1]}", "[1]",
    "k: v", "a = 1", "\U0001f600", "é", "text",
]


@pytest.fixture(scope="module")
def texts(spark):
    source = random.Random(5)
    made = ["".join(source.choices(PIECES, k=source.randrange(12))) for _ in range(20_000)]
    made += [f"{FENCE}\n\n{FENCE}", f"{FENCE}\n{FENCE}", f"x\n{FENCE}\na\n{FENCE}\n{FENCE}\n b \n{FENCE}", "output:", "x\noutput:\n", None, "", " \x1f"]
    kinds = [*formats.FORMATS, "xml", "", None]
    return spark.createDataFrame([(t, kinds[k % len(kinds)]) for k, t in enumerate(made)], "t string, kind string").cache()


def test_blanks_are_all_that_python_strips():
    assert set(C.BLANKS) == set(filter(str.isspace, map(chr, range(sys.maxunicode + 1))))


def test_native_payload_is_the_kernel(texts):
    found = texts.select("t", "kind", C.answer_payload("t", "kind").alias("x")).collect()
    wrong = [(r.t, r.kind, r.x, want) for r in found if r.x != (want := formats.answer_payload(r.t, r.kind or ""))]
    assert not wrong, wrong[:3]
    assert len({r.x for r in found}) > 5_000


def test_long_blanks_inside_take_one_pass(spark):
    text = "<a>" + " " * 1_000_000 + "</a> "
    row = spark.createDataFrame([(text,)], "t string").select(C.answer_payload("t", F.lit("XML")).alias("x")).first()
    assert row.x == text.strip()


@pytest.mark.parametrize("name", ["escape_stats", "escape_rates", "escape_pivot", "escape_sums"])
def test_escapes_of_pages_run_no_python(spark, name):
    text = plan(plans.queries()[name](spark, SF))
    assert "Python" not in text
    assert "size(array(" not in text  # a filter that the optimizer makes of the arrays counts all anew


def test_inline_tables_are_those_of_toml_alone(spark):
    rows = spark.createDataFrame([("d", kind, True, "a = {b = 1}") for kind in ("TOML", "XML")], "dataset string, format string, usable boolean, output string")
    found = reports.escapes(rows).where("escape_type LIKE 'toml_inline%'").groupBy("format").agg(F.sum("n").alias("n")).collect()
    assert [(r.format, r.n) for r in found] == [("TOML", 2)]


def test_written_summaries_run_no_python(spark, monkeypatch):
    plans_of_files = []
    written = writers.csv_with_header
    monkeypatch.setattr(writers, "csv_with_header", lambda rows, *given: (plans_of_files.append(plan(rows)), written(rows, *given)))
    assert plans.queries()["csv_summaries_again"](spark, SF).count() == 9
    assert len(plans_of_files) == 1 and "Python" not in plans_of_files[0]

"""Native columns say what the Python kernels say, on many made-up texts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.functions import formats, prompts, trees

FENCE = "```"
PARTS = [
    "convert", "Transform this", "from", "to", "into", "as", "in", "format", "output", "a", "json", "YAML", "yml", "Toml",
    "xml", "csv", ":", "\n", "{", "[1, 2]", "<?xml", "a, b, c", "x = 1", "y = 2", "k: v", FENCE, "please", "data", "jsonx",
]
LINES = [
    "a = 1", "[t]", "[a.b.c]", "[[x . y]]", "p.q.r = 1", '["k.l"]', "# [z.z.z.z]", "s = 1 # c", FENCE, f"{FENCE}json", "  ", "text",
    f"  {FENCE} ", f"say {FENCE}", "\ttab", "e\\#f = 1", "[u.v]\r",
]


@pytest.fixture(scope="module")
def texts(spark):
    source = random.Random(11)
    made = [" ".join(source.choices(PARTS, k=source.randrange(1, 9))) for _ in range(1500)]
    made += ["\n".join(source.choices(LINES, k=source.randrange(1, 7))) for _ in range(1500)]
    made += ["", " ", "\n", " x ", "\x1cx\x1f", *(f"{a} to {b}" for a, b in itertools.product(("json", "csv"), ("xml", "toml")))]
    return spark.createDataFrame([(t,) for t in made], "t string").repartition(4).cache()


CASES = {
    "strip": (lambda: C.strip("t"), str.strip),
    "has_fence": (lambda: C.has_fence("t"), lambda t: FENCE in t),
    "without_fences": (lambda: C.without_fences("t"), formats.without_fences),
    "first_block": (lambda: C.first_block("t"), lambda t: formats.first_block(t)[0]),
    "around_block": (lambda: C.around_block("t"), lambda t: formats.first_block(t)[1]),
    "only_a_block": (lambda: C.only_a_block("t"), formats.only_a_block),
    "flow": (lambda: C.is_flow_style("t"), formats.yaml_is_flow),
    "target": (lambda: C.target_format("t"), prompts.target_format),
    "source": (lambda: C.source_format("t"), lambda t: prompts.source_and_target(t)[0]),
    "payload": (lambda: C.has_payload("t"), prompts.has_payload),
    "class": (lambda: C.task_class("t"), lambda t: prompts.classify(t)[0]),
    "depth": (lambda: C.toml_depth("t"), trees.toml_depth),
    "import_type": (lambda: C.import_type("t"), prompts.import_name),
}


@pytest.mark.parametrize("name", CASES)
def test_native_is_the_kernel(texts, name):
    native, kernel = CASES[name]
    found = texts.select("t", native().alias("x")).collect()
    wrong = [(r.t, r.x, kernel(r.t)) for r in found if r.x != kernel(r.t)]
    assert not wrong, wrong[:3]


def test_leaf_f1_is_the_kernel(spark):
    import json

    from sievework.functions import udfs

    source = random.Random(3)
    pairs = [tuple(json.dumps({k: source.randrange(3) for k in source.sample("abcd", source.randrange(5))}) for _ in "xy") for _ in range(80)]
    df = spark.createDataFrame(pairs, "a string, b string")
    f1 = udfs.leaf_f1(udfs.leaves("a", F.lit("JSON")), udfs.leaves("b", F.lit("JSON")))
    for row in df.select("a", "b", f1.alias("f1")).collect():
        # An empty object has no leaves; the canonical form keeps it an object.
        assert row.f1 == pytest.approx(trees.leaf_f1(json.loads(row.a), json.loads(row.b)))

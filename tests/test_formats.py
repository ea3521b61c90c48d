"""Kernels of reading, trees and scores, and the traps that decide results."""

import pytest

from sievework.functions import formats, prompts, scores, trees
from sievework.functions.formats import lenient, nothing_else, payload, strict

FENCE = "```"


def test_json_only():
    assert strict('{"a": 1}').ok and nothing_else('{"a": 1}')
    for text in (f'{FENCE}json\n{{"a": 1}}\n{FENCE}', f'{FENCE}json\n{{"a": 1}}\n{FENCE}\nHope this helps'):
        assert not nothing_else(text)
        assert strict(text).error == "markdown_fence"


def test_lenient_json_counts_one_bracket_type_outside_strings():
    assert lenient('Sure {"a": "}\\"}", "b": [1]} tail').value == {"a": '}"}', "b": [1]}
    assert lenient("[1, {2]").ok is False
    assert lenient('{"a": 1').ok is False
    assert lenient("nothing").ok is False


@pytest.mark.parametrize(
    ("name", "text", "used"),
    [
        ("YAML", "a: 1\nb: 2\n]]", "a: 1\nb: 2"),
        ("TOML", "a = 1\n[t]\nb = 2\n???", "a = 1\n[t]\nb = 2"),
        ("XML", "well: <a><b/></a>\ntrailing", "<a><b/></a>"),
        ("CSV", "a,b\n1,2", "a,b\n1,2"),
        ("YAML", f"text\n{FENCE}yaml\na: 1\n{FENCE}", "a: 1"),
    ],
)
def test_lenient_takes_the_longest_start(name, text, used):
    assert lenient(text, name).used == used


def test_yaml_scalars_are_read_but_not_structured():
    assert strict("plain prose", "YAML").ok and strict("", "YAML").ok
    assert not nothing_else("plain prose", "YAML")
    assert trees.scored_tree("plain prose", "YAML") == (False, None, False)
    assert trees.scored_tree("a: 1", "YAML") == (True, {"a": 1}, True)


def test_five_kinds_of_csv_strictness():
    one, uneven = "just a cell", "a,b\n1,2,3"
    assert strict(one, "CSV").ok and not lenient(one, "CSV").ok and not nothing_else(one, "CSV")
    assert strict(uneven, "CSV").ok and nothing_else(uneven, "CSV")
    assert not trees.scored_tree(uneven, "CSV")[2]
    assert trees.scored_tree("Sure!\na,b\n1,2", "CSV")[2]  # the rule looks at wide headers only
    assert formats.validate_answer(uneven, "CSV")[0] is False
    assert formats.check_syntax("a,b\n\n1,2", "CSV")[1] == "ValueError"


def test_fence_policies_differ():
    two = f"{FENCE}json\n1\n{FENCE}\n{FENCE}json\n2\n{FENCE}"
    assert formats.first_block(two)[0] == "1"
    assert formats.last_block(two) == "2"
    assert formats.answer_payload(two, "JSON") == "2"
    assert formats.labelled_payload(f"{FENCE}sh\nx\n{FENCE}\n{FENCE}yml\na: 1\n{FENCE}", "YAML") == ("a: 1", "fence:yml")
    assert formats.only_a_block(f" {FENCE}\n1\n{FENCE} ") and not formats.only_a_block(two)


def test_payload_of_unreadable_json_is_not_extraneous():
    assert payload("Sure: {", "JSON") == ("Sure: {", False)
    assert payload("Sure: [1] ok", "JSON") == ("[1]", True)
    assert payload(None, None) == ("", False)


def test_wildcards_and_nulls_of_paths():
    tree = {"museum": {"rooms": [{"id": 1, "art": [{"name": None}]}, {"id": 2}]}}
    text = '{"museum": {"rooms": [{"id": 1, "art": [{"name": null}]}, {"id": 2}]}}'
    paths = ["museum.rooms[*].id", "museum.*[0].art[*].name", "museum.rooms[1].id"]
    assert all(trees.path_exists(tree, path) for path in paths)
    assert scores.key_score(text, paths, "JSON")["final_eval_score"] == 1.0
    for bad in ("@id", "a b", "1st", "a::b", "", "museum.rooms[2]", "museum[0]"):
        assert not trees.path_exists(tree, bad)
    assert trees.path_exists({"@id": 1}, '["@id"]')


def test_score_without_paths_stays_below_a_fifth():
    found = scores.key_score('{"a": 1}', [], "JSON")
    assert found["final_eval_score"] == pytest.approx(0.2) and found["raw_output_eval"] == []
    assert scores.key_score('x {"a": 1}', ["a"], "JSON")["final_eval_score"] == pytest.approx(0.8)


def test_two_xml_mappings():
    import xml.etree.ElementTree as ET

    element = ET.fromstring('<a x="1">t<b>1</b><b>2</b><c/></a>')
    assert trees.element_tree(element) == {"@x": "1", "b": ["1", "2"], "c": {}, "#text": "t"}
    assert trees.wrapped_element(element) == {"a": {"@": {"x": "1"}, "b": [{"b": "1"}, {"b": "2"}], "c": {"c": ""}, "#text": "t"}}


def test_rewards_of_formats():
    good = {"YAML": "a: 1\nb: 2", "TOML": "a = 1", "XML": "<root><a>1</a></root>", "CSV": "a,b\n1,2", "JSON": '{"a": 1}'}
    for name, text in good.items():
        found = scores.components(text, name)
        assert found["parse"] == found["only"] == 1.0, name
    fenced = scores.components(f"{FENCE}yaml\na: 1\n{FENCE}", "YAML")
    assert (fenced["parse"], fenced["only"], fenced["extraneous"]) == (1.0, 0.0, 1.0)
    assert scores.components("a = 1", "TOML")["toml_canonical_soft"] == 1.0
    turned = scores.components("b = 1\na = 2", "TOML")
    assert turned["toml_canonical"] == 0.0 and 0 < turned["toml_canonical_soft"] < 1


def test_broken_toml_matches_nothing():
    gold = '[[planets]]\nname = "x"\n'
    broken = 'planets = [\n  {\n    name = "x"\n    mass = 1\n  }\n]'
    found = scores.components(broken, "TOML", gold)
    assert (found["parse"], found["match"], found["match_soft"]) == (0.0, 0.0, 0.0)
    assert scores.components(gold, "TOML", gold)["match"] == 1.0


def test_matching_follows_python_equality():
    assert scores.components('{"a": true}', "JSON", '{"a": 1.0}')["match"] == 1.0
    assert scores.components("<a/>", "XML", "<a/>")["match"] == 0.0  # elements compare by identity
    assert scores.components("<a/>", "XML", "<a/>")["match_soft"] == 1.0
    assert trees.canonical_text({"d": __import__("datetime").date(2024, 1, 1)}, "YAML").startswith("{'d'")


def test_weights_and_their_defaults():
    assert scores.weight({}, "w_schema_valid", "JSON") == 2.0
    assert scores.weight({"w_parse": 3, "w_parse_xml": 4}, "w_parse", "XML") == 4.0
    assert scores.weight({"p_only_json_fail": -7, "p_json_only_fail": -9}, "p_only", "JSON") == -7.0
    assert scores.weight({}, "p_only", "CSV") == -1.0


def test_article_checks_take_booleans_for_integers():
    assert trees.article_checks({"publication": {"year": True}})["publication_year_is_int"]
    two = {"authors": [{"name": "a", "affiliation": "b"}] * 2}
    assert trees.article_checks(two)["authors_len_is_2"] and trees.article_checks(two)["authors_items_ok"]
    assert not any(trees.article_checks([1]).values())


def test_toml_like_json():
    for text in ('{"a": 1}', "[1,2,3]"):
        assert trees.looks_like_json(text)
    for text in ("a = 1", "[public]", "[[items]]", "{ k = 1 }", "", None):
        assert not trees.looks_like_json(text)
    assert trees.json_to_toml('{"a": null}')[1] == 'a = ""\n'
    assert trees.json_to_toml('[{"a": 1}]')[1] == "[[root]]\na = 1\n"
    assert trees.json_to_toml("{")[0] is False


def test_canonical_toml():
    text = trees.toml_text({"z": 1, "t": {"s": {"x": 1.5}}, "l": [{"b": 2}, {"a": [1, "q\n"]}], "n": None})
    assert text == 'n = ""\nz = 1\n\n[t]\n[t.s]\nx = 1.5\n\n[[l]]\nb = 2\n\n[[l]]\na = [1, "q\\n"]\n'
    assert trees.canonical_toml(text)[1]
    assert trees.toml_text({"a b": 1}) == "a b = 1\n"  # keys stay bare, even if that is no TOML
    with pytest.raises(TypeError):
        trees.toml_text([1])
    for value, shown in ((float("inf"), "inf"), (float("nan"), "nan"), (True, "true"), ([], "[]")):
        assert trees.toml_value(value) == shown


def test_toml_depth():
    assert trees.toml_depth("[a.b.c]\n[[d . e]]\nf.g = 1 # [x.y.z.w]") == 3
    with pytest.raises(ValueError):
        trees.toml_is_deep("a = 1", 1)


def test_leaves_and_f1():
    assert trees.leaves({"a": [{"b": 1}, 2]}) == [("a[0].b", "1"), ("a[1]", "2")]
    assert trees.leaves(5) == [("$", "5")]
    assert trees.leaf_f1({}, {}) == 1.0 and trees.leaf_f1({}, {"a": 1}) == 0.0


def test_target_rules_in_order():
    cases = {
        "convert from yml to toml": "toml",
        "transform json to csv": "csv",
        "json to csv": None,
        "return it into xml": "xml",
        "respond as yaml": "yaml",
        "create it in toml format": "toml",
        "generate a csv": "csv",
        "only xml here": "xml",
        "json or xml": None,
    }
    assert {prompt: prompts.target_format(prompt) for prompt in cases} == cases


def test_inline_payloads():
    assert prompts.inline_payload(f"Do:\n{FENCE}json\n[1]\n{FENCE}") == "[1]"
    assert prompts.inline_payload("Convert this:\na,b\n1,2") == "a,b\n1,2"
    assert prompts.inline_payload('see {"a": [1, 2]} ok') == '{"a": [1, 2]}'
    assert prompts.inline_payload("a\nb\nc\nd") == "c\nd"
    assert prompts.inline_payload(None) == ""


def test_conversion_policy():
    csv = "Convert from CSV to JSON:\na,b\n1,2"
    assert prompts.keep(csv, "JSON", '[["a", "b"], ["1", "2"]]') == (True, "keep")
    assert prompts.keep(csv, "JSON", '[{"a": "1"}]') == (False, "equiv_fail:semantic_mismatch")
    assert prompts.keep("Output TOML from this text: a=1 b=2", "TOML", "a = 1") == (True, "keep")
    assert prompts.equivalence("x", "json", "{").result == "FAIL"
    assert prompts.equivalence("nothing", "json", "{}").result == "UNKNOWN"
    soft = prompts.equivalence("Convert from XML to JSON:\n<a><b>1</b></a>", "json", '{"a": {"b": {"b": "1"}}}')
    assert soft.result == "PASS"


def test_attributes_are_listed_once():
    assert prompts.attributes("ATTRIBUTES: a, b,\nc.d, a\n\ne") == ["a", "b", "c.d"]
    assert prompts.attributes(None) == []


def test_final_output():
    assert formats.final_output("Think.\nOutput:\na: 1", "YAML") == "a: 1"
    assert formats.final_output('{"a": [1}', "JSON") == '{"a": [1}'
    assert formats.final_output("pre <a>1</a> post", "XML") == "<a>1</a>"
    assert formats.final_output("no structure", "CSV") == "no structure"


def test_yaml_style():
    assert formats.yaml_indent_is_canonical("a:\n  - b: 1\n  - c: 2")
    assert not formats.yaml_indent_is_canonical("a:\n   b: 1")
    assert not formats.yaml_indent_is_canonical("")
    assert formats.yaml_is_flow("a: [1]") and not formats.yaml_is_flow("a: 1")


def test_schema_subset():
    from sievework.functions.schema import errors

    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "integer"}, "minItems": 1}}}
    assert list(errors({"a": [1]}, schema)) == []
    assert len(list(errors({"a": ["x"]}, schema))) == 1
    assert len(list(errors({"a": []}, schema))) == 1
    assert len(list(errors({}, schema))) == 1
    assert len(list(errors(True, {"type": "integer"}))) == 1
    assert list(errors(2, {"anyOf": [{"const": 1}, {"minimum": 2}], "not": {"enum": [3]}})) == []

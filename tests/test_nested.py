from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators.nested import TableSpec, group_fields, nodes, pivot_group, record_triples, struct_payload, triples


def paths(payload, labelled=False):
    return [(t[1], t[2]) for t in record_triples(payload, labelled) if t[4] == "" and t[1] is not None]


@pytest.mark.parametrize("payload", [None, "", "{", "[1, 2", '{"a": NaN}', '{"a": 1}', "3", "null", '{"a": [1, [2, 3]]}', "[" * 100_000, "[" * 100_000 + "]" * 100_000])
def test_no_nodes(payload):
    assert paths(payload) == []


def test_shapes_of_the_same_part():
    element = {"symbol": "a", "pages": [{"offset": 0}, None, {"offset": 5}]}
    want = [("", "r[0]"), ("r[0]", "r[0].pages[0]"), ("r[0]", "r[0].pages[2]")]
    for part in ([element], element, json.dumps([element])):
        assert paths(json.dumps({"r": part})) == want
    assert paths(json.dumps({"r": [None, element]}))[0] == ("", "r[1]")
    assert paths(json.dumps({"r": json.dumps(element)})) == []  # an object written as text is a text


def test_labels_have_no_position():
    payload = {"a-run": {"attempts": {"no": 1, "toolCalls": [{"tool": "x"}]}}, "b-run": None}
    assert paths(json.dumps(payload), True) == [
        ("", "a-run"),
        ("a-run", "a-run.attempts[0]"),
        ("a-run.attempts[0]", "a-run.attempts[0].toolCalls[0]"),
    ]


def test_tables_keep_parents_and_ignore_extra_columns(spark):
    rows = [
        (1, json.dumps({"r": [{"s": "x", "n": "12", "pages": [{"o": 1}]}, {"s": None, "n": 3}]}), "extra"),
        (2, json.dumps({"r": {"s": "\ud800é"}}), None),
        (3, None, None),
        (4, "broken", None),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, payload string, node_path string")
    found = triples(df, "t")
    assert {tuple(r) for r in nodes(found).collect()} == {
        ("t", 1, "", "r[0]"),
        ("t", 1, "r[0]", "r[0].pages[0]"),
        ("t", 1, "", "r[1]"),
        ("t", 2, "", "r[0]"),
    }
    table = pivot_group(found, TableSpec("r", {"s": ("s", "string"), "n": ("n", "bigint")}))
    assert {(r.record_id, r.ordinal, r.s, r.n) for r in table.collect()} == {(1, 0, "x", 12), (1, 1, None, 3), (2, 0, "?é", None)}
    assert group_fields(found).where("field = 'o'").first().nodes == 1


def test_empty_table_and_typed_columns(spark):
    assert nodes(triples(spark.createDataFrame([], "record_id bigint, payload string"), "t")).count() == 0
    df = spark.sql("select 1L as id, array(named_struct('a', 1), null, named_struct('a', null)) as items union all select 2L, null")
    found = triples(struct_payload(df, "id", "items"), "t")
    assert [r.node_path for r in nodes(found).orderBy("node_path").collect()] == ["items[0]", "items[2]"]


def test_long_text_and_many_elements(spark):
    payload = json.dumps({"r": [{"s": "x" * 1000}] * 30_000})
    df = spark.createDataFrame([(1, payload)], "record_id bigint, payload string")
    assert nodes(triples(df, "t")).agg(F.countDistinct("node_path")).first()[0] == 30_000


def test_an_array_written_as_text_behind_many_blanks():
    assert paths(json.dumps({"r": " " * 5000 + '[{"a": 1}]'})) == [("", "r[0]")]


def test_values_of_plain_arrays_of_arrays_are_kept():
    assert ("", None, "", 0, "m", "[[1, 2], [3]]", "array") in record_triples('{"m": [[1, 2], [3]]}', False)
    assert paths('{"m": [[1, {"a": 1}], 3, [[{"b": 2}]]]}') == [("", "m[0][1]"), ("", "m[2][0][0]")]


def test_the_last_value_of_a_repeated_key_counts():
    rows = record_triples('{"a": {"x": 1}, "b": 2, "a": {"y": 3}}', False)
    assert {(t[2], t[4]) for t in rows} == {("", ""), ("", "b"), ("a[0]", ""), ("a[0]", "y")}


def test_deep_objects_are_read_to_the_end():
    depth = 3000
    assert len(paths('{"a":' * depth + "1" + "}" * depth)) == depth - 1


def test_the_streaming_parser_takes_what_json_takes():
    rnd = random.Random(7)
    good = ['{"a": [1, -2.5e3, {"b": null}, "x\\u00e9\\n"], "c": {}, "d": [], "e": true}', '{"r":[{"s":"[1]"},null,{"t":[[]]}],"n":0}', ' {"k" : "[{\\"q\\": 1}]" } ']
    for _ in range(6000):
        text = list(rnd.choice(good))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(text))
            text[at : at + rnd.randint(0, 2)] = rnd.choice(['"', "{", "}", "[", "]", ",", ":", "1", "0", "-", " ", "\n", "e", "\x00", "t", ""])
        text = "".join(text)
        try:
            fits = isinstance(json.loads(text, parse_constant=lambda c: 1 / 0), dict)
        except (ValueError, ZeroDivisionError):
            fits = False
        assert bool([t for t in record_triples(text, False) if t[1] is None and t[2] == ""]) == fits, text


def test_a_new_field_and_clashing_names_get_columns(spark):
    rows = [(1, json.dumps({"r": [{"s": 1, "newField": 5, "ordinal": True, "big": 10**20, "w": 0.5, "mix": 1}]})), (2, json.dumps({"r": [{"newField": 6, "mix": "x", "w": 2}]}))]
    found = triples(spark.createDataFrame(rows, "record_id bigint, payload string"), "t")
    table = pivot_group(found, TableSpec("r", {"s": ("s", "string")}))
    kinds = dict(table.dtypes)
    assert (kinds["new_field"], kinds["ordinal_2"], kinds["big"], kinds["w"], kinds["mix"]) == ("bigint", "boolean", "decimal(38,0)", "double", "string")
    assert {(r.record_id, r.s, r.new_field, r.ordinal_2, r.mix, r.w) for r in table.collect()} == {(1, "1", 5, True, "1", 0.5), (2, None, 6, None, "x", 2.0)}

from __future__ import annotations

import json

from sieveline.operators.drift import changes, consistent_table, file_headers, fold, leaves

SCHEMA = "harness string, file_kind string, batch int, file_name string, written_at timestamp_ntz, payload string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(h, k, b, f, None, p if p is None or isinstance(p, str) else json.dumps(p), "x") for h, k, b, f, p in rows], SCHEMA)


def log(spark, rows):
    found = changes(file_headers(frame(spark, rows)))
    return {(r.harness, r.batch, r.change_kind, r.field_path, r.new_path) for r in found.collect()}


def test_leaf_paths():
    record = {"a": {"b": 1}, "r": [{"x": 1}, None, {"x": 2, "y": []}], "e": {}, "z": [1, None]}
    assert leaves(record) == {"a.b": [1], "r[].x": [1, 2], "r[].y": [[]], "z": [[1, None]]}


def test_each_kind_of_change_and_skipped_batches(spark):
    rows = [
        ("h", "m", 1, "f1", {"taskId": "T1", "n": 1, "gone": "x", "same": None}),
        ("h", "m", 1, "f2", {"taskId": "T2", "n": 2, "gone": "y", "same": True}),
        ("h", "m", 4, "f1", {"task": {"id": "T1"}, "n": "1", "fresh": "new", "same": None}),
        ("h", "m", 4, "f1", {"task": {"id": "T1"}, "n": "1", "fresh": "new", "same": None}),
        ("h", "m", 4, "f3", {"task": {"id": "T9"}, "n": "7", "fresh": "old", "same": False}),
        ("h", "m", 4, "f4", "{broken"),
        ("h", "m", 3, "f4", None),
    ]
    assert log(spark, rows) == {
        ("h", 4, "renamed", "taskId", "task.id"),
        ("h", 4, "retyped", "n", ""),
        ("h", 4, "removed", "gone", ""),
        ("h", 4, "added", "fresh", ""),
    }


def test_without_shared_files_only_the_spelling_tells(spark):
    rows = [("h", "m", 1, "a", {"timedOut": True, "alpha": 1}), ("h", "m", 2, "b", {"timed_out": False, "beta": 2})]
    assert log(spark, rows) == {("h", 2, "renamed", "timedOut", "timed_out"), ("h", 2, "removed", "alpha", ""), ("h", 2, "added", "beta", "")}


def test_other_content_or_type_is_no_rename(spark):
    rows = [("h", "m", 1, "a", {"x": "u", "y": 5}), ("h", "m", 2, "a", {"z": "v", "w": "5"})]
    assert {(c, p) for _, _, c, p, _ in log(spark, rows)} == {("removed", "x"), ("removed", "y"), ("added", "z"), ("added", "w")}


def test_one_consistent_table(spark):
    rows = [
        ("h", "m", 1, "a", {"id": "T1", "n": 1, "r": [{"k": True}, {"k": None}]}),
        ("h", "m", 2, "a", {"task": {"id": "T1"}, "n": "1", "r": [{"k": False}]}),
        ("h", "m", 2, "a", {"task": {"id": "T1"}, "n": "1", "r": [{"k": False}]}),
        ("h", "other", 2, "a", {"q": 1}),
        ("h", "m", 2, "b", "{"),
    ]
    files = frame(spark, rows)
    headers = file_headers(files)
    table = consistent_table(files, headers, changes(headers), "m")
    got = sorted(((r.batch, r["task.id"], r["n"], r["r[].k"]) for r in table.collect()), key=str)
    assert got == [(1, "T1", "1", [True, None]), (2, "T1", "1", [False])]
    assert {(r.path, r.type) for r in fold(headers, "file_kind").where("file_kind = 'm'").collect()} >= {("n", "string"), ("r[].k", "boolean")}


def test_empty_table(spark):
    assert log(spark, []) == set()


def table_of(spark, rows, kind="m"):
    files = frame(spark, rows)
    headers = file_headers(files).cache()
    return consistent_table(files, headers, changes(headers), kind)


def test_a_rename_elsewhere_merges_no_two_fields_of_one_file(spark):
    rows = [
        ("a", "m", 1, "f", {"timedOut": True}),
        ("a", "m", 2, "f", {"timed_out": True}),
        ("b", "m", 1, "f", {"timedOut": True, "timed_out": False}),
        ("c", "m", 1, "f", {"timed_out": False}),
    ]
    got = {(r.harness, r.batch, r.timedOut, r.timed_out) for r in table_of(spark, rows).collect()}
    assert got == {("a", 1, None, True), ("a", 2, None, True), ("b", 1, True, False), ("c", 1, None, False)}


def test_numbers_keep_their_digits(spark):
    wide = 9007199254740993
    rows = [
        ("h", "m", 1, "a", {"n": wide, "x": 1, "y": wide, "z": 10**30}),
        ("h", "m", 1, "b", {"n": 2, "x": 0.5, "y": 0.5, "z": 1}),
    ]
    table = table_of(spark, rows)
    assert dict(table.dtypes)["n"] == "bigint" and dict(table.dtypes)["x"] == "double"
    assert {(r.n, r.x, r.y, r.z) for r in table.collect()} == {(wide, 1.0, str(wide), str(10**30)), (2, 0.5, "0.5", "1")}


def test_no_value_of_a_path_is_lost(spark):
    rows = [
        ("h", "m", 1, "a", {"r": [{"id": 1}, {"id": 2}], "a.b": 1, "a": {"b": 2}}),
        ("h", "m", 2, "a", {"id": [1, 2], "a": {"b": 3}}),
        ("h", "m", 3, "a", {"r": [{"id": 7}, {"id": 8}]}),
    ]
    got = {r.batch: r for r in table_of(spark, rows).collect()}
    assert got[1]["r[].id"] == [1, 2] and got[1]["a.b"] == [1, 2] and got[2]["id"] == ["1", "2"] and got[3]["r[].id"] == [7, 8]


def test_fields_that_come_back_and_batches_without_them(spark):
    rows = [("h", "m", b, "f", {"k": 1, **({"v": b} if b in (1, 3, 7) else {})}) for b in (1, 2, 3, 7, 9)]
    assert log(spark, rows) == {("h", 2, "removed", "v", ""), ("h", 3, "added", "v", ""), ("h", 9, "removed", "v", "")}

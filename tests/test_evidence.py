from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.operators import evidence as E
from sieveline.operators import patch as M


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_delta_round_trip(before, after):
    at, gone, insert = E.delta_of(before, after)
    assert before[:at] + insert + before[at + gone :] == after


@given(st.text(alphabet="ab", max_size=30), st.text(alphabet="ab", max_size=30))
def test_delta_is_shortest_by_prefix_and_suffix(before, after):
    at, gone, insert = E.delta_of(before, after)
    start = 0
    while start < min(len(before), len(after)) and before[start] == after[start]:
        start += 1
    assert at == start
    assert not (gone and insert and before[at + gone - 1] == insert[-1])


RECORDS = "evidence_id bigint, project string, file string, snapshot string, kind string, symbol string, text string"


def test_deltas_and_pages_in_spark(spark):
    rows = [(1, "p", "f", "s", None, None, "a😀b" * 400), (2, "p", "f", "s", None, None, "a😀b" * 399 + "x"), (3, "p", "f", "s", None, None, ""), (4, "p", "g", "s", None, None, None)]
    records = spark.createDataFrame(rows, RECORDS)
    applied = E.apply_deltas(E.create_deltas(E.successive(records))).collect()
    assert {(r.evidence_id, r.prev_id, r.intact) for r in applied} == {(2, 1, True), (3, 2, True)}
    pages = E.pages(records).orderBy("evidence_id", "page").collect()
    assert "".join(r.source for r in pages if r.evidence_id == 1) == rows[0][6]
    assert [(r.page, r.done, r.next_offset) for r in pages if r.evidence_id == 3] == [(0, True, None)]
    broken = E.create_deltas(E.successive(records)).withColumn("before", F.lit("other"))
    assert not any(r.intact for r in E.apply_deltas(broken).collect())


def test_store_is_idempotent(spark):
    records = spark.createDataFrame([(1, "p", "f", "s", None, None, "x"), (2, "p", "f", "s", None, None, "x"), (3, "p", "f", "s", None, None, None)], RECORDS)
    new = E.append_new(spark.createDataFrame([], "ref string"), records)
    assert [r.evidence_id for r in new.collect()] == [1]
    assert E.append_new(new, records).count() == 0


def test_edits(spark):
    text = "class A\r\nbody\r\nclass B\r\nend"
    files = spark.createDataFrame([(1, "p", "f", text), (2, "p", "g", text)], "file_id bigint, project string, relative string, text string")
    places = [(1, "A", 0, 15), (1, "B", 15, 27), (2, "A", 0, 15), (2, "B", 10, 27), (2, "C", 1, 2), (2, "C", 3, 4)]
    symbols = spark.createDataFrame(places, "file_id bigint, symbol string, start int, end int")
    columns = "op_id bigint, file_id bigint, symbol string, operation string, content string, content_hash string"
    operations = spark.createDataFrame(
        [(1, 1, "A", "replace_symbol", "new\n", None), (2, 1, "B", "insert_before_symbol", "// b\n", None), (3, 2, "A", "delete_symbol", None, None), (4, 2, "B", "delete_symbol", None, None)], columns
    )
    resolved = M.resolve(operations, symbols, files)
    assert {r.file_id: (r.overlapping, r.applicable) for r in M.plan(resolved).collect()} == {1: (False, True), 2: (True, False)}
    assert {r.file_id: r.patched for r in M.splice(resolved, files).collect()} == {1: "new\r\n// b\r\nclass B\r\nend"}
    refused = spark.createDataFrame(
        [(1, 9, "A", "delete_symbol", None, None), (2, 1, "Z", "delete_symbol", None, None), (3, 2, "C", "delete_symbol", None, None), (4, 1, "A", "delete_symbol", None, "stale"), (5, 1, "A", "move", None, None)], columns
    )
    codes = {r.op_id: r.code for r in M.resolve(refused, symbols, files).collect()}
    assert codes == {1: "FILE_NOT_FOUND", 2: "SYMBOL_NOT_FOUND", 3: "AMBIGUOUS_SYMBOL", 4: "STALE_CONTENT", 5: "UNSUPPORTED_OPERATION"}
    journal = files.select("file_id", F.sha2("text", 256).alias("original_hash"), F.lit("h").alias("patched_hash"))
    assert {r.state for r in M.rollback_states(files, journal).collect()} == {"original"}
    messages = spark.createDataFrame([("g", i, "x" * 40) for i in range(5)], "g string, i int, t string")
    assert M.capped_prefix(messages, ["g"], "i", "t", 25).count() == 2


def test_bodies_and_hashes_of_symbols(spark):
    from sieveline.operators import index as I

    text = "export function add(a, { b } = {}) {\n  return a + b;\n}\nexport const x = 1;\n"
    files = spark.createDataFrame([(1, "p", "f.ts", text)], "file_id bigint, project string, relative string, text string")
    symbols = I.symbols(files).cache()
    known = symbols.where("symbol = 'add'").select(F.sha2("source_text", 256)).first()[0]
    columns = "op_id bigint, file_id bigint, symbol string, operation string, content string, content_hash string, symbol_hash string"

    def resolved(*operations):
        return M.resolve(spark.createDataFrame(list(operations), columns), symbols, files)

    good = resolved((1, 1, "add", "replace_function_body", "\n  return 0;\n", None, known))
    assert M.splice(good, files).first().patched == "export function add(a, { b } = {}) {\n  return 0;\n}\nexport const x = 1;\n"
    bad = resolved((1, 1, "add", "delete_symbol", None, None, "old"), (2, 1, "x", "replace_function_body", "y", None, None))
    assert {r.op_id: r.code for r in bad.collect()} == {1: "STALE_SYMBOL", 2: "NO_BODY"}

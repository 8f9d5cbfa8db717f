from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import review as V


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


def terms(spark, task):
    return [t["term"] for t in one(spark, X.query_terms(F.col("t")), t=task)]


def test_tokens(spark):
    got = one(spark, X.tokenize(F.col("t")), t="getHTTPResponse_code for Çağrı/İzin.ts a x9 getHTTPResponse")
    assert got == ["get", "http", "response", "cagri", "izin", "ts", "x9"]
    assert one(spark, X.tokenize(F.col("t")), t="") == []


@pytest.mark.parametrize(
    ("task", "there", "absent"),
    [
        ("sesli oda katilma hatasi", {"voice", "room", "join", "error", "sesli"}, set()),
        ("silent mode", {"silent"}, {"delete", "remove", "destroy"}),
        ("listen for events", {"listen"}, {"list", "collection"}),
        ("indirect dependency", {"indirect"}, {"download", "fetch"}),
        ("odata endpoint", {"odata"}, {"room", "channel"}),
    ],
)
def test_expansions(spark, task, there, absent):
    got = set(terms(spark, task))
    assert there <= got and not absent & got


def test_synonyms_share_a_concept(spark):
    got = one(spark, X.query_terms(F.col("t")), t="hata error fix")
    concepts = {t["term"]: t["concept"] for t in got}
    assert {concepts[t] for t in ("hata", "error", "exception", "fault", "bug")} == {0} and concepts["fix"] == 1


def test_language_and_clause(spark):
    language = X.task_language(F.col("t"))
    assert one(spark, language, t="the ve test") == "en"
    assert one(spark, language, t="davranisini ve geriye uyumlulugu duzelt") == "tr"
    assert one(spark, language, t="düzelt") == "tr"
    assert one(spark, X.task_clause(F.col("t")), t="Fix it. Success criteria: tests pass") == "Fix it. "
    assert one(spark, X.task_clause(F.col("t")), t="Fix it") == "Fix it"


def test_path_prior_swing(spark):
    path = F.col("p")
    swing = X.static_path_prior(path, F.lit(True)) - X.static_path_prior(path, F.lit(False))
    assert one(spark, F.round(swing, 6), p="test/cache.test.ts") == pytest.approx(7.4)


def test_directories_and_bundles(spark):
    skipped = X.in_skipped_directory(F.col("p"))
    for path, want in [("src/a.ts", False), ("dist/a.js", True), ("dist-tauri/a.js", True), ("distributed/a.ts", False), ("outbox/a.ts", False), ("a/node_modules/b.js", True), ("dist", False)]:
        assert one(spark, skipped, p=path) is want
    bundle = X.is_bundle(F.col("t"))
    assert one(spark, bundle, t="x" * 30_000) and not one(spark, bundle, t="x\n" * 30_000) and not one(spark, bundle, t="x" * 100)
    assert one(spark, bundle, t="short\n" * 10_000 + "y" * 300_000)


def test_line_ends_and_lines(spark):
    matched = X.match_line_endings(F.col("v"), F.col("t"))
    assert one(spark, matched, v="a\nb", t="x\r\ny") == "a\r\nb"
    assert one(spark, matched, v="a\r\nb", t="x\ny") == "a\nb"
    assert one(spark, matched, v="a\r\nb", t="xy") == "a\r\nb"
    assert one(spark, X.line_of(F.col("t"), F.lit(4)), t="a\nb\nc") == 3
    assert one(spark, X.name_tail(F.col("t")), t="A.b#c") == "c"
    assert one(spark, X.token_estimate(F.col("t")), t="") == 1


def test_model_answers(spark):
    array = V.json_array(F.col("t"))
    assert one(spark, array, t="<think>[1</think> ```json\n[{\"a\": 1}]\n```") == '[{"a": 1}]'
    assert one(spark, array, t='[{"a": 1}, {"b"') is None
    assert one(spark, array, t="nothing") is None
    error = V.edit_error(F.col("t"))
    assert one(spark, error, t='[{"operation": "delete_symbol", "file": "a", "symbol": "b"}]') is None
    assert one(spark, error, t='[{"operation": "drop", "file": "a", "symbol": "b"}]') == "UNKNOWN_OPERATION"
    assert one(spark, error, t='[{"operation": "replace_symbol", "file": "a", "symbol": "b"}]') == "NO_PAYLOAD"
    assert one(spark, error, t="x") == "NO_ARRAY"


def test_reviews_and_diagnostics(spark):
    signature = V.diagnostic_signature(F.col("t"))
    assert one(spark, signature, t="a\\b.ts(1,2): error TS10: bad ") == one(spark, signature, t="a/b.ts(9,9): error TS10: bad")
    assert one(spark, signature, t="fine") is None
    assert one(spark, V.assignment(F.col("t")), t="T01") in ("X", "Y")
    row = spark.createDataFrame([({"correctness": 5, "completeness": 4, "regression_risk": 3, "test_quality": 2, "maintainability": 1},)], "s struct<correctness:int,completeness:int,regression_risk:int,test_quality:int,maintainability:int>")
    assert row.select(V.review_total(F.col("s")).alias("t")).first().t == 15
    diff = spark.createDataFrame([("T1", "diff --git a\n1\ndiff --git b\n2\n")], "k string, d string")
    got = V.anonymous_diff(diff, "k", "d").first().d
    assert sorted(got.split("diff --git ")) == sorted("diff --git a\n1\ndiff --git b\n2\n".split("diff --git "))
    patterns = spark.createDataFrame([("t", "Foo.*"), ("t", "gone")], "key string, pattern string")
    evidence = spark.createDataFrame([("t", "class foobar"), ("u", "gone")], "key string, text string")
    assert [r.pattern for r in V.dead_patterns(patterns, evidence).collect()] == ["gone"]


def test_semantic_extras_come_behind_the_first_three(spark):
    direct = spark.createDataFrame([("t", i, f"f{i}") for i in range(1, 6)], "task_id string, pos int, file string")
    similar = spark.createDataFrame([("t", "f1", 0.9), ("t", "g", 0.8), ("t", "h", 0.7), ("u", "g", 0.5)], "task_id string, file string, score double")
    got = V.with_semantic(direct, similar, 1).orderBy("task_id", "pos").collect()
    assert [(r.task_id, r.file) for r in got] == [("t", "f1"), ("t", "f2"), ("t", "f3"), ("t", "g"), ("t", "f4"), ("t", "f5"), ("u", "g")]

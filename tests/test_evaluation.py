from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import evaluation as R
from sieveline.operators import vectors as V
from sieveline.sources import usage as U

REQUEST = "array<struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint,input_includes_cache:boolean>>"


@pytest.mark.parametrize(
    ("requests", "total"),
    [
        ([(1000, 100, 900, 0, True)], 1100),
        ([(1000, 100, 900, 0, False)], 2000),
        ([(1000, 100, None, 0, False)], None),
        ([(1000, 100, None, None, True)], 1100),
        ([(1000, -1, 0, 0, True)], None),
        ([(1, 1, 1, 1, None)], None),
        ([(1, 1, 1, 1, True), None], None),
        ([], None),
        (None, None),
    ],
)
def test_totals(spark, requests, total):
    df = spark.createDataFrame([(requests,)], f"requests {REQUEST}")
    assert df.select(R.total_usage(F.col("requests")).alias("t")).first().t == total


def test_ranks_against_sorting(spark):
    random.seed(3)
    values = [(g, random.choice([None, round(random.gauss(0, 50), 2), 1e9, 7.0])) for g in ("a", "b", "c") for _ in range(500)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(values, "g string, v double")
    for buckets in (1, 16, 1024):
        got = {r.g: (r.mid, r.p95) for r in R.select_ranks(df, "v", ["g"], {"mid": F.floor(F.col("n") / 2) + 1, "p95": F.ceil(F.col("n") * 0.95)}, buckets).collect()}
        want = {}
        for g in ("a", "b", "c", "one"):
            s = sorted(v for k, v in values if k == g and v is not None)
            want[g] = (s[len(s) // 2], s[math.ceil(0.95 * len(s)) - 1])
        assert got == want


def test_comparison(spark):
    runs = f"task_id string, repetition int, passed boolean, protected_inputs_unchanged boolean, requests {REQUEST}"
    ok, bad = [(10, 0, 0, 0, True)], None
    before = spark.createDataFrame([("a", 1, True, True, ok), ("b", 1, True, True, ok), ("c", 1, False, True, ok)], runs)
    after = spark.createDataFrame([("a", 1, False, True, ok), ("b", 1, True, True, bad), ("d", 1, True, True, ok)], runs)
    cases = R.compare(before, after, 100)
    assert {(r.task_id, r.paired, r.regression, r.reduction) for r in cases.collect()} == {("a", True, True, 0.0), ("b", True, False, None), ("c", False, False, None), ("d", False, False, None)}
    summary = R.comparison_summary(cases).first()
    assert (summary.cases, summary.regressions, summary.unmeasured, summary.accepted, summary.median_tokens) == (4, 1, 3, False, 10.0)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(150, 8))
    m[7] = m[8]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for block in (2, 4096):
        got = {(r.query_id, r.rank): r.vec_id for r in V.top_k(df, df.where("vec_id % 50 = 0 and vec_id < 150"), 5, block=block).collect()}
        for q in (0, 50, 100):
            order = sorted(range(150), key=lambda i: (-round(float(m[q] @ m[i]), 6), i))[:5]
            assert [got[q, r] for r in range(1, 6)] == order
    assert V.top_k(df, df.limit(0)).count() == 0


def test_usage_files(spark, tmp_path):
    lines = ['{"t": "2026-01-01T00:00:00Z", "tool": "a", "duration_ms": 5, "task": "' + "x" * 300 + '"}', "broken", '{"tool": "b"}', ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "u.jsonl").write_text("\n".join(lines))
    calls = U.read_usage(spark, str(tmp_path / "in"))
    assert sorted(r.tool for r in calls.collect()) == ["a", "b"]
    U.write_usage(calls, str(tmp_path / "out"))
    assert U.read_usage(spark, str(tmp_path / "out")).agg(F.max(F.length("task"))).first()[0] == 200
    trace = spark.createDataFrame([(1, 1, '{"type":"turn.completed","usage":{"input_tokens":1}}'), (1, 2, '{"type":"turn.completed","usage":{"input_tokens":2}}'), (1, 3, "x")], "id int, n int, line string")
    assert U.last_usage(trace, ["id"], "n", "line").first().input_tokens == 2


def test_tree_scan(spark, tmp_path):
    for path, text in {"src/a.ts": "export const a = 1", "dist/b.js": "x", "nested/.git/config": "", "nested/c.ts": "x", "README.md": "x", "src/é b.ts": "y", "package.json": "{}", "big.js": "z" * 30_000}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    found, truncated = U.scan_tree(spark, str(tmp_path))
    assert {r.relative for r in found.collect()} == {"src/a.ts", "src/é b.ts", "package.json"} and not truncated
    found, truncated = U.scan_tree(spark, str(tmp_path), most_files=1)
    assert truncated
    directories = spark.createDataFrame([("logs",), ("a/logs",), ("keep/logs",), ("src",), ("x.tmp",)], "directory string")
    rules = U.ignore_rules("# c\nlogs/\n!keep/logs\n*.tmp\n")
    assert {r.directory for r in U.ignored(directories, rules).where("ignored").collect()} == {"logs", "a/logs", "x.tmp"}


def test_tree_scan_follows_ignore_files_and_passes_over_dangling_links(spark, tmp_path):
    for path, text in {".gitignore": "logs/\n!keep/logs\n", "sub/.gitignore": "out_here\n", "logs/a.ts": "1", "keep/logs/b.ts": "2", "sub/out_here/c.ts": "3", "sub/d.ts": "4", "out_here/e.ts": "5"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (tmp_path / "gone.ts").symlink_to(tmp_path / "nowhere.ts")
    found, truncated = U.scan_tree(spark, str(tmp_path))
    assert {r.relative for r in found.collect()} == {"keep/logs/b.ts", "sub/d.ts"} | ({"out_here/e.ts"} if not U._skipped("out_here") else set()) and not truncated


def test_ranks_with_outliers(spark):
    values = [*range(1, 1001), 10**15, -(10**15)]
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = R.select_ranks(df, "v", ["g"], {"a": F.lit(1), "b": F.lit(501), "c": F.col("n")}).first()
    assert (got.a, got.b, got.c) == (-1e15, 500.0, 1e15)

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieveline.operators import index as I
from sieveline.operators import ranking as R

FILES = [
    (1, "p", "src/cache.ts", 'import { read } from "./store.js";\nexport class ResponseCache {\n  get(key) { return read(key); }\n}\n'),
    (2, "p", "src/store.ts", "export function read(key) {\n  return key;\n}\nexport interface StoreKey { id: string }\n"),
    (3, "p", "test/cache.test.ts", 'import { ResponseCache } from "../src/cache";\nexport function responseCacheExpires() { return new ResponseCache(); }\n'),
    (4, "p", "docs/empty.ts", ""),
    (5, "p", "docs/null.ts", None),
    (6, "q", "src/store.ts", "def read(key):\n    pass\n"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    files = spark.createDataFrame(FILES, "file_id bigint, project string, relative string, text string")
    symbols = I.symbols(files).cache()
    tokens = I.fields(symbols).cache()
    return files, symbols, tokens


def ranked(spark, corpus, task):
    _, symbols, tokens = corpus
    found = R.tasks(spark.createDataFrame([(1, task, "p")], "id bigint, text string, project string"), "id", "text")
    return found, R.rank(R.scores(found, symbols, tokens, I.doc_freq(tokens), I.corpus_stats(tokens)), symbols)


def test_symbols_and_edges(corpus):
    files, symbols, _ = corpus
    assert {(r.file_id, r.symbol, r.kind) for r in symbols.collect()} == {
        (1, "ResponseCache", "class"), (1, "get", "method"), (2, "read", "function"), (2, "StoreKey", "interface"), (3, "responseCacheExpires", "function"), (6, "read", "function"),
    }
    assert {(r.src, r.dst) for r in I.resolved_imports(files).collect()} == {("src/cache.ts", "src/store.ts"), ("test/cache.test.ts", "src/cache.ts")}
    kinds = {(r.src, r.dst, r.kind) for r in I.edges(files, symbols).collect()}
    assert ("src/store.ts", "src/cache.ts", "imported_by") in kinds and ("src/cache.ts", "src/store.ts", "call") in kinds


def test_tests_fall_behind_and_their_subject_is_promoted(spark, corpus):
    found, top = ranked(spark, corpus, "response cache expires")
    files = {r.pos: r.file for r in R.promote(top, found, I.resolved_imports(corpus[0])).collect()}
    assert files[1] == "src/cache.ts"
    found, top = ranked(spark, corpus, "test that the response cache expires")
    assert top.where("pos = 1").first().file == "test/cache.test.ts"


def test_no_match_and_confidence(spark, corpus):
    found, top = ranked(spark, corpus, "zzz qqq")
    assert top.count() == 0
    judged = R.confidence(top, found, corpus[2]).first()
    assert judged.confidence == 0.28 and judged.reasons == ["no_match"]
    found, top = ranked(spark, corpus, "read StoreKey")
    assert 0.3 <= R.confidence(top, found, corpus[2]).first().confidence <= 0.95


def test_the_plan_has_no_python_and_no_shuffle_of_pairs(spark, corpus):
    _, top = ranked(spark, corpus, "response cache")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan


def test_scores_of_some_symbols_only(spark, corpus):
    _, symbols, tokens = corpus
    found = R.tasks(spark.createDataFrame([(1, "read cache", "p")], "id bigint, text string, project string"), "id", "text")
    rest = (found, symbols, tokens, I.doc_freq(tokens), I.corpus_stats(tokens))
    every = {(r.sym_id, r.score) for r in R.scores(*rest).collect()}
    some = symbols.where("symbol = 'read'")
    got = {(r.sym_id, r.score) for r in R.scores(*rest, some).collect()}
    assert got == {(s, v) for s, v in every if s in {r.sym_id for r in some.collect()}}
    assert R.scores(found.limit(0), *rest[1:]).count() == 0
    assert F.col("x") is not None


def test_aliases_tests_and_configs(spark):
    rows = [
        (1, "p", "src/a.ts", 'import { b } from "@/lib/b";\nimport { c } from "#c/x";\nimport d from "exact";\nimport e from "pkg";\n'),
        (2, "p", "src/lib/b.ts", "export const b = 1;\n"),
        (3, "p", "code/c/x.ts", "export const c = 1;\n"),
        (4, "p", "code/d.ts", "export const d = 1;\n"),
        (5, "p", "test/a.test.ts", "it('adds', () => {});\ntest.only(\"subtracts\", f);\n  it.each([1, 2])('each one', f);\nedit('no');\n"),
        (6, "p", "package.json", "{}"),
    ]
    files = spark.createDataFrame(rows, "file_id bigint, project string, relative string, text string")
    config = spark.createDataFrame([("p", '{"compilerOptions": {"baseUrl": "code", "paths": {"#c/*": ["c/*"], "exact": ["d"]}}}')], "project string, text string")
    got = {(r.src, r.dst) for r in I.resolved_imports(files, I.alias_rules(config)).collect()}
    assert got == {("src/a.ts", "src/lib/b.ts"), ("src/a.ts", "code/c/x.ts"), ("src/a.ts", "code/d.ts")}
    assert {(r.dst) for r in I.resolved_imports(files).collect()} == {"src/lib/b.ts"}
    found = [(r.symbol, r.kind) for r in I.symbols(files).where("file_id >= 5").orderBy("sym_id").collect()]
    assert found == [("adds", "test"), ("subtracts", "test"), ("each one", "test"), ("package.json", "module")]


def test_toolbox(spark):
    from sieveline.plans.toolbox import Toolbox

    files = spark.createDataFrame(FILES, "file_id bigint, project string, relative string, text string")
    tools = Toolbox(files)
    requests = spark.createDataFrame([(1, "p", "response cache reads the store key"), (2, "p", "sort the import order")], "task_id bigint, project string, task string")
    with pytest.raises(ValueError):
        tools.context_capsules(requests.drop("project"))
    capsules = {r.task_id: r for r in tools.context_capsules(requests).collect()}
    assert capsules[1].symbols and capsules[1].estimated_tokens >= 1 and capsules[2].level == 0
    assert capsules[1].files[0] == capsules[1].symbols[0].file
    hard = {r.task_id: r for r in tools.context_capsules(requests, level=3, tokens=200, attempt=3).collect()}
    assert hard[1].handoff_required and len(hard[1].criteria) >= 1
    for wrong in ({"level": 4}, {"tokens": 100}, {"attempt": -1}):
        with pytest.raises(ValueError):
            tools.context_capsules(requests, **wrong)
    with pytest.raises(ValueError):
        tools.context_capsules(requests.withColumn("task", F.lit(" ")))
    names = spark.createDataFrame([("p", "X.read"), ("p", "nothing")], "project string, name string")
    assert [(r.name, r.matches, r.confidence) for r in tools.read_symbols(names).collect()] == [("X.read", 1, 0.95)]
    records = spark.createDataFrame([(1, "p", "f", "s", None, None, "x" * 3000)], "evidence_id bigint, project string, file string, snapshot string, kind string, symbol string, text string")
    first = tools.read_evidence(records, 300)
    assert first.count() == 4
    again = tools.read_evidence(records, 300, first.select("ref")).collect()
    assert [(r.unchanged, r.source) for r in again] == [(True, "")]


def test_a_long_declaration_is_whole(spark):
    from sieveline.operators import capsule as K
    from sieveline.operators import evidence as E

    long = "export function read(a) {\n" + "  a.step();\n" * 500 + "  return new Late(a);\n}\n"
    files = spark.createDataFrame([(1, "p", "a.ts", long + "export class Late {\n}\n")], "file_id bigint, project string, relative string, text string")
    found = I.symbols(files)
    read = found.where("symbol = 'read'")
    assert read.select(F.length("body")).first()[0] == 4000
    names = spark.createDataFrame([("p", "read")], "project string, name string")
    assert E.lookup(found, names).first().source == long
    direct = read.select(F.lit(1).alias("task_id"), "project", "sym_id")
    late = found.where("symbol = 'Late'").first().sym_id
    assert [r.sym_id for r in K.type_dependencies(direct, found).collect()] == [late]


def test_projects_do_not_see_each_other(spark):
    rows = [(i, p, "src/auth.ts", f"export function refreshToken(a) {{\n  return {word}(a);\n}}\n") for i, (p, word) in enumerate([("p", "alpha"), ("q", "beta")])]
    rows += [(10 + i, "q", f"src/x{i}.ts", f"export function token{i}(a) {{\n  return token(a);\n}}\n") for i in range(9)]
    files = spark.createDataFrame(rows, "file_id bigint, project string, relative string, text string")
    symbols = I.symbols(files).cache()
    tokens = I.fields(symbols).cache()
    df, stats = I.doc_freq(tokens), I.corpus_stats(tokens)
    assert {(r.project, r.df) for r in df.where("term = 'token'").collect()} == {("p", 1), ("q", 10)}
    assert {(r.project, r.n) for r in stats.collect()} == {("p", 1), ("q", 10)}
    found = R.tasks(spark.createDataFrame([(1, "refresh token", "p"), (2, "refresh token", "q")], "id bigint, text string, project string"), "id", "text").cache()
    top = R.rank(R.scores(found, symbols, tokens, df, stats), symbols)
    assert {(r.task_id, r.project, r.file) for r in top.where("symbol = 'refreshToken'").collect()} == {(1, "p", "src/auth.ts"), (2, "q", "src/auth.ts")}
    assert {r.project for r in top.where("task_id = 1").collect()} == {"p"}


def test_blocks_of_tasks_give_what_one_block_gives(spark, corpus, monkeypatch):
    _, symbols, tokens = corpus
    rows = [(i, f"read the {w}", "p") for i, w in enumerate(["cache", "store", "key", "response", "file"])]
    found = R.tasks(spark.createDataFrame(rows, "id bigint, text string, project string"), "id", "text").cache()
    rest = (found, symbols, tokens, I.doc_freq(tokens), I.corpus_stats(tokens))
    whole = {(r.task_id, r.sym_id, r.score) for r in R.scores(*rest).collect()}
    monkeypatch.setattr(R, "TASK_BLOCK", 2)
    assert {(r.task_id, r.sym_id, r.score) for r in R.scores(*rest).collect()} == whole


def test_imports_over_several_lines(spark):
    text = 'import {\n  a,\n  type B,\n} from "./x.js";\nimport d, { e }\n  from "./no";\nimport "./y";\nimport os\nNAME = "z"\n'
    files = spark.createDataFrame([(1, "p", "a.ts", text)], "file_id bigint, project string, relative string, text string")
    assert {r.specifier for r in I.import_specifiers(files).collect()} == {"./x.js", "./y"}


def test_methods_and_their_ranges(spark):
    text = "export class Store {\n  #size = 1;\n  async read(key) {\n    if (key) {\n      return 1;\n    }\n  }\n  get size() {\n    return 2;\n  }\n}\nexport const x = 1;\n"
    python = "class Cache(Base):\n    def load(self, key) -> int:\n        return self.get(key)\n\n    async def drop(self):\n        pass\n"
    files = spark.createDataFrame([(1, "p", "a.ts", text), (2, "p", "b.py", python)], "file_id bigint, project string, relative string, text string")
    found = I.symbols(files).orderBy("sym_id").collect()
    assert [(r.file_id, r.symbol, r.kind) for r in found] == [
        (1, "Store", "class"), (1, "read", "method"), (1, "size", "method"), (1, "x", "variable"), (2, "Cache", "class"), (2, "load", "method"), (2, "drop", "method"),
    ]
    for r in found:
        assert (text if r.file_id == 1 else python)[r.start : r.end] == r.source_text
    assert found[1].signature == "async read(key)" and found[2].start == found[1].end

from __future__ import annotations

import ast
import json
import random

import pytest

from sieveline.llm.syntax import cause, invalid_ids, invalid_rates, parse, syntax_report

VALID = {
    "js": [
        "", "a=1\nb=2", "#!/usr/bin/env node\nf()", "\ufeffx", "const {a,...b}=c, [d,,e=1]=f", "y = `a${b+`c${d}`}e`; z=/[/]\\/x/g.test(q)/2",
        "class A extends B { #a=1; static { f() } get y(){return this.#a} async *z(){} }", "const s = `\n<<<<<<< HEAD\n=======\n>>>>>>> x\n`;",
        "import a,{b as c} from './x.js'\nexport default async function(){await 1}", "for (const [k, v] of Object.entries(x)) {}", "a?.b?.[c]?.(d) ?? e; new a.B(1).d()",
    ],
    "ts": [
        "const x = <T>(a: T): a is string => a as unknown as T; let y = <any>foo", "type A<T> = T extends (infer U)[] ? U : { [K in keyof T]?: T[K] }",
        "abstract class A<T> implements C { private readonly x = 1; constructor(private a: string) { super() } abstract f(): void; [k: string]: any }",
        "enum E { A = 1 } const enum F { B }", "const b = c ? (d) : e => f", "export interface Q { visit(next: (v: number) => void): Promise<void>; label?: string | null }",
    ],
    "tsx": ['const a = <div className="x" {...p} onClick={() => f()}>text {b} <b/> <></> {/* c */}</div>'],
    "py": ["", "def f(a, /, b, *, c: int = 1, **d) -> x:\n    return f\"{a!r:>{b}} {'q'}\"\n", "match x:\n    case {'a': [1, *r]} if r: pass\n    case _: pass\n", "x = (\n 1,\n# c\n 2)\n", "type A[T] = list[T]\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', " 1 ", '\ufeff"x"'],
}
INVALID = {
    "js": ["let x: number = 1", "const a = <div/>;", "function f( {", "a=1 b=2", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "}", "return (", "import x"],
    "ts": ["interface A { a: number", "const a = <div className='x'></div>", "class { a b c }", "from dataclasses import dataclass"],
    "tsx": ["const a = <div></span>", "const a = <div>", "const a = <p>x > y</p>"],
    "py": ["def f(:\n  pass\n", "if x:\npass\n", "  x = 1\n", "x = 07\n", "print 'a'\n", "f\"{a\"\n", "x = (1\n", "… cut\n", "f(a=1, b)\n"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "[1 2]", '{"a": NaN}', '{"a": 1} x'],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert parse(text, language)[0]


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    valid, at = parse(text, language)
    assert not valid and 0 <= at <= len(text)


def test_python_and_json_agree_with_the_standard_parsers_on_damaged_texts():
    random.seed(4)
    python = VALID["py"][1] + VALID["py"][2] + VALID["py"][3] + "class A(B):\n    x: int = 1\n    async def g(self): await h(*a, **k)\n\ntry:\n    a[1:2, ::3] = lambda q=1: q\nexcept* E as e:\n    raise X from e\n"
    text = json.dumps({"a": [1, 2.5, "x", None], "b": {"c": True}}, indent=1)
    for source, language, load in ((python, "py", ast.parse), (text, "json", json.loads)):
        for _ in range(250):
            i = random.randrange(len(source))
            damaged = source[:i] + random.choice(["", source[i] * 2, "(", " ", "\n"]) + source[i + 1 :]
            try:
                load(damaged)
                want = True
            except (SyntaxError, ValueError):
                want = False
            assert parse(damaged, language)[0] == want, damaged


def test_deep_nesting_and_long_text():
    assert parse("[" * 2000 + "]" * 2000, "json")[0]
    assert parse("x = 1;\n" * 20_000, "js")[0]
    assert not parse("[" * 200_000, "json")[0]


def test_causes():
    for text, language, want in [
        ("a = 1\n<<<<<<< HEAD\nb = 2\n=======\nb = 3\n>>>>>>> x\n", "py", "conflict"),
        ("function f() { return", "js", "truncated"),
        ("let x: number = 1", "js", "extension:ts"),
        ("a b c d", "js", "syntax"),
    ]:
        assert cause(text, language, parse(text, language)[1]) == want


def test_report(spark):
    rows = [(1, "p", "a.ts", "let x: number", "t"), (2, "p", "a.js", "let x: number", "t"), (3, "q", "b.md", "#", None), (4, "q", "c.py", None, None), (5, None, None, "x", None), (6, "q", "d.PY", "", None)]
    df = spark.createDataFrame(rows, "evidence_id bigint, project string, file string, text string, valid string")
    report = syntax_report(df, keep=("project",))
    assert {(r.evidence_id, r.language, r.valid) for r in report.collect()} == {(1, "ts", True), (2, "js", False), (6, "py", True)}
    rates = {(r.project, r.language): (r.files, r.invalid, r.wrong_extension) for r in invalid_rates(report, "project", "language").collect()}
    assert rates == {("p", "ts"): (1, 0, 0), ("p", "js"): (1, 1, 1), ("q", "py"): (1, 0, 0)}
    assert syntax_report(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "language"), [("[" * 100_000 + "]" * 100_000, "json"), ("x = " + "(" * 20_000 + "1" + ")" * 20_000 + ";", "js")])
def test_deep_nesting_is_valid(text, language):
    assert parse(text, language)[0]
    assert not parse(text[:-2], language)[0]


def test_the_ids_are_those_of_the_report(spark, data):
    records = spark.read.parquet(f"{data}/evidence_record.parquet").where("kind is null or kind <> 'delta'")
    want = {r.evidence_id for r in syntax_report(records).where("not valid").collect()}
    assert want and {r.evidence_id for r in invalid_ids(records).collect()} == want

from __future__ import annotations

import random

from sieveline.llm import provenance as V

HAND = """import { a } from "./b.js";

export class {0}Window extends Base {{
  #limit = {1};
  push{0}(step) {{
    this.#limit += step;
    return this.#limit;
  }}
}}

export function sort{0}Items(values, limit = 20) {{
  const kept = [];
  for (const item of values) {{
    if (item.length > limit) continue;
    kept.push(item);
  }}
  return kept;
}}
""".replace("{ a }", "{{ a }}")


def minified(n):
    random.seed(n)
    return ";".join(f"var {c}{i}=function({d}{i}){{for(var {e}q{i}=0;{e}q{i}<{d}{i}.length;{e}q{i}++)if({d}{i}[{e}q{i}]==={i})return!0}}" for i in range(40) for c, d, e in [random.sample("zxqjkvw", 3)])


def files(spark):
    words = "Budget Query Capsule Order Symbol Ledger Digest Runner Window Probe".split()
    rows = [(i, f"p{i % 5}", f"src/{w.lower()}{i}.js", HAND.format(w + words[(i * 3) % 10], i)) for i, w in enumerate(words * 8)]
    library = "".join(f"export function resolve{w}Edge(a) {{\n  return a.{w.lower()} + {{0}};\n}}\n" for w in words[:6])
    rows += [(200 + i, f"p{i}", f"lib/tool{i}.js", library.replace("{0}", str(i))) for i in range(4)]
    rows += [
        (300, "p0", "lib/x.js", minified(1)),
        (301, "p0", "src/a.ts", "".join(f"export interface M{i}Message {{ depth: number; tag: {i}; }}\n" for i in range(12))),
        (302, "p0", "src/b.ts", "// Code generated by loom 3.1. DO NOT EDIT.\nexport const a = 1;\n"),
        (303, "p0", "package-lock.json", '{"lockfileVersion": 3}'),
        (304, "p0", "vendor/q/index.js", "export const a = 1;"),
        (305, "p0", "src/c.js", "/*! quick v1.2.3\n * (c) quick contributors. MIT License */\nexport const a = 1;"),
        (306, "p0", "src/d.py", "TABLE = {\n" + "".join(f"    {i}: ({i * 7}, {i * 11}),\n" for i in range(200)) + "}\n"),
        (307, "p0", "src/e.js", 'export default "data:font/woff2;base64,' + "Ab9/" * 400 + '"'),
        (400, "quick", "src/f.js", '// Writes the banner "Code generated by ..." on top of its output.\n' + HAND.format("Banner", 1)),
        (401, "p1", "src/g.ts", "// TODO: this used to be auto-generated, now maintained by hand. Please edit freely.\nexport const a = 1;\n"),
        (402, "p1", "src/vendors/h.js", HAND.format("Vendor", 2)),
        (403, "p1", "src/i.js", "/* Copyright the p1 authors. Licensed under the MIT License. */\nconst SIZES = [1, 2, 3, 4, 5];\n" + HAND.format("Size", 3)),
        (404, "p1", "src/j.js", None),
        (405, "p1", "src/k.js", ""),
        (406, None, None, "x = 1"),
    ]
    return spark.createDataFrame([(*r, "c") for r in rows], "file_id bigint, project string, relative string, text string, kinds string")


def test_kinds(spark):
    df = files(spark)
    features = V.file_features(df, V.train_names(df)).cache()
    found = {r.file_id: set(r.kinds) for r in V.classify(features).where("size(kinds) > 0").collect()}
    want = {
        **{200 + i: {"vendored"} for i in range(4)},
        300: {"minified"}, 301: {"generated"}, 303: {"generated"}, 304: {"vendored"}, 305: {"vendored"}, 306: {"data"}, 307: {"data"},
    }
    # The model of so few files is coarse: a kind may come with another one, but no file is found that should not be.
    assert found.keys() == want.keys() and all(want[k] <= found[k] for k in want)


def test_empty_table(spark):
    df = files(spark).limit(0)
    assert V.classify(V.file_features(df, V.train_names(df))).count() == 0


def test_entropy_tells_mangled_names():
    good = V._log_model({t: n for n, w in enumerate(["sortItems", "limitOrder", "orderItems"], 5) for t in V.trigrams_of(w)})
    assert V.cross_entropy(["orderItems"], good) < V.cross_entropy(["xq3", "zj9"], good)


def classified(spark, rows):
    df = spark.createDataFrame(rows, "file_id bigint, project string, relative string, text string")
    features = V.file_features(df, V.train_names(df)).cache()
    return {r.file_id: set(r.kinds) for r in V.classify(features).collect()}


def test_cross_entropy_above_the_own_project_tells_alone(spark):
    words = "Budget Query Capsule Order Symbol Ledger Digest Runner Window Probe".split()
    rows = [(i, "p", f"src/{i}.js", HAND.format(w + words[i // 10], i)) for i, w in enumerate(words * 4)]
    random.seed(5)
    odd = ["".join(random.choice("zxqjkvwZXQJKVW") for _ in range(9)) for _ in range(30)]
    rows.append((90, "p", "src/odd.js", "\n".join(f"  {a}.{b}({c});" if i % 2 else f"if ({a}) {{ {b} = {c} }}" for i, (a, b, c) in enumerate(zip(odd, odd[1:], odd[2:])))))
    found = classified(spark, rows)
    assert found.pop(90) == {"minified"}
    assert set().union(*found.values()) == set()


def test_identifiers_that_differ_in_numbers_only(spark):
    uneven = "".join(f"run(item{i}Handler" + ", 1" * (i % 7) + ");\n" for i in range(14))
    found = classified(spark, [(1, "p", "src/a.js", uneven), (2, "p", "src/b.js", HAND.format("Probe", 1))])
    assert "generated" in found[1] and found[2] == set()


def test_a_copy_in_two_projects_with_a_style_of_its_own(spark):
    words = "Budget Query Capsule Order Symbol Ledger Digest Runner Window Probe".split()
    rows = [(i * 10 + p, f"p{p}", f"src/{i}.js", HAND.format(w + words[(i + p + 1) % 10], i)) for p in (0, 1) for i, w in enumerate(words)]
    copy = "".join(f"export function read_{w.lower()}_edge(a_{w.lower()}_b) {{\n  return {{0}};\n}}\n\n" for w in words[:6])
    rows += [(500 + p, f"p{p}", "lib/t.js", copy.replace("{0}", "1 + 2" if p else "3")) for p in (0, 1)]
    found = classified(spark, rows)
    assert {k for k, v in found.items() if "vendored" in v} == {500, 501}


def test_the_model_decides_what_is_minified(spark):
    df = files(spark)
    features = V.file_features(df, {}).cache()
    kinds = {r.file_id: set(r.kinds) for r in V.classify(features).collect()}
    assert kinds[300] == set() and kinds[301] == {"generated"}


def test_names_from_a_template(spark):
    rows = [(1, "p", "src/a.ts", "".join(f"export const Order{c}{i} = Object.freeze({{ size: {i}, at: {i * 3} }});\n" + "// x\n" * (i % 3) for i, c in enumerate("ABCDEFGHIJ"))), (2, "p", "src/b.ts", HAND.format("Step1", 1))]
    rows.append((3, "p", "src/c.ts", "".join(f"const quote{n} = 1, other{n + 77} = 2;\n" for n in (901, 342, 17, 560, 711, 218, 433)) + HAND.format("Quote", 2)))
    found = classified(spark, rows)
    assert "generated" in found.pop(1) and not any("generated" in kinds for kinds in found.values())

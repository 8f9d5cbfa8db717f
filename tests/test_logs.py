from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest

from sieveline.operators import logs as G

DAY = 1767225600000  # 2026-01-01


@pytest.mark.parametrize(
    ("line", "ms", "level", "component", "message"),
    [
        ("2026-01-01 00:00:01,250 - mcp.stdio - WARNING - left: 1", 1250, "warn", "mcp.stdio", "left: 1"),
        ("2026/01/01 00:00:01 walk.go:768: INFO capsule packed", 1000, "info", "walk.go", "capsule packed"),
        ("[2026-01-01 00:00:01.5] [debug] [a::b] read 4", 1500, "debug", "a::b", "read 4"),
        ("[2026-01-01 00:00:01.999] [info] budget left: 3", 1999, "info", "", "budget left: 3"),
        ("2026-01-01T01:00:01.000999+01:00  INFO budget: x y", 1000, "info", "budget", "x y"),
        ("\x1b[2m2026-01-01T00:00:02Z\x1b[0m \x1b[31mERROR\x1b[0m \x1b[2mvitest\x1b[0m: boom\r", 2000, "error", "vitest", "boom"),
        ("01 Jan 2026 00:00:03.004 FATAL [worker-2] usage_log - gone", 3004, "fatal", "usage_log", "gone"),
        ("I0101 00:00:04.881751 65934 walk.cc:546] cache loose", 4881, "info", "walk.cc", "cache loose"),
        ("Jan  1 00:00:05 runner-17 retriever[9095]: warning: low", 5000, "warn", "retriever", "low"),
        ("Jan  1 00:00:05 runner-17 retriever[9095]: ref 4 started at level info", 5000, "", "retriever", "ref 4 started at level info"),
        ('time=2026-01-01T00:00:06Z level=trace component=pnpm msg="a \\"b\\""', 6000, "trace", "pnpm", 'a "b"'),
        ('level=error time=2026-01-01T00:00:06Z msg="m"', 6000, "error", "", "m"),
        ('{"level":60,"time":1767225607001,"pid":1,"name":"n.x","msg":"hi"}', 7001, "fatal", "n.x", "hi"),
        ('{"severity": "CRITICAL", "message": "m", "ts": "2026-01-01T03:00:08.1+03:00"}', 8100, "fatal", "", "m"),
    ],
)
def test_layouts(known, line, ms, level, component, message):
    head = G.Reader(known).read(G.plain_line(line), 2026)
    assert (head.ts_ms - DAY, head.level, head.component, head.message) == (ms, level, component, message)
    assert G.plain_lines(pa.array([line]))[0].as_py() == G.plain_line(line)


@pytest.mark.parametrize(
    "line",
    [
        "", "{", "}", "    at a.b (c.ts:1:2)", "12:48:34 still waiting", "2026-01-01 was the last day", "> 2026-01-01T00:00:00Z ERROR a: b",
        "  | 2026-01-01T00:00:00Z ERROR a: b", "    2026-01-01T00:00:00Z ERROR a: b", '  "at": "2026-01-01T00:00:00Z",', '{"ok": true, "at": "2026-01-01T00:00:00Z"}',
        "2026-02-30 00:00:00,000 - a - INFO - no such day", "2026-01-01 25:00:00 INFO a: no such hour", "x" * 100_000,
    ],
)
def test_lines_that_start_nothing(known, line):
    assert G.Reader(known).read(G.plain_line(line), 2026) is None


MESSAGES = ["left: 4", "read 4", "cache loose, 4 entries", "stage=x took=4ms", "edit rejected: no such block", "gone \"b\" away", "ref 4 started at level info", "request ab12 finished", "{} of 4", "boom at once", "src/a.ts: no"]
NAMES = ["mcp.stdio", "walk.go", "a::b", "budget", "c.v.Plan", "lint-runner"]
LAYOUTS = [
    "2026-01-01 00:00:01,250 - {c} - WARNING - {m}",
    "2026/01/01 00:00:01 {c}:768: INFO {m}",
    "[2026-01-01 00:00:01.5] [debug] [{c}] {m}",
    "[2026-01-01 00:00:01.5] [debug] {m}",
    "2026-01-01T01:00:01.000999+01:00  INFO {c}: {m}",
    "01 Jan 2026 00:00:03.004 FATAL [worker-2] {c} - {m}",
    "I0101 00:00:04.881751 65934 {c}:546] {m}",
    "Jan  1 00:00:05 runner-17 {c}[9095]: warning: {m}",
    "Jan  1 00:00:05 runner-17 {c}[9095]: {m}",
    'time=2026-01-01T00:00:06Z level=trace component={c} msg="{m}"',
    'level=error time=2026-01-01T00:00:06Z msg="{m}"',
    '{{"level":60,"time":1767225607001,"pid":1,"name":"{c}","msg":"{m}"}}',
    '{{"severity": "CRITICAL", "message": "{m}", "ts": "2026-01-01T03:00:08.1+03:00"}}',
]


def corpus(*layouts):
    return [
        layout.format(c=c, m=m.replace('"', '\\"') if layout.endswith(('"', "}}")) else m)
        for layout in layouts
        for c in NAMES
        for m in MESSAGES
    ]


def learned(spark, text):
    at = datetime(2026, 3, 1)
    return G.learn(lines_frame(spark, [(1, i, t, at, None) for i, t in enumerate(text)]))[1]


@pytest.fixture(scope="module")
def known(spark):
    return learned(spark, corpus(*LAYOUTS))


def lines_frame(spark, rows):
    return spark.createDataFrame(rows, "stream_id bigint, line_no int, line string, received_at timestamp_ntz, level string")


def run(spark, rows, block):
    lines = lines_frame(spark, rows)
    once = G.delivered_once(G.parse_lines(lines, G.learn(lines)[1]), block)
    found = G.entries(G.segments(once))
    return {(r.stream_id, r.line_no, r.last_line_no, r.n_lines, r.ts_ms - DAY, r.level, r.component) for r in found.collect()}


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_entries_over_blocks(spark, block):
    at = datetime(2026, 3, 1)
    text = ["banner", "2026-01-01 00:00:00,001 - a.b - INFO - x", "more", None, "    deep", "2026-01-01 00:00:00,002 - c - ERROR - y", "Jan  1 00:00:01 h-1 d[7]: info: z"]
    rows = [(1, i + 1, t, at, "clash") for i, t in enumerate(text)] + [(1, 2, text[1], datetime(2026, 4, 1), "again"), (2, 9, text[1], at, None), (3, 1, "none", at, None)]
    assert run(spark, rows, block) == {
        (1, 2, 5, 4, 1, "info", "a.b"),
        (1, 6, 6, 1, 2, "error", "c"),
        (1, 7, 7, 1, 1000, "info", "d"),
        (2, 9, 9, 1, 1, "info", "a.b"),
    }


def test_the_earliest_delivery_gives_the_year(spark):
    rows = [(1, 1, "Jan  1 00:00:00 h-1 d[7]: info: z", datetime(y, 6, 1), None) for y in (2027, 2026)]
    assert run(spark, rows, 8) == {(1, 1, 1, 1, 0, "info", "d")}


def test_empty_table(spark):
    assert run(spark, [], 8) == set()


def test_the_dictionary_decides(spark, data):
    lines = spark.read.parquet(f"{data}/run_output.parquet")
    known = G.learn(lines)[1]
    with_it, without = (G.parse_lines(lines, d).where("ts_ms is not null").cache() for d in (known, G.EMPTY))
    assert with_it.where("level <> ''").count() > 0.9 * with_it.count()
    assert with_it.where("component <> ''").count() > 0.7 * with_it.count()
    assert 0 < without.count() < with_it.count()
    assert without.where("component <> ''").count() == 0


@pytest.mark.parametrize(
    ("layout", "component", "level", "message"),
    [
        ("2026-01-01 00:00:00 | {c} | ERROR | {m}", "budget", "error", "left: 4"),
        ("2026-01-01 00:00:00 <{c}> (WARN) {m}", "budget", "warn", "left: 4"),
        ("2026-01-01 00:00:00 INFO {c} => {m}", "budget", "info", "left: 4"),
        ("2026-01-01 00:00:00 [main] INFO {c}: {m}", "budget", "info", "left: 4"),
        ("2026-01-01 00:00:00 4711 77 88 99 100 101 102 INFO {c}: {m}", "budget", "info", "left: 4"),
        ("[2026-01-01 00:00:00] {{{c}}} #12 ERROR: {m}", "budget", "error", "left: 4"),
    ],
)
def test_layouts_that_only_the_counts_tell(spark, layout, component, level, message):
    known = learned(spark, corpus(*LAYOUTS, layout))
    head = G.Reader(known).read(layout.format(c=component, m=message), 2026)
    assert (head.component, head.level, head.message) == (component, level, message)
    assert G.Reader(G.EMPTY).read(layout.format(c=component, m=message), 2026).component == ""


def test_a_slot_with_one_constant_word_is_no_component(spark):
    known = learned(spark, corpus("2026-01-01 00:00:00 INFO module {c}: {m}"))
    assert {G.Reader(known).read(f"2026-01-01 00:00:00 INFO module {c}: x", 2026).component for c in NAMES} == set(NAMES)


def test_a_word_and_a_mark_in_messages_make_no_component(spark):
    known = learned(spark, corpus("2026-01-01 00:00:00 INFO {m}"))
    assert {G.Reader(known).read(f"2026-01-01 00:00:00 INFO {m}", 2026).component for m in MESSAGES} == {""}


def test_the_dictionary_finds_the_mark_behind_a_component(spark):
    at = datetime(2026, 3, 1)
    text = [f"2026-01-01 00:00:0{i} INFO {name} => item {i} done" for i, name in enumerate(["alpha", "b.c", "delta", "echo", "fox"])]
    want = {(1, i, i, 1, i * 1000, "info", name) for i, name in enumerate(["alpha", "b.c", "delta", "echo", "fox"])}
    assert run(spark, [(1, i, t, at, None) for i, t in enumerate(text)], 8) == want


def test_marks_inside_a_message_are_no_constants(spark):
    at = datetime(2026, 3, 1)
    text = ["INFO read => 1", "INFO read four lines", "INFO wrote two lines", "INFO count=3 left", "INFO done."]
    rows = [(1, i, f"2026-01-01 00:00:00 {t}", at, None) for i, t in enumerate(text)]
    assert {r[6] for r in run(spark, rows, 8)} == {""}

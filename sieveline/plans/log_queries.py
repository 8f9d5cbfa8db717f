"""Queries of problem 5: run output as log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.logs import Dictionary, assign_entries, delivered_once, entries, learn, learn_templates, parse_lines, segments
from sieveline.session import checkpointed, read_table, spread_if_narrow


def _learned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Dictionary]:
    """The lines, the counted shapes of their heads and the n-gram dictionary."""
    lines = spread_if_narrow(read_table(spark, sf_dir, "run_output").select("stream_id", "line_no", "line", "received_at"))
    return lines, *learn(lines, checkpointed)


def _parsed(spark: SparkSession, sf_dir: str, with_message: bool = False) -> DataFrame:
    lines, _, dictionary = _learned(spark, sf_dir)
    return delivered_once(parse_lines(lines, dictionary, with_message))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entries(checkpointed(segments(_parsed(spark, sf_dir))))
    return found.select("stream_id", "line_no", "last_line_no", "ts_ms", "level", "component")


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with message and template of the head line; p5_lines leads to the lines below it."""
    return entries(checkpointed(segments(_parsed(spark, sf_dir, with_message=True))))


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entry each line belongs to (null before the first entry of its stream)."""
    return assign_entries(_parsed(spark, sf_dir)).select("stream_id", "line_no", "entry_no")


def p5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layouts found and how many lines begin with each."""
    _, keys, dictionary = _learned(spark, sf_dir)
    return learn_templates(keys, dictionary).groupBy("template").agg(F.sum("n").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_entries": p5_entries, "p5_lines": p5_lines, "p5_templates": p5_templates}

#: The layouts of the test tables as expressions of their own, independent of the learned templates.
_LAYOUTS = (  # name, expression, groups of time, level and component, label
    ("dash", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d[.,]\d+) - (\S+) - (\w+) - ", 1, 3, 2, "<ts> - <*> - <lvl> -"),
    ("go", r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) ([\w.]+):\d+: (\w+) ", 1, 3, 2, "<ts> <*>:<n>: <lvl>"),
    ("brackets", r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+)\] \[(\w+)\](?: \[([^\]]+)\])? ", 1, 2, 3, "[<ts>] [<lvl>] [<*>]"),
    ("iso", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+\S*) +([A-Z]+) (\S+): ", 1, 2, 3, "<ts> <lvl> <*>:"),
    ("long", r"^(\d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d\.\d+) (\w+) +\[[^\]]+\] (\S+) - ", 1, 2, 3, "<ts> <lvl> [<id>] <*> -"),
    ("glog", r"^([IWEFD])(\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ ([\w.]+):\d+\] ", 2, 1, 3, "<lvl><ts> <n> <*>:<n>]"),
    ("syslog", r"^([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) \S+ ([^\s\[]+)\[\d+\]:(?: (trace|debug|info|warning|warn|error|fatal):)? ", 1, 3, 2, "<ts> <id> <*>[<n>]: <lvl>:"),
)


def _pick(group: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(t, '{p}', {(ts, lv, cp)[group]})" for k, p, ts, lv, cp, _ in _LAYOUTS)


_LABEL = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{label}'" for k, *_, label in _LAYOUTS)
_REST = "CASE kind " + " ".join(f"WHEN '{k}' THEN trim(regexp_replace(t, '{p}', ''))" for k, p, *_ in _LAYOUTS)
_ROLE = "CASE WHEN k IN ('ts', 'time') THEN 'ts' WHEN k IN ('level', 'severity') THEN 'lvl' WHEN k IN ('msg', 'message') THEN 'msg' WHEN k IN ('name', 'logger', 'component') THEN 'name' ELSE '*' END"
_KEYS = "(CASE kind WHEN 'json' THEN json_keys(t) ELSE regexp_extract_all(regexp_replace(t, '\"(?:[^\"\\\\]|\\\\.)*\"', '', 'g'), '([\\w.]+)=', 1) END)"

_DIGITS = "(CASE WHEN regexp_matches(ts, '[.,]\\d') THEN rpad(regexp_extract(ts, '[.,](\\d{1,3})', 1), 3, '0')::BIGINT ELSE 0 END)"
_OFFSET = "(CASE WHEN regexp_matches(ts, '[+-]\\d\\d:\\d\\d$') THEN (CASE WHEN ts[-6] = '-' THEN -1 ELSE 1 END) * (ts[-5:-4]::BIGINT * 60 + ts[-2:]::BIGINT) * 60000 ELSE 0 END)"

_TIMED = f"""
WITH lines AS (
  SELECT stream_id, line_no, arg_min(line, received_at) AS line, min(received_at) AS received FROM run_output GROUP BY ALL
), plain AS (
  SELECT *, rtrim(regexp_replace(line, chr(27) || '\\[[0-9;]*m', '', 'g'), chr(13)) AS t FROM lines
), kinds AS (
  SELECT *, CASE {" ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p, *_ in _LAYOUTS)}
    WHEN regexp_matches(t, '^(level=\\w+ )?time=\\S+ ') THEN 'pairs' WHEN starts_with(t, '{{') AND json_valid(t) AND (t->>'$.time' IS NOT NULL OR t->>'$.ts' IS NOT NULL) THEN 'json' END AS kind
  FROM plain
), fields AS (
  SELECT stream_id, line_no, received, kind,
    {_pick(0)} WHEN 'pairs' THEN regexp_extract(t, 'time=(\\S+)', 1) WHEN 'json' THEN coalesce(t->>'$.ts', t->>'$.time') END AS ts,
    {_pick(1)} WHEN 'pairs' THEN regexp_extract(t, 'level=(\\w+)', 1) WHEN 'json' THEN coalesce(t->>'$.severity', t->>'$.level') END AS lv,
    {_pick(2)} WHEN 'pairs' THEN regexp_extract(t, ' component=(\\S+)', 1) WHEN 'json' THEN coalesce(t->>'$.logger', t->>'$.name', '') END AS cp,
    {_REST} WHEN 'pairs' THEN replace(regexp_extract(t, ' msg="((?:[^"\\\\]|\\\\.)*)"', 1), '\\"', '"') WHEN 'json' THEN coalesce(t->>'$.msg', t->>'$.message') END AS message,
    {_LABEL} ELSE 'fields: ' || array_to_string(list_transform({_KEYS}, lambda k: k || '=<' || {_ROLE} || '>'), ' ') END AS label
  FROM kinds
), timed AS (
  SELECT stream_id, line_no, CASE kind
    WHEN 'glog' THEN epoch_ms(strptime(year(received) || ts[1:13], '%Y%m%d %H:%M:%S')) + {_DIGITS}
    WHEN 'syslog' THEN epoch_ms(strptime(year(received) || ' ' || replace(ts, '  ', ' '), '%Y %b %d %H:%M:%S'))
    WHEN 'long' THEN epoch_ms(strptime(ts[1:20], '%d %b %Y %H:%M:%S')) + {_DIGITS}
    WHEN 'json' THEN CASE WHEN regexp_matches(ts, '^\\d+$') THEN ts::BIGINT ELSE epoch_ms(strptime(replace(ts[1:19], 'T', ' '), '%Y-%m-%d %H:%M:%S')) + {_DIGITS} - {_OFFSET} END
    ELSE epoch_ms(strptime(replace(replace(ts[1:19], 'T', ' '), '/', '-'), '%Y-%m-%d %H:%M:%S')) + {_DIGITS} - {_OFFSET} END AS ts_ms,
    CASE lower(coalesce(lv, '')) WHEN 'i' THEN 'info' WHEN 'w' THEN 'warn' WHEN 'e' THEN 'error' WHEN 'f' THEN 'fatal' WHEN 'd' THEN 'debug' WHEN 'warning' THEN 'warn'
      WHEN 'critical' THEN 'fatal' WHEN '10' THEN 'trace' WHEN '20' THEN 'debug' WHEN '30' THEN 'info' WHEN '40' THEN 'warn' WHEN '50' THEN 'error' WHEN '60' THEN 'fatal'
      ELSE lower(coalesce(lv, '')) END AS level, coalesce(cp, '') AS component, kind IS NOT NULL AS is_head, message,
    CASE WHEN kind = 'brackets' AND cp = '' THEN '[<ts>] [<lvl>]' WHEN kind = 'syslog' AND lv = '' THEN '<ts> <id> <*>[<n>]:' ELSE label END AS template
  FROM fields
)"""

ORACLE_SQL: dict[str, str] = {
    "p5_found": _TIMED
    + """, owned AS (
  SELECT *, max(CASE WHEN is_head THEN line_no END) OVER (PARTITION BY stream_id ORDER BY line_no) AS entry FROM timed
)
SELECT stream_id, entry AS line_no, max(line_no) AS last_line_no, max(CASE WHEN line_no = entry THEN ts_ms END) AS ts_ms,
  max(CASE WHEN line_no = entry THEN level END) AS level, max(CASE WHEN line_no = entry THEN component END) AS component
FROM owned WHERE entry IS NOT NULL GROUP BY stream_id, entry
""",
}
ORACLE_SQL["p5_lines"] = ORACLE_SQL["p5_found"].rsplit("SELECT stream_id, entry AS line_no", 1)[0] + "SELECT stream_id, line_no, entry AS entry_no FROM owned"
ORACLE_SQL["p5_entries"] = ORACLE_SQL["p5_found"].replace(
    "AS last_line_no,",
    "AS last_line_no, count(*) AS n_lines, max(CASE WHEN line_no = entry THEN message END) AS message, max(CASE WHEN line_no = entry THEN template END) AS template,",
)
#: Templates are counted over all delivered lines, before repeated ones are removed.
ORACLE_SQL["p5_templates"] = _TIMED.replace("arg_min(line, received_at) AS line, min(received_at) AS received FROM run_output GROUP BY ALL", "line, received_at AS received FROM run_output") + "SELECT template, count(*) AS n FROM timed WHERE is_head GROUP BY template"

"""Queries of problem 1: measurement records as flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.nested import TableSpec, group_fields, nodes, pivot_group, struct_payload, triples
from sieveline.session import checkpointed, read_table

READS = TableSpec(
    "readResults",
    {
        "symbol": ("symbol", "string"),
        "file": ("file", "string"),
        "lines": ("lines", "string"),
        "source_length": ("sourceLength", "bigint"),
        "tokens": ("tokens", "bigint"),
    },
)
PAGES = TableSpec(
    "readResults.pages",
    {"offset": ("offset", "bigint"), "next_offset": ("nextOffset", "bigint"), "done": ("done", "boolean")},
)
CALLEES = TableSpec("readResults.callees", {"symbol": ("symbol", "string"), "relation": ("relation", "string")})
RUNS = TableSpec(
    "*",
    {
        "label": ("label", "string"),
        "duration_ms": ("durationMs", "bigint"),
        "input_tokens": ("inputTokens", "bigint"),
        "output_tokens": ("outputTokens", "bigint"),
        "cache_read_tokens": ("cacheReadTokens", "bigint"),
        "exit_code": ("exitCode", "bigint"),
        "note": ("note", "string"),
        "tools_used": ("toolsUsed", "string"),
    },
)
ATTEMPTS = TableSpec("*.attempts", {"no": ("no", "bigint"), "input_tokens": ("inputTokens", "bigint")})
TOOL_CALLS = TableSpec("*.attempts.toolCalls", {"tool": ("tool", "string"), "ms": ("ms", "bigint")})
REQUESTS = TableSpec(
    "requests",
    {
        "input": ("input", "bigint"),
        "output": ("output", "bigint"),
        "cache_read": ("cache_read", "bigint"),
        "cache_write": ("cache_write", "bigint"),
        "input_includes_cache": ("input_includes_cache", "boolean"),
    },
)
RECORDS = TableSpec(
    "",
    {
        "task_id": ("taskId", "string"),
        "task": ("task", "string"),
        "worktree": ("worktree", "string"),
        "capsule_time_ms": ("capsuleTimeMs", "bigint"),
        "read_time_ms": ("readTimeMs", "bigint"),
        "capsule_tokens": ("capsuleTokens", "bigint"),
        "confidence": ("confidence", "double"),
        "symbol_count": ("symbolCount", "bigint"),
        "probable_files": ("probableFiles", "string"),
    },
)


def quality_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(read_table(spark, sf_dir, "capsule_quality"), "capsule_quality")


def fair_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(read_table(spark, sf_dir, "fair_test"), "fair_test", labelled_root=True)


def request_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = struct_payload(read_table(spark, sf_dir, "evaluation_run"), "record_id", "requests")
    return triples(runs, "evaluation_run")


def all_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, sf_dir) for f in (quality_triples, fair_triples, request_triples)]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(all_triples(spark, sf_dir))


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled runs; -1 stands for unmeasured token counts and becomes null."""
    table = pivot_group(fair_triples(spark, sf_dir), RUNS, checkpointed)
    unknown = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("input_tokens", "output_tokens", "cache_read_tokens")}
    return table.withColumns(unknown)


def _table(source, spec: TableSpec):
    return lambda spark, sf_dir: pivot_group(source(spark, sf_dir), spec, checkpointed)


QUERIES = {
    "p1_found": p1_found,
    "p1_records": _table(quality_triples, RECORDS),
    "p1_reads": _table(quality_triples, READS),
    "p1_pages": _table(quality_triples, PAGES),
    "p1_callees": _table(quality_triples, CALLEES),
    "p1_runs": p1_runs,
    "p1_attempts": _table(fair_triples, ATTEMPTS),
    "p1_tool_calls": _table(fair_triples, TOOL_CALLS),
    "p1_requests": _table(request_triples, REQUESTS),
    "p1_group_fields": lambda spark, sf_dir: group_fields(all_triples(spark, sf_dir)),
}

_READ_ROWS = """
WITH docs AS (
  SELECT record_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS doc FROM capsule_quality
), parts AS (
  SELECT record_id, doc->'readResults' AS part FROM docs WHERE doc IS NOT NULL
), arrays AS (
  SELECT record_id, CASE json_type(part)
    WHEN 'ARRAY' THEN part
    WHEN 'OBJECT' THEN json_array(part)
    WHEN 'VARCHAR' THEN CASE WHEN json_valid(part->>'$') THEN (part->>'$')::JSON END END AS arr
  FROM parts
), reads AS (
  SELECT record_id, i - 1 AS ordinal, arr->((i - 1)::INT) AS el
  FROM (SELECT record_id, arr, unnest(range(1, json_array_length(arr)::BIGINT + 1)) AS i FROM arrays
        WHERE json_type(arr) = 'ARRAY')
)
"""

#: Arrays of one part, from an array, a lone object or an array written as text.
def _as_array(part: str) -> str:
    return f"""CASE json_type({part}) WHEN 'ARRAY' THEN {part} WHEN 'OBJECT' THEN json_array({part})
    WHEN 'VARCHAR' THEN CASE WHEN json_valid({part}->>'$') AND json_type(({part}->>'$')::JSON) = 'ARRAY' THEN ({part}->>'$')::JSON END END"""


def _elements(name: str, source: str, keys: str, part: str) -> str:
    """CTE name(keys, ordinal, el): the objects of one part, with their position."""
    return f"""{name} AS (
  SELECT {keys}, i - 1 AS ordinal, arr->((i - 1)::INT) AS el FROM (
    SELECT {keys}, arr, unnest(range(1, json_array_length(arr)::BIGINT + 1)) AS i FROM (SELECT {keys}, {_as_array(part)} AS arr FROM {source}) WHERE arr IS NOT NULL)
)"""


_QUALITY = "WITH docs AS (SELECT record_id, payload::JSON AS doc FROM capsule_quality WHERE json_valid(payload)), " + ", ".join(
    [
        _elements("reads_all", "docs", "record_id", "(doc->'readResults')"),
        "reads AS (SELECT record_id, 'readResults[' || ordinal || ']' AS node, ordinal, el FROM reads_all WHERE json_type(el) = 'OBJECT')",
        _elements("pages_all", "reads", "record_id, node", "(el->'pages')"),
        _elements("callees_all", "reads", "record_id, node", "(el->'callees')"),
    ]
)
_FAIR = "WITH docs AS (SELECT record_id, payload::JSON AS doc FROM fair_test WHERE json_valid(payload)), labels AS (SELECT record_id, doc, unnest(json_keys(doc)) AS label FROM docs), " + ", ".join(
    [
        "runs AS (SELECT record_id, label AS node, json_extract(doc, '$.\"' || label || '\"') AS el FROM labels)",
        "objects AS (SELECT * FROM runs WHERE json_type(el) = 'OBJECT')",
        _elements("attempts_all", "objects", "record_id, node", "(el->'attempts')"),
        "attempts AS (SELECT record_id, node AS parent, node || '.attempts[' || ordinal || ']' AS node, ordinal, el FROM attempts_all WHERE json_type(el) = 'OBJECT')",
        _elements("calls_all", "attempts", "record_id, node", "(el->'toolCalls')"),
    ]
)

ORACLE_SQL = {
    "p1_reads": _READ_ROWS
    + """
SELECT 'capsule_quality' AS source_table, record_id, '' AS parent_path,
  'readResults[' || ordinal || ']' AS node_path, ordinal::INT AS ordinal, el->>'symbol' AS symbol,
  el->>'file' AS file,
  '[' || (el->>'$.lines[0]') || ', ' || (el->>'$.lines[1]') || ']' AS lines,
  (el->>'sourceLength')::BIGINT AS source_length, (el->>'tokens')::BIGINT AS tokens
FROM reads WHERE json_type(el) = 'OBJECT'
""",
    "p1_requests": """
SELECT 'evaluation_run' AS source_table, record_id, '' AS parent_path,
  'requests[' || (i - 1) || ']' AS node_path, (i - 1)::INT AS ordinal, r.input AS input, r.output AS output,
  r.cache_read AS cache_read, r.cache_write AS cache_write, r.input_includes_cache AS input_includes_cache
FROM (SELECT record_id, requests[i] AS r, i FROM
  (SELECT record_id, requests, unnest(range(1, len(requests) + 1)) AS i FROM evaluation_run))
WHERE r IS NOT NULL
""",
    "p1_callees": _READ_ROWS
    + """
, lists AS (
  SELECT record_id, ordinal AS read_at, CASE json_type(el->'callees')
    WHEN 'ARRAY' THEN el->'callees' WHEN 'OBJECT' THEN json_array(el->'callees') END AS arr FROM reads
), each AS (
  SELECT record_id, read_at, i - 1 AS ordinal, arr->((i - 1)::INT) AS el FROM
    (SELECT record_id, read_at, arr, unnest(range(1, json_array_length(arr)::BIGINT + 1)) AS i FROM lists WHERE arr IS NOT NULL)
)
SELECT 'capsule_quality' AS source_table, record_id, 'readResults[' || read_at || ']' AS parent_path,
  'readResults[' || read_at || '].callees[' || ordinal || ']' AS node_path, ordinal::INT AS ordinal,
  el->>'symbol' AS symbol, el->>'relation' AS relation
FROM each WHERE json_type(el) = 'OBJECT'
""",
    "p1_found": f"""
SELECT * FROM ({_QUALITY}
  SELECT 'capsule_quality' AS source_table, record_id, '' AS parent_path, node AS node_path FROM reads
  UNION ALL SELECT 'capsule_quality', record_id, node, node || '.pages[' || ordinal || ']' FROM pages_all WHERE json_type(el) = 'OBJECT'
  UNION ALL SELECT 'capsule_quality', record_id, node, node || '.callees[' || ordinal || ']' FROM callees_all WHERE json_type(el) = 'OBJECT')
UNION ALL SELECT * FROM ({_FAIR}
  SELECT 'fair_test' AS source_table, record_id, '' AS parent_path, node AS node_path FROM objects
  UNION ALL SELECT 'fair_test', record_id, parent, node FROM attempts
  UNION ALL SELECT 'fair_test', record_id, node, node || '.toolCalls[' || ordinal || ']' FROM calls_all WHERE json_type(el) = 'OBJECT')
UNION ALL SELECT 'evaluation_run', record_id, '', 'requests[' || (i - 1) || ']' FROM (
  SELECT record_id, requests[i] AS r, i FROM (SELECT record_id, requests, unnest(range(1, len(requests) + 1)) AS i FROM evaluation_run)) WHERE r IS NOT NULL
""",
    "p1_pages": f"""{_QUALITY}
SELECT 'capsule_quality' AS source_table, record_id, node AS parent_path, node || '.pages[' || ordinal || ']' AS node_path, ordinal::INT AS ordinal,
  (el->>'offset')::BIGINT AS "offset", (el->>'nextOffset')::BIGINT AS next_offset, (el->>'done')::BOOLEAN AS done
FROM pages_all WHERE json_type(el) = 'OBJECT'
""",
    "p1_attempts": f"""{_FAIR}
SELECT 'fair_test' AS source_table, record_id, parent AS parent_path, node AS node_path, ordinal::INT AS ordinal, (el->>'no')::BIGINT AS no, (el->>'inputTokens')::BIGINT AS input_tokens
FROM attempts
""",
    "p1_tool_calls": f"""{_FAIR}
SELECT 'fair_test' AS source_table, record_id, node AS parent_path, node || '.toolCalls[' || ordinal || ']' AS node_path, ordinal::INT AS ordinal, el->>'tool' AS tool, (el->>'ms')::BIGINT AS ms
FROM calls_all WHERE json_type(el) = 'OBJECT'
""",
    "p1_runs": f"""{_FAIR}
SELECT 'fair_test' AS source_table, record_id, '' AS parent_path, node AS node_path, 0 AS ordinal, el->>'label' AS label, (el->>'durationMs')::BIGINT AS duration_ms,
  CASE WHEN (el->>'inputTokens')::BIGINT >= 0 THEN (el->>'inputTokens')::BIGINT END AS input_tokens,
  CASE WHEN (el->>'outputTokens')::BIGINT >= 0 THEN (el->>'outputTokens')::BIGINT END AS output_tokens,
  CASE WHEN (el->>'cacheReadTokens')::BIGINT >= 0 THEN (el->>'cacheReadTokens')::BIGINT END AS cache_read_tokens,
  (el->>'exitCode')::BIGINT AS exit_code, el->>'note' AS note, replace((el->'toolsUsed')::VARCHAR, '","', '", "') AS tools_used
FROM objects
""",
    "p1_records": """
SELECT 'capsule_quality' AS source_table, record_id, NULL::VARCHAR AS parent_path, '' AS node_path, 0 AS ordinal, doc->>'taskId' AS task_id, doc->>'task' AS task, doc->>'worktree' AS worktree,
  (doc->>'capsuleTimeMs')::BIGINT AS capsule_time_ms, (doc->>'readTimeMs')::BIGINT AS read_time_ms, (doc->>'capsuleTokens')::BIGINT AS capsule_tokens,
  (doc->>'confidence')::DOUBLE AS confidence, (doc->>'symbolCount')::BIGINT AS symbol_count, replace((doc->'probableFiles')::VARCHAR, '","', '", "') AS probable_files
FROM (SELECT record_id, payload::JSON AS doc FROM capsule_quality WHERE json_valid(payload))
""",
}


def _fields(source: str, group: str, objects: str) -> str:
    """Fields of the objects ``el``: keys whose value is neither an object nor an array of objects, also when written as text."""
    return f"""SELECT '{source}' AS source_table, '{group}' AS group_path, field, count(*) AS nodes, count(*) FILTER (WHERE json_type(v) <> 'NULL') AS present
  FROM (SELECT k AS field, json_extract(el, '$."' || k || '"') AS v FROM (SELECT el, unnest(json_keys(el)) AS k FROM {objects} WHERE json_type(el) = 'OBJECT'))
  WHERE NOT (json_type(v) = 'OBJECT' OR json_type(v) = 'ARRAY' AND contains(v::VARCHAR, '{{')
    OR json_type(v) = 'VARCHAR' AND CASE WHEN json_valid(v->>'$') THEN json_type((v->>'$')::JSON) = 'ARRAY' AND contains(v->>'$', '{{') ELSE false END)
  GROUP BY ALL"""


_REQUEST_FIELDS = ("input", "output", "cache_read", "cache_write", "input_includes_cache")
ORACLE_SQL["p1_group_fields"] = (
    f"SELECT * FROM ({_QUALITY} "
    + " UNION ALL ".join(
        _fields("capsule_quality", g, o)
        for g, o in (("", "(SELECT doc AS el FROM docs)"), ("readResults", "reads"), ("readResults.pages", "pages_all"), ("readResults.callees", "callees_all"))
    )
    + f") UNION ALL SELECT * FROM ({_FAIR} "
    + " UNION ALL ".join(_fields("fair_test", g, o) for g, o in (("", "(SELECT doc AS el FROM docs)"), ("*", "objects"), ("*.attempts", "attempts"), ("*.attempts.toolCalls", "calls_all")))
    + ") UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'evaluation_run', 'requests', '{f}', count(*), count(r.{f}) FROM (SELECT unnest(requests) AS r FROM evaluation_run) WHERE r IS NOT NULL" for f in _REQUEST_FIELDS
    )
    + " UNION ALL SELECT 'evaluation_run', '', 'requests', count(*), count(*) FROM evaluation_run WHERE requests IS NOT NULL AND len(list_filter(requests, lambda r: r IS NOT NULL)) = 0 HAVING count(*) > 0"
)

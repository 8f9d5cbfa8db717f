from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry

CHEAP = [
    "p1_reads", "p1_callees", "p1_requests", "fn_p2_tokenize", "fn_p3_query_terms", "fn_p15_snapshot", "x1_symbols", "j2_edges", "a1_doc_freq", "a2_corpus_stats",
    "s2_scan_filters", "e1_lookup", "e5_pages", "m3_plan", "v1_cosine_topk", "r5_compare", "r6_summary", "r8_usage", "w1_stream_usage",
]


def norm(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for table in "indexed_file documents eval_item evidence_record evaluation_run events embeddings capsule_quality fair_test run_file run_output mix_target".split():
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    df = entry.queries()[name](spark, data)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(norm(r[columns.index(c)]) for c in df.columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr) == want


def test_names(spark, data):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in queries:
        m = re.match(r"p(\d+)_", name)
        assert m is None or 1 <= int(m.group(1)) <= 8
    assert entry.entry(spark).limit(1).count() >= 0

"""What the plans must look like, whatever the data."""

from __future__ import annotations

from sieveline.operators import logs as G
from sieveline.operators.nested import nodes, triples
from sieveline.plans import analysis_queries as A


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nested_records_need_no_shuffle_and_read_two_columns(spark, data):
    rows = spark.read.parquet(f"{data}/capsule_quality.parquet")
    plan = plan_of(nodes(triples(rows, "t")))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<record_id:bigint,payload:string>" in plan


def test_lines_are_shuffled_once_before_segments(spark, data):
    lines = spark.read.parquet(f"{data}/run_output.parquet")
    plan = plan_of(G.segments(G.delivered_once(G.parse_lines(lines, G.EMPTY))))
    assert plan.count("Exchange") == 1 and "Cartesian" not in plan


def test_filters_reach_the_scan(spark, data):
    plan = plan_of(A._records(spark, data).where("kind = 'delta'").select("evidence_id"))
    assert "PushedFilters: [IsNotNull(kind), EqualTo(kind,delta)]" in plan


def test_top_k_sends_each_partitions_best_only(spark, data):
    plan = plan_of(A.v1_cosine_topk(spark, data))
    assert "WindowGroupLimit" in plan

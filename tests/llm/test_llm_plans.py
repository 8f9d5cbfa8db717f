from __future__ import annotations

from sieveline.llm.leakage import find_leaks
from sieveline.llm.mojibake import repair
from sieveline.llm.syntax import syntax_report


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_per_text_operators_need_no_shuffle(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/eval_item.parquet")
    records = spark.read.parquet(f"{data}/evidence_record.parquet")
    for plan in (plan_of(find_leaks(docs, items)), plan_of(repair(docs, model={})), plan_of(syntax_report(records))):
        assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(find_leaks(docs, items))

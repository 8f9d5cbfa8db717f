"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.leakage import find_leaks
from sieveline.llm.mixing import mix_report, sample_mix, token_sizes
from sieveline.llm.mojibake import repair
from sieveline.llm.provenance import classify, file_features, train_names
from sieveline.llm.syntax import invalid_ids, invalid_rates, syntax_report
from sieveline.session import checkpointed, read_table, spread_if_narrow


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored source text; deltas are no source texts."""
    records = read_table(spark, sf_dir, "evidence_record").where("kind is null or kind <> 'delta'")
    return spread_if_narrow(records.select("evidence_id", "project", "file", "text"))


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_report(_sources(spark, sf_dir), keep=("project",))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_ids(_sources(spark, sf_dir)).distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(p2_flags(spark, sf_dir), "project", "language")


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that nobody wrote by hand, with the kinds it was found to be and the deciding features."""
    files = spread_if_narrow(read_table(spark, sf_dir, "indexed_file").select("file_id", "project", "relative", "text"))
    features = checkpointed(file_features(files, train_names(files)))
    return classify(features).where("size(kinds) > 0")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_kinds(spark, sf_dir).select("file_id").distinct()


def p4_project_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each kind per project."""
    kinds = p4_kinds(spark, sf_dir).select("project", F.explode("kinds").alias("kind"))
    return kinds.groupBy("project", "kind").agg(F.count(F.lit(1)).alias("files"))


def _documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return spread_if_narrow(read_table(spark, sf_dir, "documents").select("doc_id", "text", *keep))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), read_table(spark, sf_dir, "eval_item"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only exact runs count here; the error budget of the operator also finds edited passages."""
    return _leaks(spark, sf_dir).where("longest_run >= 13").select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents with an exact and with an edited passage."""
    leaks = _leaks(spark, sf_dir)
    return leaks.groupBy("item_id").agg(
        F.count_if(F.col("distance") == 0).alias("docs_exact"),
        F.count_if(F.col("distance") > 0).alias("docs_edited"),
        F.max("longest_run").alias("longest_run"),
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted once and kept in the shared folder: the plan, the order and the report all need it."""
    docs = _documents(spark, sf_dir, "source")
    return checkpointed(token_sizes(docs, "doc_id", "text", ["source"]))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_mix(_sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_target")
    return mix_report(sizes, targets, sample_mix(sizes, targets))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_documents(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir)


QUERIES = {
    "p2_found": p2_found,
    "p2_flags": p2_flags,
    "p2_rates": p2_rates,
    "p4_found": p4_found,
    "p4_kinds": p4_kinds,
    "p4_project_shares": p4_project_shares,
    "p6_found": p6_found,
    "p6_leaks": _leaks,
    "p6_leaked_items": p6_leaked_items,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

_WORDS = "list_transform(regexp_extract_all({x}, '[\\pL\\pN]+'), lambda w: replace(lower(upper(w)), chr(775), ''))"

ORACLE_SQL: dict[str, str] = {
    "p6_found": f"""
WITH items AS (SELECT item_id, {_WORDS.format(x='text')} AS ws FROM eval_item WHERE text IS NOT NULL),
docs AS (SELECT doc_id, {_WORDS.format(x='text')} AS ws FROM documents WHERE text IS NOT NULL),
item_runs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 12], ' ') AS run FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM items)),
doc_runs AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 12], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs))
SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run)
""",
}

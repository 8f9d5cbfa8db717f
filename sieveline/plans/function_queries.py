"""Queries of single functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import index as I
from sieveline.operators import review as V
from sieveline.plans import retrieval_queries as Q
from sieveline.plans import sql_text as S
from sieveline.session import read_table


def fn_p1_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded_md5"))


def fn_p17_name_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callee names by how often they occur as the tail of a dotted chain in the files."""
    files = read_table(spark, sf_dir, "indexed_file").where("text is not null")
    chains = F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"), F.lit(1)))
    tails = files.select(chains.alias("chain")).select(X.name_tail(F.col("chain")).alias("tail"))
    return tails.groupBy("tail").agg(F.count(F.lit(1)).alias("n"))


def fn_p19_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays inside the raw measurement payloads, taken as model answers."""
    rows = read_table(spark, sf_dir, "capsule_quality").where("payload is not null")
    found = V.json_array(F.concat(F.lit("<think>x</think> ```json\n"), F.regexp_extract("payload", r'"probableFiles":\s*(\[[^\]]*\])', 1), F.lit("\n```")))
    return rows.select("record_id", found.alias("found"), V.edit_error(F.col("payload")).isNull().alias("is_edit")).where("found is not null")


def fn_p22_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "evaluation_run").select("task_id").distinct()
    return runs.select("task_id", V.assignment(F.col("task_id")).alias("first_is"))


def fn_p23_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the compiler errors in the lines of a run's output, per line."""
    lines = read_table(spark, sf_dir, "run_output").where("line is not null")
    return lines.select("stream_id", "line_no", V.diagnostic_signature(F.col("line")).alias("signature")).where("signature is not null").distinct()


def a8_path_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "indexed_file").select(F.col("relative").alias("file")).distinct()
    return files.select(
        "file",
        F.round(X.static_path_prior(F.col("file"), F.lit(True)), 6).alias("prior_test"),
        F.round(X.static_path_prior(F.col("file"), F.lit(False)), 6).alias("prior_plain"),
    )


def t7_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first distinct files of each task's ranking, at most 12."""
    ranked = Q.Corpus(spark, sf_dir).ranked()
    first = ranked.groupBy("task_id", "file").agg(F.min("pos").alias("pos"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "file")))
    return first.groupBy("task_id").agg(F.array_join(F.slice(F.transform(listed, lambda x: x["file"]), 1, 12), ",").alias("files"))


def t10_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first symbol of every file in discovery order."""
    found = I.symbols(read_table(spark, sf_dir, "indexed_file"))
    return found.groupBy("file_id").agg(F.min_by("symbol", "sym_id").alias("symbol"), F.min("sym_id").alias("sym_id"))


QUERIES = {
    "fn_p1_fold": fn_p1_fold,
    "fn_p17_name_tails": fn_p17_name_tails,
    "fn_p19_json_arrays": fn_p19_json_arrays,
    "fn_p22_assignment": fn_p22_assignment,
    "fn_p23_diagnostics": fn_p23_diagnostics,
    "a8_path_prior": a8_path_prior,
    "t7_files": t7_files,
    "t10_representative": t10_representative,
}

ORACLE_SQL = {
    "fn_p1_fold": f"SELECT doc_id, md5({S.fold('text')}) AS folded_md5 FROM documents WHERE text IS NOT NULL",
    "fn_p17_name_tails": """SELECT string_split_regex(chain, '[.#]')[-1] AS tail, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+)', 1)) AS chain FROM indexed_file WHERE text IS NOT NULL) GROUP BY tail""",
    "fn_p19_json_arrays": """SELECT record_id, found, false AS is_edit FROM (
  SELECT record_id, regexp_extract(payload, '"probableFiles":\\s*(\\[[^\\]]*\\])', 1) AS found FROM capsule_quality WHERE payload IS NOT NULL) WHERE found <> '' AND json_valid(found)""",
    "fn_p22_assignment": """SELECT DISTINCT task_id, CASE WHEN ('0x' || sha256('blind-review-v1:' || task_id)[1:2])::INT % 2 = 0 THEN 'X' ELSE 'Y' END AS first_is FROM evaluation_run WHERE task_id IS NOT NULL""",
    "a8_path_prior": f"""SELECT file, round({S.static_prior('file', 'true')}, 6) AS prior_test, round({S.static_prior('file', 'false')}, 6) AS prior_plain
FROM (SELECT DISTINCT relative AS file FROM indexed_file)""",
    "t7_files": S.with_(
        *Q._BASE, S.RANKED.strip(),
        select="SELECT task_id, array_to_string(list(file ORDER BY pos)[1:12], ',') AS files FROM (SELECT task_id, file, min(pos) AS pos FROM ranked GROUP BY ALL) GROUP BY task_id",
    ),
    "t10_representative": S.with_(S.SYMBOLS.strip(), select="SELECT file_id, arg_min(symbol, sym_id) AS symbol, min(sym_id) AS sym_id FROM symbols GROUP BY file_id"),
    "fn_p23_diagnostics": """SELECT DISTINCT stream_id, line_no, sha256(replace(regexp_extract(line, p, 1), chr(92), '/') || ':' || regexp_extract(line, p, 2) || ':' || trim(regexp_extract(line, p, 3))) AS signature
FROM run_output, (SELECT '(?m)^(.+?)\\(\\d+,\\d+\\): error (TS\\d+): (.+)$' AS p) WHERE line IS NOT NULL AND regexp_matches(line, p)""",
}

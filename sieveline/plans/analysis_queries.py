"""Queries of scans, capsules, evidence, edits, vectors, evaluation and usage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import capsule as K
from sieveline.operators import evaluation as R
from sieveline.operators import evidence as E
from sieveline.operators import index as I
from sieveline.operators import patch as M
from sieveline.operators import ranking as RK
from sieveline.operators import vectors as V
from sieveline.plans import retrieval_queries as Q
from sieveline.plans import sql_text as S
from sieveline.session import checkpointed, local_folder, read_table
from sieveline.streaming.usage import drain, windowed_usage


# scans -----------------------------------------------------------------------------------------------------


def s2_scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tree scan decides about every file."""
    path = F.col("relative")
    return read_table(spark, sf_dir, "indexed_file").where("text is not null").select(
        "file_id",
        X.is_source_path(path).alias("is_source"),
        X.in_skipped_directory(path).alias("is_skipped"),
        X.is_bundle(F.col("text")).alias("is_bundle"),
        X.is_test_path(path).alias("is_test"),
    )


def fn_p12_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


def fn_p16_line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line written into every document with that document's own line ends."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    matched = X.match_line_endings(F.lit("a\nb\r\nc"), F.col("text"))
    return docs.select("doc_id", F.replace(F.replace(matched, F.lit("\r"), F.lit("R")), F.lit("\n"), F.lit("N")).alias("written"))


def x10_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "indexed_file").where("text is not null")
    found = I.symbols(files).join(files.select("file_id", "text"), "file_id")
    return found.select("sym_id", X.line_of(F.col("text"), F.col("start")).alias("first_line"), X.line_of(F.col("text"), F.col("end") - 1).alias("last_line"))


def x11_embedding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "indexed_file").where("text is not null")
    return files.select("file_id", V.embedding_document(F.col("relative"), F.col("text")).alias("document"))


def x12_package_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ancestor directory with a manifest, else ``.``; lock files stand for manifests."""
    files = read_table(spark, sf_dir, "indexed_file").select("project", "relative").distinct()
    manifests = files.where(F.col("relative").rlike(r"(^|/)package(-lock)?\.json$")).select(
        "project", F.regexp_replace("relative", r"/?[^/]*$", "").alias("folder"), F.lit(True).alias("there")
    ).distinct()
    parts = F.split("relative", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = files.select("project", "relative", F.explode(folders).alias("folder"))
    best = each.join(manifests, ["project", "folder"]).groupBy("project", "relative").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    named = F.when(F.coalesce("folder", F.lit("")) == "", ".").otherwise(F.col("folder"))
    return files.join(best, ["project", "relative"], "left").select("project", F.col("relative").alias("file"), named.alias("package_dir"))


# capsules --------------------------------------------------------------------------------------------------


class Capsules(Q.Corpus):
    """All steps from scores to capsules."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        ranked = checkpointed(self.ranked())
        self.chosen = checkpointed(K.levels(RK.confidence(ranked, self.tasks, self.tokens), self.tasks))
        self.direct = checkpointed(K.direct_symbols(RK.promote(ranked, self.tasks, I.resolved_imports(self.files)), self.chosen))

    def neighbours(self) -> DataFrame:
        edges = checkpointed(I.edges(self.files, self.symbols))
        near = self.direct.select("project", F.col("file").alias("src")).distinct().join(edges, ["project", "src"])
        some = near.select("project", F.col("dst").alias("file")).distinct().join(self.symbols, ["project", "file"])
        return K.neighbours(self.direct, self.chosen, self.symbols, self.scores_of(some), edges, I.callees(self.files))

    def capsules(self) -> DataFrame:
        return K.pack(self.tasks, self.chosen, K.references(self.direct, self.neighbours(), self.symbols))


def k2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Capsules(spark, sf_dir).chosen.select("task_id", "level", "direct", "neighbours", "tokens", "confidence")


def t4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Capsules(spark, sf_dir).neighbours()


def j6_type_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Capsules(spark, sf_dir)
    return K.type_dependencies(c.direct, c.symbols)


def k_capsule(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = Capsules(spark, sf_dir).capsules()
    return packed.select(
        "task_id", "level", F.transform("symbols", lambda r: F.concat_ws("@", r["symbol"], r["file"])).alias("symbols"),
        "files", F.size("criteria").alias("criteria"), F.size("decisions").alias("decisions"), "estimated_tokens", "over_budget",
    )


def r1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval quality: the files that declare an identifier which the task mentions are the truth."""
    c = Q.Corpus(spark, sf_dir)
    mentioned = c.tasks.select("task_id", "project", F.explode(F.array_distinct(F.regexp_extract_all("task", F.lit("([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))).alias("symbol"))
    declared = c.symbols.select("project", "symbol", "file").distinct()
    truth = mentioned.where(F.col("symbol").rlike("[a-z][A-Z]")).join(declared, ["project", "symbol"]).select("task_id", "file").distinct()
    return R.retrieval_metrics(c.ranked(), checkpointed(truth))


# evidence --------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "evidence_record")


def e1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "indexed_file")
    names = I.callees(files).select("project", "name")
    return E.lookup(I.symbols(files), names).select("project", "name", "rank", "matches", "sym_id", "confidence", F.length("source").alias("source_chars"))


def e4_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.references(_records(spark, sf_dir)).groupBy("ref").agg(F.count(F.lit(1)).alias("records"), F.min("evidence_id").alias("first_id"))


def e4_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas appended to a store that holds all other records."""
    records = _records(spark, sf_dir)
    store = E.references(records.where("kind is null or kind <> 'delta'")).select("ref").distinct()
    return E.append_new(store, records.where("kind = 'delta'")).select("ref", "evidence_id")


def e5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pages(_records(spark, sf_dir)).select("evidence_id", "page", "offset", "next_offset", "total_chars", "done", F.md5("source").alias("source_md5"))


def e7_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = E.create_deltas(E.successive(_records(spark, sf_dir)))
    return deltas.select("evidence_id", "prev_id", "offset", "delete_chars", F.length("insert").alias("insert_chars"))


def e8_delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = E.apply_deltas(E.create_deltas(E.successive(_records(spark, sf_dir))))
    return applied.select("evidence_id", "prev_id", F.md5("after").alias("after_md5"), "intact")


# edits -----------------------------------------------------------------------------------------------------


def _operations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operations derived from the symbols of every file: by their order, some replace, delete or insert."""
    files = read_table(spark, sf_dir, "indexed_file").where("text is not null").select("file_id", "project", "relative", "text")
    found = I.symbols(files)
    turn = F.col("sym_id") % 4
    operation = F.when(turn == 0, "replace_symbol").when(turn == 1, "delete_symbol").when(turn == 2, "insert_before_symbol").otherwise("insert_after_symbol")
    content = F.concat(F.lit("// "), F.col("signature"), F.lit("\n"))
    listed = found.select(
        F.col("sym_id").alias("op_id"), "file_id", "symbol", operation.alias("operation"), content.alias("content"), F.lit(None).cast("string").alias("content_hash")
    )
    return listed, found, files


def m1_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    operations, found, files = _operations(spark, sf_dir)
    return M.resolve(operations, found, files).select("op_id", "file_id", "operation", "start", "end", "code", F.length("value").alias("value_chars"))


def m3_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.plan(checkpointed(M.resolve(*_operations(spark, sf_dir))))


def m4_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    operations, found, files = _operations(spark, sf_dir)
    return M.splice(checkpointed(M.resolve(operations, found, files)), files).select("file_id", F.md5("patched").alias("patched_md5"))


# vectors ---------------------------------------------------------------------------------------------------


def v1_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return V.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def v3_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "indexed_file").select(F.col("text").alias("content"))
    cache = _records(spark, sf_dir).where("text is not null").select(F.sha2("text", 256).alias("key"))
    return V.pending_embeddings(files, cache)


# evaluation and usage --------------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "evaluation_run")


def r4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("record_id", R.total_usage(F.col("requests")).alias("total_tokens"))


def r5_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = R.latest_runs(_runs(spark, sf_dir))
    return R.compare(latest.where("model = 'larkspur-2'"), latest.where("model = 'tidal-1.5'"))


def r6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.comparison_summary(checkpointed(_cases(spark, sf_dir)))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.get_json_object("props", "$.k").cast("int")
    return read_table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("tool"), "value", (F.coalesce(key, F.lit(0)) >= 90).alias("is_error"))


def r8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usage_by_tool(_calls(spark, sf_dir), "tool", "value", F.col("is_error"))


def r9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    total = R.total_usage(F.col("requests"))
    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"),
        F.count_if(total.isNull()).alias("unmeasured"),
        F.round(F.count_if(F.coalesce("passed", F.lit(False))) / F.count(F.lit(1)), 6).alias("pass_rate"),
    )


def r10_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each uncertainty reason occurs over all tasks."""
    c = Q.Corpus(spark, sf_dir)
    reasons = RK.confidence(checkpointed(c.ranked()), c.tasks, c.tokens).select(F.explode("reasons").alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason").limit(8)


def b10_budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running token total of the requests of every run, in order."""
    requests = _runs(spark, sf_dir).select("record_id", F.posexplode("requests").alias("pos", "r")).where("r is not null")
    used = F.coalesce("r.input", F.lit(0)) + F.coalesce("r.output", F.lit(0))
    from pyspark.sql import Window as W

    running = F.sum(used).over(W.partitionBy("record_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return requests.select("record_id", "pos", used.alias("used"), running.alias("running"))


def w1_stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed report as a stream that runs over everything there is; closed windows only."""
    events = read_table(spark, sf_dir, "events")
    schema = events.schema
    folder = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)
    scratch = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not os.path.isdir(f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    key = F.get_json_object("props", "$.k").cast("int")
    calls = source.select("ts", F.col("event_type").alias("tool"), "value", (F.coalesce(key, F.lit(0)) >= 90).alias("is_error"))
    closed = drain(spark, windowed_usage(calls), f"{scratch}/out", f"{scratch}/state")
    return closed.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {
    "s2_scan_filters": s2_scan_filters,
    "fn_p12_token_estimate": fn_p12_token_estimate,
    "fn_p16_line_endings": fn_p16_line_endings,
    "x10_line_ranges": x10_line_ranges,
    "x11_embedding_documents": x11_embedding_documents,
    "x12_package_directories": x12_package_directories,
    "k2_levels": k2_levels,
    "t4_neighbours": t4_neighbours,
    "j6_type_dependencies": j6_type_dependencies,
    "k_capsule": k_capsule,
    "e1_lookup": e1_lookup,
    "e4_references": e4_references,
    "e4_append": e4_append,
    "e5_pages": e5_pages,
    "e7_deltas": e7_deltas,
    "e8_delta_apply": e8_delta_apply,
    "m1_resolved": m1_resolved,
    "m3_plan": m3_plan,
    "m4_splice": m4_splice,
    "v1_cosine_topk": v1_cosine_topk,
    "v3_pending": v3_pending,
    "r1_metrics": r1_metrics,
    "r4_totals": r4_totals,
    "r5_compare": r5_compare,
    "r6_summary": r6_summary,
    "r8_usage": r8_usage,
    "r9_rates": r9_rates,
    "r10_reasons": r10_reasons,
    "b10_budget_ledger": b10_budget_ledger,
    "w1_stream_usage": w1_stream_usage,
}

_TOTAL = """(CASE WHEN requests IS NOT NULL AND len(requests) > 0 AND len(list_filter(requests, lambda r: r IS NULL OR r.input_includes_cache IS NULL
  OR coalesce(r.input < 0, true) OR coalesce(r.output < 0, true)
  OR (NOT r.input_includes_cache AND (coalesce(r.cache_read < 0, true) OR coalesce(r.cache_write < 0, true))))) = 0
  THEN list_sum(list_transform(requests, lambda r: CASE WHEN r.input_includes_cache THEN r.input + r.output ELSE r.input + r.output + r.cache_read + r.cache_write END))::BIGINT END)"""

_CASES = f"""latest AS (
  SELECT * FROM evaluation_run QUALIFY row_number() OVER (PARTITION BY model, task_id, repetition ORDER BY finished_at DESC, record_id DESC) = 1
), b AS (SELECT task_id, repetition, {_TOTAL} AS tok, coalesce(passed, false) AND coalesce(protected_inputs_unchanged, false) AS ok, true AS there FROM latest WHERE model = 'larkspur-2'
), a AS (SELECT task_id, repetition, {_TOTAL} AS tok, coalesce(passed, false) AND coalesce(protected_inputs_unchanged, false) AS ok, true AS there FROM latest WHERE model = 'tidal-1.5'
), cases AS (
  SELECT task_id, repetition, b.tok AS before_tokens, a.tok AS after_tokens, coalesce(b.there, false) AND coalesce(a.there, false) AS paired, coalesce(a.ok, false) AS passed,
    coalesce(b.ok, false) AND NOT coalesce(a.ok, false) AS regression, coalesce(a.tok <= 100000, false) AS within_target,
    CASE WHEN b.tok > 0 THEN round(1 - a.tok / b.tok, 6) END AS reduction
  FROM b FULL OUTER JOIN a USING (task_id, repetition)
)"""

_LEVELS = """levels AS (
  SELECT c.task_id, c.confidence, CASE WHEN t.mechanical THEN 0 WHEN c.confidence < 0.72 THEN 3 ELSE 1 END AS level FROM confidence c JOIN tasks t USING (task_id)
), chosen AS (
  SELECT l.task_id, l.level, v.direct, v.neighbours, v.tokens, l.confidence FROM levels l
  JOIN (VALUES (0, 1, 0, 200), (1, 3, 1, 250), (2, 6, 2, 400), (3, 8, 3, 600)) v(level, direct, neighbours, tokens) USING (level)
)"""
_DIRECT = "direct_syms AS (SELECT p.* FROM promoted p JOIN chosen c USING (task_id) WHERE p.pos <= c.direct)"
_TYPES = """type_deps AS (
  SELECT DISTINCT w.task_id, s.sym_id FROM (
    SELECT DISTINCT d.task_id, d.project, unnest(string_split_regex(s.source_text, '[^A-Za-z0-9_$]+')) AS symbol FROM direct_syms d JOIN symbols s USING (sym_id)) w
  JOIN symbols s ON s.project = w.project AND s.symbol = w.symbol WHERE s.kind IN ('interface', 'type', 'enum', 'class') AND w.symbol <> ''
)"""
_EDGES = """edges AS (
  SELECT project, src, dst FROM imports UNION SELECT project, dst, src FROM imports
  UNION SELECT c.project, c.file, s.file FROM callees c JOIN symbols s ON s.project = c.project AND s.symbol = c.name WHERE c.file <> s.file
)"""
_NEAR = """srcs AS (SELECT DISTINCT task_id, project, file AS src FROM direct_syms
), called AS (SELECT DISTINCT f.task_id, c.name AS symbol FROM srcs f JOIN callees c ON c.project = f.project AND c.file = f.src
), near AS (
  SELECT n.task_id, s.sym_id, s.file, s.symbol, round(coalesce(sc.score, 0.0) + CASE WHEN cl.symbol IS NOT NULL THEN 3.0 ELSE 0.0 END + 0.4, 6)::DOUBLE AS score,
    CASE WHEN cl.symbol IS NOT NULL THEN 'callee' ELSE 'imported' END AS relation
  FROM (SELECT DISTINCT f.task_id, f.project, e.dst AS file FROM srcs f JOIN edges e ON e.project = f.project AND e.src = f.src) n
  JOIN symbols s ON s.project = n.project AND s.file = n.file LEFT JOIN scores sc ON sc.task_id = n.task_id AND sc.sym_id = s.sym_id
  LEFT JOIN called cl ON cl.task_id = n.task_id AND cl.symbol = s.symbol
), every AS (
  SELECT d.task_id, d.sym_id, s.file, s.symbol, 5.0::DOUBLE AS score, 'type_dependency' AS relation FROM type_deps d JOIN symbols s USING (sym_id)
  UNION ALL SELECT * FROM near WHERE score > 0.3 OR relation = 'callee'
), fresh AS (
  SELECT e.* FROM every e WHERE NOT EXISTS (SELECT 1 FROM direct_syms d WHERE d.task_id = e.task_id AND d.file = e.file AND d.symbol = e.symbol)
  QUALIFY row_number() OVER (PARTITION BY e.task_id, e.file, e.symbol ORDER BY e.score DESC, CASE WHEN e.relation = 'type_dependency' THEN 0 ELSE 1 END, e.sym_id) = 1
), neighbours AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, CASE WHEN relation = 'type_dependency' THEN 0 ELSE 1 END, sym_id) AS rank FROM fresh)
  JOIN chosen USING (task_id) WHERE rank <= neighbours
)"""
_TO_DIRECT = (*Q._BASE, S.RANKED.strip(), Q._IMPORTS, Q._PROMOTED, Q.CONFIDENCE, _LEVELS, _DIRECT)
_TO_NEAR = (*_TO_DIRECT, Q._CALLEES, _EDGES, _TYPES, _NEAR)

_OPERATIONS = """ops AS (
  SELECT sym_id AS op_id, file_id, symbol, ['replace_symbol', 'delete_symbol', 'insert_before_symbol', 'insert_after_symbol'][(sym_id % 4 + 1)::INT] AS operation,
    '// ' || signature || chr(10) AS content FROM symbols
), place AS (SELECT file_id, symbol, count(*) AS matches, min(start) AS s, min("end") AS e FROM symbols GROUP BY ALL
), resolved AS (
  SELECT o.op_id, o.file_id, o.operation, CASE WHEN o.operation = 'insert_after_symbol' THEN p.e ELSE p.s END AS start,
    CASE WHEN o.operation = 'insert_before_symbol' THEN p.s ELSE p.e END AS "end", CASE WHEN p.matches > 1 THEN 'AMBIGUOUS_SYMBOL' END AS code,
    CASE WHEN o.operation = 'delete_symbol' THEN '' WHEN (length(f.text) - length(replace(f.text, chr(13) || chr(10), ''))) / 2 > len(string_split(f.text, chr(10))) - 1 - (length(f.text) - length(replace(f.text, chr(13) || chr(10), ''))) / 2
      THEN replace(o.content, chr(10), chr(13) || chr(10)) ELSE o.content END AS value
  FROM ops o JOIN place p USING (file_id, symbol) JOIN indexed_file f USING (file_id)
), marked AS (
  SELECT *, coalesce(lead("end") OVER (PARTITION BY file_id ORDER BY start DESC, "end" DESC, op_id) > start, false) AS overlap FROM resolved WHERE code IS NULL
), plan AS (
  SELECT r.file_id, r.operations, r.refused, coalesce(m.overlapping, false) AS overlapping, r.refused = 0 AND NOT coalesce(m.overlapping, false) AS applicable
  FROM (SELECT file_id, count(*) AS operations, count(code) AS refused FROM resolved GROUP BY file_id) r
  LEFT JOIN (SELECT file_id, bool_or(overlap) AS overlapping FROM marked GROUP BY file_id) m USING (file_id)
)"""

_CALLS = "calls AS (SELECT event_id, ts, event_type AS tool, value, coalesce((props->>'k')::INT, 0) >= 90 AS is_error FROM events)"
_MEAN = "length({p}) / (length({p}) - length(replace({p}, chr(10), '')) + 1)"
_BUNDLE = "(strlen(text) >= 20000 AND (" + _MEAN.format(p="text[1:65536]") + " > 400 OR " + _MEAN.format(p="text[greatest(1, floor(length(text) / 2) - 32768)::INT:greatest(1, floor(length(text) / 2) - 32768)::INT + 65535]") + " > 400))"

ORACLE_SQL = {
    "s2_scan_filters": f"""SELECT file_id, regexp_matches(relative, '\\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$') OR regexp_matches(relative, '{S.CONFIG_NAME}') AS is_source,
  len(list_filter(string_split(relative, '/')[1:-2], lambda d: list_contains({S.quoted(X.C.SKIPPED_DIRECTORIES)}, d) OR regexp_matches(d, '^(dist|build|out|target)[-_.]'))) > 0 AS is_skipped,
  {_BUNDLE} AS is_bundle, {S.is_test_path('relative')} AS is_test FROM indexed_file WHERE text IS NOT NULL""",
    "fn_p12_token_estimate": "SELECT source, count(*) AS docs, sum(greatest(1, ceil(length(text) / 4)))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source",
    "fn_p16_line_endings": """SELECT doc_id, CASE WHEN nl = 0 THEN 'aNbRNc' WHEN crlf > nl - crlf THEN 'aRNbRNc' ELSE 'aNbNc' END AS written FROM (
  SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS nl, (length(text) - length(replace(text, chr(13) || chr(10), ''))) / 2 AS crlf FROM documents WHERE text IS NOT NULL)""",
    "x10_line_ranges": S.with_(
        S.SYMBOLS.strip(),
        select="""SELECT sym_id, (length(t[1:start]) - length(replace(t[1:start], chr(10), '')) + 1)::INT AS first_line,
  (length(t[1:"end" - 1]) - length(replace(t[1:"end" - 1], chr(10), '')) + 1)::INT AS last_line
FROM (SELECT s.sym_id, s.start, s."end", f.text AS t FROM symbols s JOIN indexed_file f USING (file_id))""",
    ),
    "x11_embedding_documents": """SELECT file_id, (concat('passage: ', regexp_replace(relative, '[/_.-]', ' ', 'g'), ' ',
  array_to_string(regexp_extract_all(text[1:4000], 'export\\s+(?:async\\s+)?(?:function|const|class|interface|type)\\s+([A-Za-z0-9_]+)', 1)[1:12], ' '), ' ',
  regexp_replace(array_to_string(regexp_extract_all(text[1:4000], '["''`][^"''`\\n]{8,60}["''`]')[1:6], ' '), '["''`]', '', 'g')))[1:500] AS document
FROM indexed_file WHERE text IS NOT NULL""",
    "x12_package_directories": """WITH files AS (SELECT DISTINCT project, relative FROM indexed_file), manifests AS (
  SELECT DISTINCT project, regexp_replace(relative, '/?[^/]*$', '') AS folder FROM files WHERE regexp_matches(relative, '(^|/)package(-lock)?\\.json$')
), best AS (
  SELECT f.project, f.relative, arg_max(m.folder, length(m.folder)) AS folder FROM files f JOIN manifests m ON m.project = f.project AND (m.folder = '' OR starts_with(f.relative, m.folder || '/')) GROUP BY ALL
) SELECT f.project, f.relative AS file, CASE WHEN coalesce(b.folder, '') = '' THEN '.' ELSE b.folder END AS package_dir FROM files f LEFT JOIN best b USING (project, relative)""",
    "k2_levels": S.with_(*_TO_DIRECT[:-1], select="SELECT task_id, level, direct, neighbours, tokens, confidence FROM chosen"),
    "t4_neighbours": S.with_(*_TO_NEAR, select="SELECT task_id, rank, sym_id, file, symbol, relation, score FROM neighbours"),
    "j6_type_dependencies": S.with_(*_TO_DIRECT, _TYPES, select="SELECT task_id, sym_id FROM type_deps"),
    "e1_lookup": S.with_(
        S.SYMBOLS.strip(),
        Q._CALLEES,
        select="""SELECT project, name, rank, matches, sym_id, CASE WHEN matches = 1 THEN 0.95 ELSE 0.65 END::DOUBLE AS confidence, CASE WHEN matches = 1 THEN length(source_text) END AS source_chars FROM (
  SELECT n.project, n.name, s.sym_id, s.source_text, count(*) OVER (PARTITION BY n.project, n.name) AS matches, row_number() OVER (PARTITION BY n.project, n.name ORDER BY s.sym_id) AS rank
  FROM (SELECT DISTINCT project, name FROM callees) n JOIN symbols s ON s.project = n.project AND s.symbol = string_split_regex(n.name, '[.#]')[-1]) WHERE rank <= 8""",
    ),
    "e4_references": """SELECT ref, count(*) AS records, min(evidence_id) AS first_id FROM (
  SELECT evidence_id, 'ev_' || sha256(concat_ws(chr(31), coalesce(project, ''), coalesce(file, ''), coalesce(snapshot, ''), coalesce(kind, ''), coalesce(symbol, ''), text)) AS ref
  FROM evidence_record WHERE text IS NOT NULL) GROUP BY ref""",
    "e4_append": """WITH r AS (SELECT evidence_id, kind, 'ev_' || sha256(concat_ws(chr(31), coalesce(project, ''), coalesce(file, ''), coalesce(snapshot, ''), coalesce(kind, ''), coalesce(symbol, ''), text)) AS ref
  FROM evidence_record WHERE text IS NOT NULL) SELECT ref, min(evidence_id) AS evidence_id FROM r WHERE kind = 'delta' AND ref NOT IN (SELECT ref FROM r WHERE kind IS NULL OR kind <> 'delta') GROUP BY ref""",
    "e5_pages": f"""SELECT evidence_id, page, (page * {880})::INT AS "offset", CASE WHEN (page + 1) * 880 < length(text) THEN ((page + 1) * 880)::INT END AS next_offset, length(text)::INT AS total_chars,
  (page + 1) * 880 >= length(text) AS done, md5(text[page * 880 + 1:(page + 1) * 880]) AS source_md5
FROM (SELECT evidence_id, text, unnest(range(0, greatest(1, ceil(length(text) / 880))::BIGINT))::INT AS page FROM evidence_record WHERE text IS NOT NULL)""",
    "e7_deltas": """WITH pairs AS (
  SELECT evidence_id, prev_id, a.text AS after, b.text AS before FROM (
    SELECT evidence_id, text, lag(evidence_id) OVER (PARTITION BY project, file ORDER BY evidence_id) AS prev_id FROM evidence_record WHERE text IS NOT NULL) a
  JOIN (SELECT evidence_id AS prev_id, text FROM evidence_record) b USING (prev_id)
), heads AS (
  SELECT *, (SELECT max(n) FROM range(0, least(length(before), length(after)) + 1) t(n) WHERE starts_with(after, before[1:n])) AS k FROM pairs
), tails AS (
  SELECT *, (SELECT max(n) FROM range(0, least(length(before), length(after)) - k + 1) t(n) WHERE ends_with(after, before[length(before) - n + 1:])) AS m FROM heads
)
SELECT evidence_id, prev_id, k::INT AS "offset", (length(before) - k - m)::INT AS delete_chars, (length(after) - k - m)::INT AS insert_chars FROM tails""",
    "e8_delta_apply": """SELECT evidence_id, prev_id, md5(text) AS after_md5, true AS intact FROM (
  SELECT evidence_id, text, lag(evidence_id) OVER (PARTITION BY project, file ORDER BY evidence_id) AS prev_id FROM evidence_record WHERE text IS NOT NULL) WHERE prev_id IS NOT NULL""",
    "m1_resolved": S.with_(S.SYMBOLS.strip(), _OPERATIONS, select='SELECT op_id, file_id, operation, start, "end", code, length(value) AS value_chars FROM resolved'),
    "m3_plan": S.with_(S.SYMBOLS.strip(), _OPERATIONS, select="SELECT * FROM plan"),
    "m4_splice": S.with_(
        S.SYMBOLS.strip(),
        _OPERATIONS,
        select="""SELECT file_id, md5(string_agg(piece, '' ORDER BY n) || max(tail)) AS patched_md5 FROM (
  SELECT f.file_id, r.n, f.text[coalesce(r.prev, 0) + 1:r.start] || r.value AS piece, f.text[r.last + 1:] AS tail FROM (
    SELECT *, lag("end") OVER w AS prev, row_number() OVER w AS n, max("end") OVER (PARTITION BY file_id) AS last FROM resolved
    WINDOW w AS (PARTITION BY file_id ORDER BY start, "end", op_id DESC)) r
  JOIN indexed_file f USING (file_id) JOIN plan p USING (file_id) WHERE p.applicable) GROUP BY file_id""",
    ),
    "v1_cosine_topk": """SELECT query_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
    "v3_pending": "SELECT DISTINCT sha256(text) AS key FROM indexed_file WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM evidence_record WHERE text IS NOT NULL)",
    "r1_metrics": S.with_(
        *Q._BASE,
        S.RANKED.strip(),
        select="""SELECT count(*) AS tasks, round(count(first) / count(*), 6) AS hit_at_1, round(coalesce(sum(hits), 0) / sum(wanted), 6) AS recall, round(coalesce(sum(hits), 0) / sum(returned), 6) AS precision FROM (
  SELECT w.task_id, w.wanted, j.returned, j.hits, j.first FROM (SELECT task_id, count(*) AS wanted FROM truth GROUP BY task_id) w LEFT JOIN (
    SELECT task_id, count(*) AS returned, count(r) AS hits, max(CASE WHEN pos = 1 THEN r END) AS first FROM (
      SELECT a.task_id, a.file, a.pos, CASE WHEN t.file IS NOT NULL THEN 1 END AS r FROM (SELECT task_id, file, min(pos) AS pos FROM ranked GROUP BY ALL) a LEFT JOIN truth t USING (task_id, file)) GROUP BY task_id) j USING (task_id))""",
    ),
    "r4_totals": f"SELECT record_id, {_TOTAL} AS total_tokens FROM evaluation_run",
    "r5_compare": S.with_(_CASES, select="SELECT * FROM cases"),
    "r6_summary": S.with_(
        _CASES,
        select="""SELECT count(*) AS cases, count(*) FILTER (WHERE regression) AS regressions, count(*) FILTER (WHERE before_tokens IS NULL OR after_tokens IS NULL) AS unmeasured,
  bool_and(paired AND passed AND within_target AND before_tokens IS NOT NULL) AS accepted, quantile_cont(after_tokens, 0.5)::DOUBLE AS median_tokens,
  (list(after_tokens ORDER BY after_tokens) FILTER (WHERE after_tokens IS NOT NULL))[ceil(0.95 * count(after_tokens))::INT] AS p95_tokens FROM cases""",
    ),
    "r8_usage": S.with_(
        _CALLS,
        select="""SELECT tool, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors, (list(value ORDER BY value) FILTER (WHERE value IS NOT NULL))[(count(value) // 2 + 1)::INT] AS upper_median,
  round(count(*) FILTER (WHERE is_error) / count(*), 6) AS error_rate FROM calls GROUP BY tool""",
    ),
    "r9_rates": f"""SELECT model, count(*) AS runs, count(*) FILTER (WHERE coalesce(passed, false)) AS passed, count(*) FILTER (WHERE {_TOTAL} IS NULL) AS unmeasured,
  round(count(*) FILTER (WHERE coalesce(passed, false)) / count(*), 6) AS pass_rate FROM evaluation_run GROUP BY model""",
    "r10_reasons": S.with_(
        *Q._BASE, S.RANKED.strip(), Q.CONFIDENCE,
        select="SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM confidence) GROUP BY reason ORDER BY n DESC, reason LIMIT 8",
    ),
    "b10_budget_ledger": """SELECT record_id, (i - 1)::INT AS pos, coalesce(r.input, 0) + coalesce(r.output, 0) AS used,
  (sum(coalesce(r.input, 0) + coalesce(r.output, 0)) OVER (PARTITION BY record_id ORDER BY i))::BIGINT AS running
FROM (SELECT record_id, i, requests[i] AS r FROM (SELECT record_id, requests, unnest(range(1, len(requests) + 1)) AS i FROM evaluation_run)) WHERE r IS NOT NULL""",
    "w1_stream_usage": S.with_(
        _CALLS,
        select="""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, tool, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors, round(sum(value), 4) AS total FROM calls
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM calls) GROUP BY ALL""",
    ),
}
_TRUTH = """truth AS (
  SELECT DISTINCT m.task_id, s.file FROM (SELECT DISTINCT task_id, project, unnest(regexp_extract_all(task, '([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS symbol FROM tasks) m
  JOIN symbols s USING (project, symbol) WHERE regexp_matches(m.symbol, '[a-z][A-Z]')
)"""
ORACLE_SQL["r1_metrics"] = S.with_(
    *Q._BASE,
    S.RANKED.strip(),
    _TRUTH,
    select=ORACLE_SQL["r1_metrics"].split("pos <= 20\n)\n", 1)[1],
)

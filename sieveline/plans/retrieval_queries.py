"""Queries of the index and the ranking: source files as symbols, evaluation texts as tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import index as I
from sieveline.operators import ranking as R
from sieveline.plans import sql_text as S
from sieveline.session import checkpointed, read_table, spread_if_narrow


class Corpus:
    """The index of one data folder, built once per query; what several steps read is checkpointed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.files = spread_if_narrow(read_table(spark, sf_dir, "indexed_file").select("file_id", "project", "relative", "text"))
        self.symbols = checkpointed(I.symbols(self.files))
        self.tokens = checkpointed(I.fields(self.symbols))
        self.tasks = checkpointed(_tasks(spark, sf_dir))
        self.df, self.stats = checkpointed(I.doc_freq(self.tokens)), checkpointed(I.corpus_stats(self.tokens))

    def scores(self) -> DataFrame:
        return R.scores(self.tasks, self.symbols, self.tokens, self.df, self.stats)

    def scores_of(self, some: DataFrame) -> DataFrame:
        return R.scores(self.tasks, self.symbols, self.tokens, self.df, self.stats, some)

    def ranked(self) -> DataFrame:
        return R.rank(self.scores(), self.symbols)

    def promoted(self) -> DataFrame:
        return R.promote(checkpointed(self.ranked()), self.tasks, I.resolved_imports(self.files))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.symbols(read_table(spark, sf_dir, "indexed_file"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fields(spread_if_narrow(_symbols(spark, sf_dir)))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation texts as tasks, dealt out to the projects of the index."""
    return R.tasks(R.dealt(read_table(spark, sf_dir, "eval_item"), "item_id", read_table(spark, sf_dir, "indexed_file")), "item_id", "text")


def x1_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).select("sym_id", "project", "file", "symbol", "kind", "start", "end", "signature", F.md5("body").alias("body_md5"))


def a1_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.doc_freq(_tokens(spark, sf_dir))


def a2_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.corpus_stats(_tokens(spark, sf_dir)).select("project", "n", F.round("avgdl", 6).alias("avgdl"))


def a4_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = Corpus(spark, sf_dir).scores().where("bm25 > 0")
    return scored.select("task_id", "sym_id", F.round("bm25", 6).alias("bm25"), "concepts", "path_hits")


def a10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).scores().select("task_id", "sym_id", F.round("lexical", 6).alias("lexical"), "score")


def t1_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).ranked().select("task_id", "pos", "sym_id", "file", "symbol", "kind", "score")


def t3_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).promoted().select("task_id", "pos", "sym_id", "file", "symbol")


def a11_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return R.confidence(checkpointed(c.ranked()), c.tasks, c.tokens)


def fn_p3_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.task_terms(_tasks(spark, sf_dir)).select("task_id", "term", "concept")


def fn_p6_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, intents and quality criteria of every task."""
    return _tasks(spark, sf_dir).select(
        "task_id", "lang", "test_intent", "mechanical", "sample_intent", "runtime_intent", "config_intent", F.array_join("criteria", ",").alias("criteria"), F.array_join("query", " ").alias("query")
    )


def fn_p2_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


def x9_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resolved_imports(read_table(spark, sf_dir, "indexed_file"))


def x7_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.import_specifiers(read_table(spark, sf_dir, "indexed_file")).select("file_id", "specifier")


def x8_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.callees(read_table(spark, sf_dir, "indexed_file")).select("file_id", "name")


def j2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "indexed_file")
    return I.edges(files, I.symbols(files))


def fn_p15_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.snapshot(read_table(spark, sf_dir, "indexed_file"))


QUERIES = {
    "fn_p2_tokenize": fn_p2_tokenize,
    "fn_p3_query_terms": fn_p3_query_terms,
    "fn_p6_tasks": fn_p6_tasks,
    "fn_p15_snapshot": fn_p15_snapshot,
    "x1_symbols": x1_symbols,
    "x7_specifiers": x7_specifiers,
    "x8_callees": x8_callees,
    "x9_imports": x9_imports,
    "j2_edges": j2_edges,
    "a1_doc_freq": a1_doc_freq,
    "a2_corpus_stats": a2_corpus_stats,
    "a4_bm25": a4_bm25,
    "a10_scores": a10_scores,
    "a11_confidence": a11_confidence,
    "t1_rank": t1_rank,
    "t3_promotion": t3_promotion,
}

_BASE = (S.SYMBOLS.strip(), S.TOKENS.strip(), S.TASKS.strip(), S.SCORES.strip())

_SPECIFIERS = """specifiers AS (
  SELECT DISTINCT file_id, project, relative AS file, unnest(regexp_extract_all(text, '(?m)^import\\s[^''"\\n{]*(?:\\{[^{}''"]*\\}[^''"\\n]*)?[''"]([^''"\\n]+)[''"]', 1)) AS specifier
  FROM indexed_file WHERE text IS NOT NULL
)"""
_CALLEES = """callees AS (
  SELECT DISTINCT file_id, project, relative AS file, unnest(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\\(', 1)) AS name
  FROM indexed_file WHERE text IS NOT NULL
)"""
_IMPORTS = (
    _SPECIFIERS
    + """, asked AS (
  SELECT DISTINCT project, file, specifier, CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '' END || '/' || specifier AS raw
  FROM specifiers WHERE starts_with(specifier, './') OR starts_with(specifier, '../')
), simple AS (
  SELECT *, list_filter(string_split(raw, '/'), lambda s: s <> '' AND s <> '.') AS segs FROM asked
), up AS (
  SELECT *, len(list_filter(segs, lambda s: s = '..')) AS ups, list_filter(segs, lambda s: s <> '..') AS names,
    len(list_filter(string_split(CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '' END, '/'), lambda s: s <> '' AND s <> '.')) AS depth FROM simple
), based AS (
  SELECT *, array_to_string(list_concat(names[1:greatest(depth - ups, 0)], names[depth + 1:]), '/') AS base FROM up
), cands AS (
  SELECT project, file, specifier, o AS ord, c[o] AS candidate FROM (
    SELECT *, unnest(range(1, len(c) + 1)) AS o FROM (
      SELECT *, list_concat([base, bare], list_transform(['.ts', '.tsx', '.mts', '.cts', '.d.ts', '/index.ts', '/index.tsx', '/index.mts', '/index.cts'], lambda t: bare || t)) AS c
      FROM (SELECT *, regexp_replace(base, '\\.(js|jsx|mjs|cjs)$', '') AS bare FROM based)))
), imports AS (
  SELECT DISTINCT project, file AS src, dst FROM (
    SELECT c.project, c.file, c.specifier, arg_min(c.candidate, c.ord) AS dst FROM cands c
    JOIN (SELECT DISTINCT project, relative FROM indexed_file WHERE text IS NOT NULL) k ON k.project = c.project AND k.relative = c.candidate
    GROUP BY c.project, c.file, c.specifier) WHERE file <> dst
)"""
)
_PROMOTED = f"""leaders AS (
  SELECT r.task_id, r.project, r.file AS src, r.score AS top_score FROM ranked r JOIN tasks k USING (task_id)
  WHERE r.pos = 1 AND NOT k.test_intent AND {S.is_test_path('r.file')}
), moved AS (
  SELECT task_id, from_pos FROM (
    SELECT r.task_id, min(r.pos) AS from_pos, arg_min(r.score, r.pos) AS sc, any_value(l.top_score) AS top_score
    FROM ranked r JOIN leaders l ON l.task_id = r.task_id AND l.project = r.project JOIN imports i ON i.project = l.project AND i.src = l.src AND i.dst = r.file
    WHERE r.pos > 1 AND NOT {S.is_test_path('r.file')} GROUP BY r.task_id) WHERE sc >= 0.75 * top_score
), promoted AS (
  SELECT r.* EXCLUDE (pos), (CASE WHEN c.from_pos IS NULL THEN r.pos WHEN r.pos = c.from_pos THEN 1 WHEN r.pos < c.from_pos THEN r.pos + 1 ELSE r.pos END)::INT AS pos
  FROM ranked r LEFT JOIN moved c USING (task_id)
)"""

CONFIDENCE = """seen AS (
  SELECT r.task_id, count(*) AS n_direct, max(r.score) FILTER (WHERE r.pos = 1) AS top, max(r.score) FILTER (WHERE r.pos = 2) AS second,
    flatten(list(CASE WHEN r.pos <= 5 THEN list_concat(t.name, t.path) ELSE [] END)) AS covered, list(lower(r.symbol || ' ' || r.file)) AS texts
  FROM ranked r JOIN tokens t USING (sym_id) WHERE r.pos <= 8 GROUP BY r.task_id
), judged AS (
  SELECT k.task_id, coalesce(s.n_direct, 0) AS n_direct, s.top, round(s.top - coalesce(s.second, 0.0), 6) AS margin,
    CASE WHEN s.n_direct IS NULL THEN NULL WHEN len(k.query) = 0 THEN 0.0 ELSE round(len(list_filter(k.query, lambda q: list_contains(s.covered, q)
      OR len(list_filter(s.texts, lambda t: contains(t, q))) > 0)) / len(k.query), 6) END AS coverage
  FROM tasks k LEFT JOIN seen s USING (task_id)
), reasoned AS (
  SELECT *, list_filter([CASE WHEN n_direct = 0 THEN 'no_match' END, CASE WHEN coverage < 0.35 THEN 'low_coverage' END,
    CASE WHEN top < 3 THEN 'weak_top' END, CASE WHEN margin < 0.75 AND n_direct > 3 THEN 'ambiguous' END], lambda r: r IS NOT NULL) AS reasons,
    greatest(0.3, least(0.95, 0.42 + 0.28 * least(1.0, coverage) + 0.16 * least(1.0, top / 12) + 0.08 * least(1.0, margin / 4) + 0.04 * least(n_direct, 4))) AS raw
  FROM judged
), confidence AS (
  SELECT task_id, n_direct, top, margin, coverage, round(CASE WHEN n_direct = 0 THEN 0.28 WHEN len(reasons) >= 2 THEN least(raw, 0.68) ELSE raw END, 6)::DOUBLE AS confidence, reasons
  FROM reasoned
)"""

ORACLE_SQL = {
    "fn_p2_tokenize": f"SELECT doc_id, array_to_string({S.tokenize('text')}, ' ') AS tokens FROM documents WHERE text IS NOT NULL",
    "fn_p3_query_terms": S.with_(S.TASKS.strip(), select="SELECT task_id, term, concept FROM terms"),
    "fn_p6_tasks": S.with_(
        S.TASKS.strip(),
        select="SELECT task_id, lang, test_intent, mechanical, sample_intent, runtime_intent, config_intent, array_to_string(criteria, ',') AS criteria, array_to_string(query, ' ') AS query FROM tasks",
    ),
    "fn_p15_snapshot": """
SELECT project, sha256(string_agg(part, chr(10) ORDER BY part)) AS snapshot FROM (
  SELECT project, bucket, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS part FROM (
    SELECT DISTINCT project, entry, sha256(entry)[1:3] AS bucket FROM (SELECT project, relative || ':' || sha256(text) AS entry FROM indexed_file WHERE text IS NOT NULL))
  GROUP BY project, bucket) GROUP BY project""",
    "x1_symbols": S.with_(S.SYMBOLS.strip(), select='SELECT sym_id, project, file, symbol, kind, start, "end", signature, md5(body) AS body_md5 FROM symbols'),
    "x7_specifiers": S.with_(_SPECIFIERS, select="SELECT file_id, specifier FROM specifiers"),
    "x8_callees": S.with_(_CALLEES, select="SELECT file_id, name FROM callees"),
    "x9_imports": S.with_(_IMPORTS, select="SELECT project, src, dst FROM imports"),
    "j2_edges": S.with_(
        S.SYMBOLS.strip(),
        _IMPORTS,
        _CALLEES,
        select="""
SELECT project, src, dst, 'import' AS kind FROM imports UNION ALL SELECT project, dst, src, 'imported_by' FROM imports
UNION ALL SELECT DISTINCT c.project, c.file, s.file, 'call' FROM callees c JOIN symbols s ON s.project = c.project AND s.symbol = c.name WHERE c.file <> s.file""",
    ),
    "a1_doc_freq": S.with_(S.SYMBOLS.strip(), S.TOKENS.strip(), select="SELECT project, term, df FROM doc_freq"),
    "a2_corpus_stats": S.with_(S.SYMBOLS.strip(), S.TOKENS.strip(), select="SELECT project, n, round(avgdl, 6) AS avgdl FROM stats"),
    "a4_bm25": S.with_(*_BASE, select="SELECT task_id, sym_id, round(bm25, 6) AS bm25, concepts::INT AS concepts, path_hits FROM bm25 WHERE bm25 > 0"),
    "a10_scores": S.with_(*_BASE, select="SELECT task_id, sym_id, round(lexical, 6) AS lexical, score FROM scores"),
    "a11_confidence": S.with_(*_BASE, S.RANKED.strip(), CONFIDENCE, select="SELECT * FROM confidence"),
    "t1_rank": S.with_(*_BASE, S.RANKED.strip(), select="SELECT task_id, pos, sym_id, file, symbol, kind, score FROM ranked"),
    "t3_promotion": S.with_(*_BASE, S.RANKED.strip(), _IMPORTS, _PROMOTED, select="SELECT task_id, pos, sym_id, file, symbol FROM promoted"),
}

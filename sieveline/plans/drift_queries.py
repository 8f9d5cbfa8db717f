"""Queries of problem 3: harness files whose fields drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.drift import changes, consistent_table, file_headers, fold
from sieveline.session import checkpointed, read_table


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_headers(read_table(spark, sf_dir, "run_file"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(checkpointed(_headers(spark, sf_dir)), checkpointed)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("harness", "file_kind", "batch", "change_kind", "field_path", "new_path")


def p3_union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted type of every path per file kind, over all harnesses and batches."""
    return fold(_headers(spark, sf_dir), "file_kind")


def p3_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _changes(spark, sf_dir)
    return log.groupBy("file_kind", "change_kind", "field_path", "new_path").agg(F.count(F.lit(1)).alias("n"))


def _table(file_kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        headers = checkpointed(_headers(spark, sf_dir))
        return consistent_table(read_table(spark, sf_dir, "run_file"), headers, changes(headers, checkpointed), file_kind)

    return query


QUERIES = {
    "p3_found": p3_found,
    "p3_union_schema": p3_union_schema,
    "p3_change_counts": p3_change_counts,
    "p3_run_meta": _table("run_meta"),
    "p3_validation": _table("validation"),
}

_LEAVES = """
WITH files AS (
  SELECT DISTINCT harness, file_kind, batch, file_name, payload::JSON AS doc FROM run_file WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'
), nodes AS (
  SELECT f.harness, f.file_kind, f.batch, f.file_name, t.id, t.type, t.value, t.fullkey FROM files f, json_tree(f.doc) t
), named AS (
  SELECT *, replace(regexp_replace(regexp_replace(fullkey, '^\\$\\.?', ''), '\\[\\d+\\]', '[]', 'g'), '"', '') AS path FROM nodes
), leaves AS (
  SELECT harness, file_kind, batch, file_name, path, id, value,
    CASE WHEN type = 'ARRAY' THEN 'array' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'VARCHAR' THEN 'string' WHEN type <> 'NULL' THEN 'number' END AS type
  FROM named WHERE path <> '' AND type <> 'OBJECT' AND NOT (type = 'ARRAY' AND contains(value::VARCHAR, '{')) AND NOT ends_with(path, '[]')
), per_file AS (
  SELECT harness, file_kind, batch, file_name, path, list(value ORDER BY id)::VARCHAR AS content, count(type) AS present FROM leaves GROUP BY ALL
), batch_fields AS (
  SELECT harness, file_kind, batch, path, CASE WHEN count(DISTINCT type) > 1 THEN CASE WHEN bool_or(type = 'array') THEN 'array' ELSE 'string' END ELSE max(type) END AS type
  FROM leaves GROUP BY ALL
)"""

ORACLE_SQL: dict[str, str] = {
    "p3_found": _LEAVES
    + """, steps AS (
  SELECT * FROM (SELECT harness, file_kind, batch, lag(batch) OVER (PARTITION BY harness, file_kind ORDER BY batch) AS prev FROM (SELECT DISTINCT harness, file_kind, batch FROM batch_fields))
  WHERE prev IS NOT NULL
), old AS (SELECT s.harness, s.file_kind, s.batch, s.prev, f.path, f.type FROM steps s JOIN batch_fields f ON f.harness = s.harness AND f.file_kind = s.file_kind AND f.batch = s.prev
), new AS (SELECT s.harness, s.file_kind, s.batch, s.prev, f.path, f.type FROM steps s JOIN batch_fields f ON f.harness = s.harness AND f.file_kind = s.file_kind AND f.batch = s.batch
), gone AS (SELECT * FROM old ANTI JOIN new USING (harness, file_kind, batch, path)
), come AS (SELECT * FROM new ANTI JOIN old USING (harness, file_kind, batch, path)
), shown AS (
  SELECT g.harness, g.file_kind, g.batch, g.path AS old_path, c.path AS new_path, count(*) FILTER (WHERE a.content = b.content) AS same, count(*) AS seen
  FROM gone g JOIN come c ON c.harness = g.harness AND c.file_kind = g.file_kind AND c.batch = g.batch AND c.type = g.type
  JOIN per_file a ON a.harness = g.harness AND a.file_kind = g.file_kind AND a.batch = g.prev AND a.path = g.path AND a.present > 0
  JOIN per_file b ON b.harness = g.harness AND b.file_kind = g.file_kind AND b.batch = g.batch AND b.path = c.path AND b.present > 0 AND b.file_name = a.file_name
  GROUP BY ALL
), spelled AS (
  SELECT g.harness, g.file_kind, g.batch, g.path AS old_path, c.path AS new_path, true AS spelled FROM gone g JOIN come c
  ON c.harness = g.harness AND c.file_kind = g.file_kind AND c.batch = g.batch AND c.type = g.type
    AND lower(regexp_replace(c.path, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(g.path, '[^A-Za-z0-9]', '', 'g'))
), kept AS (
  SELECT harness, file_kind, batch, old_path, new_path, coalesce(same, 0) AS same, coalesce(spelled, false) AS spelled
  FROM shown FULL OUTER JOIN spelled USING (harness, file_kind, batch, old_path, new_path) WHERE same = seen OR (seen IS NULL AND spelled)
), renames AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY harness, file_kind, batch, old_path ORDER BY same DESC, spelled DESC, new_path) AS o,
    row_number() OVER (PARTITION BY harness, file_kind, batch, new_path ORDER BY same DESC, spelled DESC, old_path) AS n FROM kept) WHERE o = 1 AND n = 1
)
SELECT harness, file_kind, batch, 'renamed' AS change_kind, old_path AS field_path, new_path FROM renames
UNION ALL SELECT g.harness, g.file_kind, g.batch, 'removed', g.path, '' FROM gone g
  WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.harness = g.harness AND r.file_kind = g.file_kind AND r.batch = g.batch AND r.old_path = g.path)
UNION ALL SELECT c.harness, c.file_kind, c.batch, 'added', c.path, '' FROM come c
  WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.harness = c.harness AND r.file_kind = c.file_kind AND r.batch = c.batch AND r.new_path = c.path)
UNION ALL SELECT o.harness, o.file_kind, o.batch, 'retyped', o.path, '' FROM old o JOIN new n USING (harness, file_kind, batch, path) WHERE o.type <> n.type
""",
    "p3_union_schema": _LEAVES
    + """
SELECT file_kind, path, CASE WHEN bool_or(type = 'array') THEN 'array' WHEN count(DISTINCT type) > 1 THEN 'string' ELSE max(type) END AS type, n_files FROM (
  SELECT l.file_kind, l.path, l.type, f.n_files FROM leaves l JOIN (
    SELECT file_kind, path, count(*) AS n_files FROM (
      SELECT r.file_kind, p.path FROM run_file r JOIN (SELECT DISTINCT harness, file_kind, batch, file_name, path FROM leaves) p USING (harness, file_kind, batch, file_name)
      WHERE json_valid(r.payload) AND json_type(r.payload) = 'OBJECT') GROUP BY ALL) f USING (file_kind, path)) GROUP BY file_kind, path, n_files
""",
}
ORACLE_SQL["p3_change_counts"] = f"SELECT file_kind, change_kind, field_path, new_path, count(*) AS n FROM ({ORACLE_SQL['p3_found']}) GROUP BY ALL"

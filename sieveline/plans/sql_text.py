"""Building blocks of the SQL that queries are checked against."""

from __future__ import annotations

from sieveline.functions import constants as C


def quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def fold(x: str) -> str:
    return f"translate(regexp_replace({x}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '{C.FOLD_FROM}', '{C.FOLD_TO}')"


def humps(x: str) -> str:
    once = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"regexp_replace({once}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"


def distinct(x: str) -> str:
    """Distinct values in order."""
    return f"(SELECT list_filter(l, lambda v, i: list_position(l, v) = i) FROM (SELECT {x} AS l))"


def tokenize(x: str) -> str:
    plain = f"lower(regexp_replace({humps(fold(x))}, '[_$/.-]+', ' ', 'g'))"
    kept = f"list_filter(string_split_regex({plain}, '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains({quoted(C.STOPWORDS)}, t))"
    return distinct(kept)


def task_words(x: str) -> str:
    plain = f"lower({humps(fold(x))})"
    kept = f"list_filter(string_split_regex({plain}, '[^a-z0-9_$]+'), lambda t: length(t) >= 2 AND NOT list_contains({quoted(C.TASK_STOPWORDS)}, t))"
    return distinct(kept)


def expansions(w: str) -> str:
    cases = [f"WHEN {w} = '{k}' THEN {quoted(v.split())}" for k, v in C.SYNONYMS.items()]
    cases += [f"WHEN starts_with({w}, '{k}') THEN {quoted(v.split())}" for k, v in C.SYNONYM_PREFIXES]
    for k, v in C.STEMS:
        test = f"{w} = '{k}'" if len(k) < C.SHORTEST_PREFIX_STEM else f"(starts_with({w}, '{k}') AND NOT list_contains({quoted(C.STEM_COLLISIONS)}, {w}))"
        cases.append(f"WHEN {test} THEN {quoted(v.split())}")
    return "CASE " + " ".join(cases) + " ELSE [] END"


TEST_PATH = "(regexp_matches(lower({x}), '(^|/)(test|tests|__tests__|spec|specs)/') OR regexp_matches(lower({x}), '\\.(test|spec)\\.(t|j)sx?$'))"


def is_test_path(x: str) -> str:
    return TEST_PATH.format(x=x)


CONFIG_NAME = "(^|/)(package\\.json|(ts|js)config(\\.[^./]+)?\\.json|[a-z0-9_-]+\\.config\\.(ts|mts|cts|js|mjs|cjs)|\\.eslintrc(\\.(json|js|cjs|yaml|yml))?)$"

#: Declarations, as in operators.index; no look-around, so that both engines read it alike.
DECLARATION = "(?m)^((?:export |default |async |abstract )*)(function|class|interface|enum|type|const|def) +([A-Za-z_$][A-Za-z0-9_$]*)"

MEMBER = "(?m)^[ \\t]+(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract|def) +)*(#?[A-Za-z_$][A-Za-z0-9_$]*)\\([^()\\n]*\\)[^;{}()\\n]*(?:\\{[^\\n]*|:[ \\t\\r]*)\\n"
TEST_CASE = "(?m)^[ \\t]*(?:it|test)(?:\\.[a-z]+)*(?:\\([^()\\n]*\\))?\\([ ]*[\"''`]([^\"''`\\n]+)[\"''`]"


def cut(name: str, source: str, text: str, pattern: str, keep: str) -> str:
    """CTE name: one row per match of a line pattern, with its chunk and the characters before it."""
    return f"""{name} AS (
  SELECT {keep}, parts[i + 1] AS chunk, coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0)::INT AS begins FROM (
    SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT *, string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\0', 'g'), chr(1)) AS parts FROM {source}))
)"""


_FIRST = "regexp_replace(string_split(chunk, chr(10))[1], '\\r$', '')"
_SIGNATURE = f"trim(regexp_replace({_FIRST}, '[ ]*[{{:]?[ ]*$', ''))"

SYMBOLS = f"""
source_files AS (SELECT file_id, project, relative AS file, text FROM indexed_file WHERE text IS NOT NULL
), {cut('declared_at', 'source_files', 'text', DECLARATION, 'file_id, project, file')}, declared AS (
  SELECT file_id, project, file, regexp_extract(chunk, '{DECLARATION}', 3) AS symbol,
    CASE regexp_extract(chunk, '{DECLARATION}', 2) WHEN 'function' THEN 'function' WHEN 'def' THEN 'function' WHEN 'const' THEN 'variable'
      ELSE regexp_extract(chunk, '{DECLARATION}', 2) END AS kind, begins, chunk,
    CASE WHEN regexp_extract(chunk, '{DECLARATION}', 2) = 'const' THEN trim(string_split({_FIRST}, '=')[1]) ELSE {_SIGNATURE} END AS signature
  FROM declared_at
), classes AS (SELECT file_id, project, file, begins AS class_at, chunk AS class_text FROM declared WHERE kind = 'class'
), {cut('member_at', 'classes', 'class_text', MEMBER, 'file_id, project, file, class_at')}, {cut('test_at', 'source_files', 'text', TEST_CASE, 'file_id, project, file')}, found_symbols AS (
  SELECT * FROM declared
  UNION ALL SELECT file_id, project, file, regexp_extract(chunk, '{MEMBER}', 1), 'method', class_at + begins, chunk, {_SIGNATURE} FROM member_at
    WHERE NOT list_contains(['if', 'for', 'while', 'switch', 'catch', 'with', 'function', 'return', 'super'], regexp_extract(chunk, '{MEMBER}', 1))
  UNION ALL SELECT * FROM (SELECT file_id, project, file, trim(regexp_extract(chunk, '{TEST_CASE}', 1))[1:240] AS symbol, 'test', begins, chunk, {_SIGNATURE} FROM test_at) WHERE symbol <> ''
  UNION ALL SELECT file_id, project, file, string_split(file, '/')[-1], 'module', 0, text, string_split(file, '/')[-1] FROM source_files
    WHERE regexp_matches(file, '{CONFIG_NAME}') AND NOT regexp_matches(text, '{DECLARATION}') AND NOT regexp_matches(text, '{TEST_CASE}')
), symbols AS (
  SELECT file_id * 2147483648 + begins AS sym_id, file_id, project, file, symbol, kind, begins AS start, (begins + length(chunk))::INT AS "end", signature, chunk AS source_text,
    chunk[1:CASE WHEN kind IN ('test', 'module') THEN {C.TEST_BODY_CHARS} ELSE {C.BODY_CHARS} END] AS body
  FROM found_symbols
)"""

TOKENS = f"""
tokens AS (
  SELECT sym_id, file_id, project, {tokenize('symbol')} AS name, {tokenize('file')} AS path, {tokenize('signature')} AS signature, {tokenize('body')} AS body
  FROM symbols
), postings AS (
  SELECT unnest(l) AS term, sym_id, file_id, project, field, len(l) AS doc_len FROM (
    SELECT sym_id, file_id, project, 'name' AS field, name AS l FROM tokens UNION ALL SELECT sym_id, file_id, project, 'path', path FROM tokens
    UNION ALL SELECT sym_id, file_id, project, 'signature', signature FROM tokens UNION ALL SELECT sym_id, file_id, project, 'body', body FROM tokens)
), bags AS (
  SELECT sym_id, project, list_concat(list_concat(name, path), list_concat(signature, body[1:{C.BAG_BODY_TOKENS}])) AS bag, len(name) AS extra FROM tokens
), doc_freq AS (
  SELECT project, term, count(*) AS df FROM (SELECT DISTINCT project, sym_id, unnest(bag) AS term FROM bags) GROUP BY project, term
), stats AS (
  SELECT project, count(*) AS n, sum(greatest(len(bag) + extra, 1)) / count(*) AS avgdl FROM bags GROUP BY project
)"""

CLAUSE = "(?i)(^|[^\\pL\\pN_])(ba[sş]ar[iı]\\s+kriter|kabul\\s+kriter|success\\s+criteri|acceptance\\s+criteri|definition\\s+of\\s+done|done\\s+when)"


def terms_of(name: str, source: str, text: str) -> str:
    """CTEs name_words and name(task_id, term, concept): a word blocked by an earlier expansion brings nothing."""
    return f"""
{name}_words AS (
  SELECT task_id, ws[i] AS w, i AS ord, {expansions('ws[i]')} AS syn
  FROM (SELECT task_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT task_id, {task_words(text)} AS ws FROM {source}))
), {name}_open AS (
  SELECT a.* FROM {name}_words a WHERE NOT EXISTS (
    SELECT 1 FROM {name}_words b WHERE b.task_id = a.task_id AND b.ord < a.ord AND list_contains(b.syn, a.w))
), {name}_all AS (
  SELECT task_id, ord, 0 AS k, w AS term FROM {name}_open
  UNION ALL SELECT task_id, ord, k, syn[k] FROM (SELECT task_id, ord, syn, unnest(range(1, len(syn) + 1)) AS k FROM {name}_open)
), {name} AS (
  SELECT task_id, term, min_concept AS concept, first_at FROM (
    SELECT task_id, term, arg_min(concept, ord * 100 + k) AS min_concept, min(ord * 100 + k) AS first_at FROM (
      SELECT *, (dense_rank() OVER (PARTITION BY task_id ORDER BY ord) - 1)::INT AS concept FROM {name}_all) GROUP BY task_id, term)
)"""


def any_of(values) -> str:
    return f"list_has_any(query, {quoted(values)})"


TASKS = f"""
projects AS (SELECT project, row_number() OVER (ORDER BY project) - 1 AS pno, count(*) OVER () AS many FROM (SELECT DISTINCT project FROM indexed_file WHERE project IS NOT NULL)),
numbered_items AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS tno FROM eval_item),
items AS (SELECT item_id AS task_id, text AS task, project FROM numbered_items JOIN projects ON tno % many = pno WHERE text IS NOT NULL),
clauses AS (SELECT task_id, CASE WHEN regexp_matches(task, '{CLAUSE}') THEN regexp_extract(task, '(?s)^(.*?){CLAUSE[4:]}', 1) ELSE task END AS clause FROM items),
{terms_of('terms', 'items', 'task')},
{terms_of('clause_terms', 'clauses', 'clause')},
queries AS (
  SELECT i.task_id, i.project, i.task, coalesce(q.query, []) AS query, coalesce(c.test_intent, false) AS test_intent
  FROM items i LEFT JOIN (SELECT task_id, list(term ORDER BY first_at) AS query FROM terms GROUP BY task_id) q USING (task_id)
  LEFT JOIN (SELECT task_id, bool_or(list_contains({quoted(C.TEST_WORDS)}, term)) AS test_intent FROM clause_terms GROUP BY task_id) c USING (task_id)
), tasks AS (
  SELECT *, CASE WHEN regexp_matches(task, '[çğışöüÇĞİŞÖÜ]')
      OR len(list_filter(string_split_regex(lower({fold('task')}), '[^a-z0-9]+'), lambda p: list_contains({quoted(C.TURKISH_WORDS)}, p))) >= 2 THEN 'tr' ELSE 'en' END AS lang,
    list_contains(query, 'import') AND {any_of(C.ORDER_WORDS)} AS mechanical,
    {any_of(C.SAMPLE_WORDS)} AS sample_intent, {any_of(C.RUNTIME_WORDS)} AS runtime_intent, {any_of(C.CONFIG_WORDS)} AS config_intent,
    list_filter([ 'base', {', '.join(f"CASE WHEN {any_of(v)} THEN '{k}' END" for k, v in C.CRITERIA)},
      CASE WHEN regexp_matches(lower({fold('task')}), '{C.AUTH_PATTERN}') THEN 'auth' END ], lambda c: c IS NOT NULL)[1:3] AS criteria
  FROM queries
)"""

BASE_NAME = "lower(regexp_replace(string_split({x}, '/')[-1], '^(.+)\\.[^.]*$', '\\1'))"


def base_name(x: str) -> str:
    return BASE_NAME.format(x=x)


def static_prior(x: str, test: str) -> str:
    rules = [
        ("(^|/)src/", "1.5"),
        ("(^|/)(lib|app|packages)/", "0.8"),
        ("(^|/)(test|tests|__tests__|spec|specs)/", f"(CASE WHEN {test} THEN 1.2 ELSE -2.5 END)"),
        ("\\.(test|spec)\\.(t|j)sx?$", f"(CASE WHEN {test} THEN 1.2 ELSE -2.5 END)"),
        ("(^|/)(examples?|fixtures?|demo|benchmarks?)/", "-2.0"),
        ("(^|/)[^/]*_(test|spec)\\.[^.]+$", "-2.5"),
        ("(^|/)(dist|build|out|target)([-_.][^/]*)?/", "-5.0"),
    ]
    return "(" + " + ".join(f"CASE WHEN regexp_matches(lower({x}), '{p}') THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for p, v in rules) + ")"


WEIGHT = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in C.FIELD_WEIGHTS.items()) + " END"

SCORES = f"""
asked_terms AS (SELECT t.*, k.project FROM terms t JOIN items k USING (task_id)
), term_scores AS (
  SELECT t.task_id, p.sym_id, p.file_id, p.project, p.field, t.term, t.concept,
    ln(1 + (s.n - coalesce(d.df, 0) + 0.5) / (coalesce(d.df, 0) + 0.5)) * {C.K1 + 1}
      / (1 + {C.K1} * (1 - {C.B} + {C.B} * p.doc_len / greatest(s.avgdl, 1.0))) * {WEIGHT} AS score
  FROM postings p JOIN asked_terms t ON t.project = p.project AND t.term = p.term JOIN stats s ON s.project = p.project LEFT JOIN doc_freq d ON d.project = p.project AND d.term = p.term
), bm25 AS (
  SELECT task_id, sym_id, file_id, sum(score) AS bm25, count(DISTINCT concept) AS concepts, count(*) FILTER (WHERE field = 'path') AS path_hits
  FROM term_scores GROUP BY ALL
), exact AS (
  SELECT t.task_id, s.sym_id, s.file_id, sum(CASE WHEN lower(s.symbol) = t.term THEN 8.0 WHEN length(t.term) >= 3 THEN 2.5 ELSE 0.0 END)::DOUBLE AS exact
  FROM symbols s JOIN asked_terms t ON t.project = s.project AND contains(lower(s.symbol), t.term) GROUP BY ALL HAVING exact > 0
), bases AS (
  SELECT t.task_id, b.base, sum(CASE WHEN b.base = t.term THEN 10.0 ELSE 2.0 END)::DOUBLE AS base_bonus
  FROM (SELECT DISTINCT project, {base_name('file')} AS base FROM symbols) b JOIN asked_terms t ON t.project = b.project AND contains(b.base, t.term) GROUP BY ALL
), hits AS (
  SELECT task_id, sym_id, file_id, coalesce(bm25, 0.0) + coalesce(exact, 0.0) AS lexical, coalesce(concepts, 0) AS concepts, coalesce(path_hits, 0) AS path_hits
  FROM bm25 FULL OUTER JOIN exact USING (task_id, sym_id, file_id)
), totals AS (
  SELECT h.task_id, h.sym_id, h.file_id, h.lexical, s.file, k.test_intent,
    h.lexical + 5.0 * least(8, h.concepts) + {static_prior('s.file', 'k.test_intent')}
    + CASE WHEN NOT k.sample_intent AND regexp_matches(lower(s.file), '(^|/)[^/]*(benchmark|measurement|smoke|fixture|demo|example)[^/]*\\.[^.]+$') THEN -36.0 ELSE 0.0 END
    + CASE WHEN k.runtime_intent AND regexp_matches(lower(s.file), '(^|/)(spec\\.types\\.\\d|corpus/|schema-twins/)') THEN -24.0 ELSE 0.0 END
    + CASE WHEN k.config_intent AND regexp_matches(s.file, '{CONFIG_NAME}') THEN 24.0 ELSE 0.0 END
    + coalesce(b.base_bonus, 0.0) + 2.0 * h.path_hits
    + CASE WHEN s.kind IN ('function', 'method', 'class') THEN 0.4 WHEN s.kind IN ('interface', 'type') THEN 0.2 ELSE 0.0 END AS total
  FROM hits h JOIN symbols s USING (sym_id) JOIN tasks k USING (task_id) LEFT JOIN bases b ON b.task_id = h.task_id AND b.base = {base_name('s.file')}
  WHERE h.lexical > 0
), scores AS (
  SELECT task_id, sym_id, file_id, lexical, round(CASE WHEN {is_test_path('file')} AND NOT test_intent THEN total * 0.75 ELSE total END, 6)::DOUBLE AS score FROM totals
)"""

RANKED = """
unique_scores AS (
  SELECT c.task_id, c.sym_id, c.file_id, c.score, s.project, s.file, s.symbol, s.kind, s.start
  FROM scores c JOIN symbols s USING (sym_id) WHERE c.score > 0.5
  QUALIFY row_number() OVER (PARTITION BY c.task_id, s.project, s.file, s.symbol ORDER BY c.score DESC, s.file, s.start, c.sym_id) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, file, start, sym_id) AS pos FROM unique_scores
  QUALIFY pos <= 20
)"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select

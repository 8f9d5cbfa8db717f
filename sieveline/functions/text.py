"""Text functions as native column expressions: folding, tokens, intents, estimates, hashes.

Null text gives null (or false for predicates); empty text gives an empty list or an estimate of 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import constants as C


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fold(text: Column) -> Column:
    """Letters without diacritics; combining marks are dropped. Case stays."""
    plain = F.regexp_replace(text, "[̀-ͯ]", "")
    return F.translate(plain, C.FOLD_FROM, C.FOLD_TO)


def _humps(text: Column) -> Column:
    """A blank at each hump of a camel-case name."""
    once = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(once, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def tokenize(text: Column) -> Column:
    """Distinct index tokens in order: no stopwords, at least two characters."""
    plain = F.lower(F.regexp_replace(_humps(fold(text)), "[_$/.-]+", " "))
    stop = words(C.STOPWORDS)
    kept = F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))
    return F.array_distinct(kept)


def task_words(text: Column) -> Column:
    """Distinct words of a task in order; identifiers keep ``_`` and ``$``."""
    plain = F.lower(_humps(fold(text)))
    stop = words(C.TASK_STOPWORDS)
    kept = F.filter(F.split(plain, "[^a-z0-9_$]+"), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))
    return F.array_distinct(kept)


def expansions(word: Column) -> Column:
    """What a task word stands for besides itself: exact words, then prefixes, then stems; else an empty list."""
    branch = None

    def when(test: Column, text: str):
        nonlocal branch
        value = words(text.split())
        branch = F.when(test, value) if branch is None else branch.when(test, value)

    for key, text in C.SYNONYMS.items():
        when(word == key, text)
    for key, text in C.SYNONYM_PREFIXES:
        when(word.startswith(key), text)
    collision = word.isin(C.STEM_COLLISIONS)
    for key, text in C.STEMS:
        when((word == key) if len(key) < C.SHORTEST_PREFIX_STEM else (word.startswith(key) & ~collision), text)
    return branch.otherwise(F.array().cast("array<string>"))


def query_terms(text: Column) -> Column:
    """array<struct<term, concept>>: words and expansions; a term belongs to the first word that brought it.

    A word that an earlier word already brought starts no concept of its own.
    """
    term = "array<struct<term:string,concept:int>>"

    def step(seen: Column, word: Column) -> Column:
        concept = F.size(F.array_distinct(F.transform(seen, lambda s: s["concept"]))).cast("int")
        known = F.transform(seen, lambda s: s["term"])
        added = F.array_distinct(F.concat(F.array(word), expansions(word)))
        fresh = F.filter(added, lambda t: ~F.array_contains(known, t))
        rows = F.transform(fresh, lambda t: F.struct(t.alias("term"), concept.alias("concept")))
        return F.when(F.array_contains(known, word), seen).otherwise(F.concat(seen, rows))

    return F.aggregate(task_words(text), F.array().cast(term), step)


CLAUSE_MARKER = (
    r"(?i)(?<![\w])(ba[sş]ar[iı]\s+kriter|kabul\s+kriter|success\s+criteri|acceptance\s+criteri|definition\s+of\s+done|done\s+when)"
)


def task_clause(text: Column) -> Column:
    """The part of a task before its success criteria."""
    return F.element_at(F.split(text, CLAUSE_MARKER, 2), 1)


def task_language(text: Column) -> Column:
    """'tr' for a Turkish diacritic or two Turkish function words, else 'en'."""
    parts = F.split(F.lower(fold(text)), "[^a-z0-9]+")
    hits = F.size(F.filter(parts, lambda p: F.array_contains(words(C.TURKISH_WORDS), p)))
    return F.when(text.rlike("[çğışöüÇĞİŞÖÜ]") | (hits >= 2), "tr").otherwise("en")


def has_any(terms: Column, values) -> Column:
    return F.arrays_overlap(terms, words(values))


def is_mechanical(terms: Column) -> Column:
    """A narrow task about import order."""
    return F.array_contains(terms, "import") & has_any(terms, C.ORDER_WORDS)


def criteria(text: Column, terms: Column) -> Column:
    """Names of the quality criteria of a task: the base and the first two that apply."""
    rules = [F.lit("base"), *[F.when(has_any(terms, values), name) for name, values in C.CRITERIA]]
    rules.append(F.when(F.lower(fold(text)).rlike(C.AUTH_PATTERN), "auth"))
    return F.slice(F.array_compact(F.array(*rules)), 1, 3)


def is_test_path(path: Column) -> Column:
    lower = F.lower(path)
    return lower.rlike(r"(^|/)(test|tests|__tests__|spec|specs)/") | lower.rlike(r"\.(test|spec)\.(t|j)sx?$")


CONFIG_NAME = (
    r"(^|/)(package\.json|(ts|js)config(\.[^./]+)?\.json|[a-z0-9_-]+\.config\.(ts|mts|cts|js|mjs|cjs)|\.eslintrc(\.(json|js|cjs|yaml|yml))?)$"
)


def is_source_path(path: Column) -> Column:
    """A file that is indexed: a source extension or a configuration name."""
    return path.rlike(rf"\.({'|'.join(C.SOURCE_EXTENSIONS)})$") | path.rlike(CONFIG_NAME)


def in_skipped_directory(path: Column) -> Column:
    """Some directory of the path is a build, cache or dependency directory."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    skipped = words(C.SKIPPED_DIRECTORIES)
    return F.exists(folders, lambda d: F.array_contains(skipped, d) | d.rlike(r"^(dist|build|out|target)[-_.]"))


def is_bundle(text: Column, size: int = 20_000, mean_line: int = 400, window: int = 65_536) -> Column:
    """A large file with very long lines at its head or in its middle."""
    middle = F.substring(text, F.greatest(F.lit(1), F.floor(F.length(text) / 2) - F.lit(window // 2)).cast("int"), F.lit(window))
    head = F.substring(text, 1, window)

    def mean(piece: Column) -> Column:
        return F.length(piece) / (F.regexp_count(piece, F.lit("\n")) + 1)

    return (F.octet_length(text) >= size) & ((mean(head) > mean_line) | (mean(middle) > mean_line))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a 0-based character position."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), at), "[^\n]", "")) + 1


def match_line_endings(value: Column, target: Column) -> Column:
    """The value with the line ends that prevail in the target; unchanged if the target has none."""
    crlf = F.regexp_count(target, F.lit("\r\n"))
    bare = F.regexp_count(target, F.lit("\n")) - crlf
    plain = F.replace(value, F.lit("\r\n"), F.lit("\n"))
    return (
        F.when((crlf == 0) & (bare == 0), value).when(crlf > bare, F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)
    )


def name_tail(name: Column) -> Column:
    """``b`` of ``A.b`` or ``A#b``."""
    return F.element_at(F.split(name, "[.#]"), -1)


def static_path_prior(path: Column, test_intent: Column) -> Column:
    """The part of the path prior that needs no task words but the test intent."""
    lower = F.lower(path)
    test = F.when(test_intent, 1.2).otherwise(-2.5)
    rules = [
        F.when(lower.rlike(r"(^|/)src/"), 1.5),
        F.when(lower.rlike(r"(^|/)(lib|app|packages)/"), 0.8),
        F.when(lower.rlike(r"(^|/)(test|tests|__tests__|spec|specs)/"), test),
        F.when(lower.rlike(r"\.(test|spec)\.(t|j)sx?$"), test),
        F.when(lower.rlike(r"(^|/)(examples?|fixtures?|demo|benchmarks?)/"), -2.0),
        F.when(lower.rlike(r"(^|/)[^/]*_(test|spec)\.[^.]+$"), -2.5),
        F.when(lower.rlike(r"(^|/)(dist|build|out|target)([-_.][^/]*)?/"), -5.0),
    ]
    return reduce(lambda a, b: a + b, [r.otherwise(0.0) for r in rules])


def intent_path_prior(path: Column, sample: Column, runtime: Column, config: Column) -> Column:
    """The part of the path prior that depends on what the task asks for."""
    lower = F.lower(path)
    return (
        F.when(~sample & lower.rlike(r"(^|/)[^/]*(benchmark|measurement|smoke|fixture|demo|example)[^/]*\.[^.]+$"), -36.0).otherwise(0.0)
        + F.when(runtime & lower.rlike(r"(^|/)(spec\.types\.\d|corpus/|schema-twins/)"), -24.0).otherwise(0.0)
        + F.when(config & path.rlike(CONFIG_NAME), 24.0).otherwise(0.0)
    )


def base_name(path: Column) -> Column:
    """Lower-case file name without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"))

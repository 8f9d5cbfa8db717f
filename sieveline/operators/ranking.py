"""Ranking symbols for many tasks in one plan: fielded BM25, bonuses, priors, promotion, confidence.

Every task is asked in one project, whose statistics count. What a term adds to a symbol does not depend on the
task: index tokens meet the query terms of their project first, and the narrow weights that are left are joined
with the tasks and added up, so nothing is done for symbols or terms that no task asks for. Priors follow the
sums. Tasks are broadcast in blocks of TASK_BLOCK. Ties end in ``sym_id``, so results do not depend on the
partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions import constants as C
from sieveline.functions import text as X

MIN_SCORE, KEPT, PROMOTION_RATIO = 0.5, 20, 0.75
#: Tasks of one block; with tasks of at most 20,000 characters it bounds what is broadcast.
TASK_BLOCK = 1_000


def tasks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """task_id, project, task, lang, terms (array of structs), query (array), and the intents of each task.

    ``items`` names the project that each task is asked in, see ``dealt`` for items that do not.
    """
    terms = X.query_terms(F.col("task"))
    clause_terms = F.transform(X.query_terms(X.task_clause(F.col("task"))), lambda t: t["term"])
    query = F.col("query")
    return (
        items.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("task_id"), "project", F.col(text_col).alias("task"))
        .withColumn("terms", terms)
        .withColumn("query", F.transform("terms", lambda t: t["term"]))
        .withColumn("lang", X.task_language(F.col("task")))
        .withColumn("test_intent", X.has_any(clause_terms, C.TEST_WORDS))
        .withColumn("mechanical", X.is_mechanical(query))
        .withColumn("criteria", X.criteria(F.col("task"), query))
        .withColumn("sample_intent", X.has_any(query, C.SAMPLE_WORDS))
        .withColumn("runtime_intent", X.has_any(query, C.RUNTIME_WORDS))
        .withColumn("config_intent", X.has_any(query, C.CONFIG_WORDS))
    )


def dealt(items: DataFrame, id_col: str, projects: DataFrame) -> DataFrame:
    """``items`` with a project each: items in the order of their id are dealt out to the projects in the order of their name."""
    listed = projects.select("project").where("project is not null").distinct()
    numbered = listed.select("project", (F.row_number().over(W.orderBy("project")) - 1).alias("_at"))
    many = F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_many")
    turns = items.withColumn("_n", F.row_number().over(W.orderBy(id_col)) - 1).crossJoin(F.broadcast(listed.agg(many)))
    return turns.withColumn("_at", (F.col("_n") % F.col("_many")).cast("int")).join(numbered, "_at").drop("_at", "_n", "_many")


def task_terms(found: DataFrame) -> DataFrame:
    """(task_id, project, term, concept), one row per query term."""
    return found.select("task_id", "project", F.explode("terms").alias("t")).select("task_id", "project", "t.term", "t.concept")


def contained_terms(names: DataFrame, name_col: str, terms: DataFrame) -> DataFrame:
    """(name, hits): the query terms that equal a lower-case name or occur in it, joined on the name's substrings.

    Only substrings of lengths that some term has are made, once per distinct name.
    """
    lengths = terms.select(F.length("term").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))
    distinct = names.select(F.col(name_col).alias("name")).distinct()
    spans = F.flatten(
        F.transform(
            F.filter("lengths", lambda n: n <= F.length("name")),
            lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, n)),
        )
    )
    pieces = distinct.crossJoin(F.broadcast(lengths)).select("name", F.explode(F.array_distinct(spans)).alias("term"))
    return pieces.join(terms.select("term").distinct(), "term").groupBy("name").agg(F.collect_list("term").alias("hits"))


def prepared(symbols: DataFrame) -> DataFrame:
    """sym_id, group_id, start and the priors of every symbol; ``group_id`` stands for the distinct (project, file, symbol)."""
    twins = W.partitionBy("project", "file", "symbol")
    path = F.col("file")
    kind = F.when(F.col("kind").isin("function", "method", "class"), 0.4).when(F.col("kind").isin("interface", "type"), 0.2).otherwise(0.0)
    return symbols.select(
        "sym_id", F.min("sym_id").over(twins).alias("group_id"), "start", kind.alias("kind_boost"),
        X.static_path_prior(path, F.lit(True)).alias("prior_test"),
        X.static_path_prior(path, F.lit(False)).alias("prior_plain"),
        X.intent_path_prior(path, F.lit(False), F.lit(False), F.lit(False)).alias("sample_prior"),
        X.intent_path_prior(path, F.lit(True), F.lit(True), F.lit(False)).alias("runtime_prior"),
        X.intent_path_prior(path, F.lit(True), F.lit(False), F.lit(True)).alias("config_prior"),
        X.is_test_path(path).alias("is_test"),
    )


def term_weights(symbols: DataFrame, tokens: DataFrame, df: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(sym_id, project, term, bm25, in_path, exact, base): what each query term of a project adds to each symbol that has it.

    bm25 is the weighted sum over the fields; exact and base are the bonuses of a symbol's and a file's name
    that equal or contain the term.
    """
    wanted = terms.select("project", "term").distinct()
    stat = stats.select("project", "avgdl")
    sized = tokens.join(stat, "project")

    def gain(field: str) -> F.Column:
        length = F.size(field) / F.greatest(F.col("avgdl"), F.lit(1.0))
        return (C.K1 + 1) / (1 + C.K1 * (1 - C.B + C.B * length)) * C.FIELD_WEIGHTS[field]

    def postings(field: str) -> F.Column:
        return F.transform(field, lambda t: F.struct(t.alias("term"), gain(field).alias("gain"), F.lit(field == "path").alias("in_path")))

    each = [postings(field) for field in C.FIELD_WEIGHTS]
    posted = sized.select("sym_id", "project", F.explode(F.concat(*each)).alias("p")).select("sym_id", "project", "p.*")
    idf = df.join(stats.select("project", "n"), "project").select("project", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = wanted.join(idf, ["project", "term"], "left").join(stats.select("project", "n"), "project")
    asked = asked.select("project", "term", F.coalesce("idf", F.log(1 + (F.col("n") + 0.5) / 0.5)).alias("idf"))
    indexed = posted.join(F.broadcast(asked), ["project", "term"]).select(
        "sym_id", "project", "term", (F.col("gain") * F.col("idf")).alias("bm25"), F.col("in_path").cast("int").alias("in_path"), F.lit(0.0).alias("exact"), F.lit(0.0).alias("base")
    )
    named = symbols.select("sym_id", "project", F.lower("symbol").alias("name"), X.base_name(F.col("file")).alias("base_name"))
    zero = [F.lit(0.0).alias("bm25"), F.lit(0).alias("in_path")]
    value = F.when(F.col("name") == F.col("term"), 8.0).when(F.length("term") >= 3, 2.5).otherwise(0.0)
    hits = contained_terms(named, "name", terms).select("name", F.explode("hits").alias("term"))
    exact = named.join(hits, "name").select("sym_id", "project", "term", *zero, value.alias("exact"), F.lit(0.0).alias("base"))
    value = F.when(F.col("base_name") == F.col("term"), 10.0).otherwise(2.0)
    hits = contained_terms(named, "base_name", terms).select(F.col("name").alias("base_name"), F.explode("hits").alias("term"))
    base = named.join(hits, "base_name").select("sym_id", "project", "term", *zero, F.lit(0.0).alias("exact"), value.alias("base"))
    return indexed.unionByName(exact).unionByName(base)


def _block_scores(found: DataFrame, symbols: DataFrame, tokens: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    terms = task_terms(found)
    most = found.select(F.max(F.array_max(F.transform("terms", lambda t: t["concept"])))).first()[0] or 0
    weights = term_weights(symbols, tokens, df, stats, terms)
    indexed = F.col("bm25") > 0
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("concept"), F.lit(62)).cast("int"))
    masks = [
        F.bit_or(F.when(indexed & (F.floor(F.col("concept") / 62) == w), bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}")
        for w in range(most // 62 + 1)
    ]
    summed = (
        weights.repartition("sym_id")
        .join(F.broadcast(terms), ["project", "term"])
        .groupBy("task_id", "sym_id")
        .agg(F.sum("bm25").alias("bm25"), F.sum("exact").alias("exact"), F.sum("base").alias("base_bonus"), F.sum("in_path").alias("path_hits"), *masks)
    )
    concepts = sum((F.bit_count(f"m{w}") for w in range(most // 62 + 1)), F.lit(0))
    hits = summed.withColumn("concepts", concepts).withColumn("lexical", F.col("bm25") + F.col("exact")).where("lexical > 0")
    intents = found.select("task_id", "test_intent", "sample_intent", "runtime_intent", "config_intent")
    prior = (
        F.when(F.col("test_intent"), F.col("prior_test")).otherwise(F.col("prior_plain"))
        + F.when(~F.col("sample_intent"), F.col("sample_prior")).otherwise(0.0)
        + F.when(F.col("runtime_intent"), F.col("runtime_prior")).otherwise(0.0)
        + F.when(F.col("config_intent"), F.col("config_prior")).otherwise(0.0)
        + F.col("base_bonus")
        + 2.0 * F.col("path_hits")
    )
    total = F.col("lexical") + 5.0 * F.least(F.lit(8), F.col("concepts")) + prior + F.col("kind_boost")
    demoted = F.col("is_test") & ~F.col("test_intent")
    score = F.round(F.when(demoted, total * 0.75).otherwise(total), 6)
    return (
        hits.join(prepared(symbols), "sym_id")
        .join(F.broadcast(intents), "task_id")
        .select("task_id", "group_id", "sym_id", "start", "bm25", "concepts", "path_hits", "lexical", score.alias("score"))
    )


def scores(found: DataFrame, symbols: DataFrame, tokens: DataFrame, df: DataFrame, stats: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(task_id, group_id, sym_id, start, bm25, concepts, path_hits, lexical, score) of every lexical match in the task's project.

    ``only`` (sym_id) restricts the symbols; twins are those among them. Tasks are a query set: more than TASK_BLOCK
    of them are worked off in blocks, each broadcast by itself.
    """
    if only is not None:
        some = only.select("sym_id").distinct()
        symbols, tokens = symbols.join(some, "sym_id", "left_semi"), tokens.join(some, "sym_id", "left_semi")
    many = found.count()
    if many <= TASK_BLOCK:
        return _block_scores(found, symbols, tokens, df, stats)
    numbered = found.withColumn("_block", F.floor((F.row_number().over(W.orderBy("task_id")) - 1) / TASK_BLOCK))
    blocks = [numbered.where(F.col("_block") == b).drop("_block") for b in range((many + TASK_BLOCK - 1) // TASK_BLOCK)]
    return reduce(DataFrame.unionByName, [_block_scores(block, symbols, tokens, df, stats) for block in blocks])


def rank(scored: DataFrame, symbols: DataFrame, kept: int = KEPT) -> DataFrame:
    """The best ``kept`` distinct (file, symbol) of each task in its project, as ``pos`` from 1.

    Twins are settled where they are. Then every partition passes on its own best ``kept`` of each task
    (with ties), and only those few meet the names that order ties.
    """
    narrow = scored.where(F.col("score") > MIN_SCORE).select("task_id", "group_id", "sym_id", "start", "score")
    first = F.row_number().over(W.partitionBy("group_id", "task_id").orderBy(F.col("score").desc(), "start", "sym_id"))
    unique = narrow.withColumn("_same", first).where("_same = 1")
    near = F.rank().over(W.partitionBy("task_id").orderBy(F.col("score").desc()))
    best = unique.withColumn("_near", near).where(F.col("_near") <= kept).select("task_id", "sym_id", "score")
    full = best.join(symbols.select("sym_id", "file_id", "project", "file", "symbol", "kind", "start"), "sym_id")
    pos = F.row_number().over(W.partitionBy("task_id").orderBy(F.col("score").desc(), "file", "start", "sym_id"))
    return full.withColumn("pos", pos).where(F.col("pos") <= kept)


def promote(ranked: DataFrame, found: DataFrame, imports: DataFrame) -> DataFrame:
    """Moves the best non-test file that a leading test imports to the front; adds the new ``pos``.

    Only without test intent, and only from three quarters of the leader's score on.
    """
    top = (
        ranked.where("pos = 1")
        .where(X.is_test_path(F.col("file")))
        .join(found.where("not test_intent").select("task_id"), "task_id", "left_semi")
        .select("task_id", F.col("project"), F.col("file").alias("src"), F.col("score").alias("top_score"))
    )
    subjects = top.join(imports, ["project", "src"]).select("task_id", "project", F.col("dst").alias("file"), "top_score")
    chosen = (
        ranked.where("pos > 1")
        .where(~X.is_test_path(F.col("file")))
        .join(subjects, ["task_id", "project", "file"])
        .groupBy("task_id")
        .agg(F.min(F.struct("pos", "score", "top_score")).alias("first"))
        .where(F.col("first.score") >= PROMOTION_RATIO * F.col("first.top_score"))
        .select("task_id", F.col("first.pos").alias("_from"))
    )
    moved = F.when(F.col("pos") == F.col("_from"), 1).when(F.col("pos") < F.col("_from"), F.col("pos") + 1).otherwise(F.col("pos"))
    return ranked.join(F.broadcast(chosen), "task_id", "left").withColumn("pos", moved.cast("int")).drop("_from")


def confidence(ranked: DataFrame, found: DataFrame, tokens: DataFrame, truncated: bool = False) -> DataFrame:
    """task_id, n_direct, top, margin, coverage, confidence, reasons over the best eight of each task."""
    direct = ranked.where("pos <= 8").join(tokens.select("sym_id", "name", "path"), "sym_id")
    near = F.when(F.col("pos") <= 5, F.concat("name", "path")).otherwise(F.array().cast("array<string>"))
    seen = direct.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_direct"),
        F.max(F.when(F.col("pos") == 1, F.col("score"))).alias("top"),
        F.max(F.when(F.col("pos") == 2, F.col("score"))).alias("second"),
        F.array_distinct(F.flatten(F.collect_list(near))).alias("covered"),
        F.collect_list(F.lower(F.concat_ws(" ", "symbol", "file"))).alias("texts"),
    )
    all_tasks = found.select("task_id", "query").join(seen, "task_id", "left")
    hit = F.filter(
        "query", lambda q: F.array_contains("covered", q) | F.exists("texts", lambda t: t.contains(q))
    )
    coverage = F.when(F.size("query") == 0, 0.0).otherwise(F.size(hit) / F.size("query"))
    margin = F.col("top") - F.coalesce("second", F.lit(0.0))
    some = F.col("n_direct").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(~some, "no_match"),
            F.when(some & (F.col("coverage") < 0.35), "low_coverage"),
            F.when(some & (F.col("top") < 3), "weak_top"),
            F.when(some & (F.col("margin") < 0.75) & (F.col("n_direct") > 3), "ambiguous"),
            F.when(F.lit(truncated), "truncated_index"),
        )
    )
    raw = (
        0.42
        + 0.28 * F.least(F.lit(1.0), F.col("coverage"))
        + 0.16 * F.least(F.lit(1.0), F.col("top") / 12)
        + 0.08 * F.least(F.lit(1.0), F.col("margin") / 4)
        + 0.04 * F.least(F.col("n_direct"), F.lit(4))
    )
    clamped = F.greatest(F.lit(0.3), F.least(F.lit(0.95), raw))
    own = F.size(F.filter("reasons", lambda r: r != "truncated_index"))
    capped = F.when(own >= 2, F.least(clamped, F.lit(0.68))).otherwise(clamped)
    value = F.when(F.col("n_direct").isNull(), 0.28).otherwise(capped)
    if truncated:
        value = F.least(value, F.lit(0.68))
    return (
        all_tasks.withColumn("coverage", F.when(some, F.round(coverage, 6)))
        .withColumn("margin", F.when(some, F.round(margin, 6)))
        .withColumn("reasons", reasons)
        .select("task_id", F.coalesce("n_direct", F.lit(0)).alias("n_direct"), "top", "margin", "coverage", F.round(value, 6).alias("confidence"), "reasons")
    )

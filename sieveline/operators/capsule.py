"""Neighbours one hop away, and token-bounded capsules: which symbols a task gets, trimmed to a budget.

Everything is one row per task with arrays that the level bounds (8 direct symbols, 3 neighbours), so a
capsule never grows with the corpus. Budgets count a quarter of the characters of the JSON payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions import constants as C

LOW_CONFIDENCE = 0.72


def levels(judged: DataFrame, found: DataFrame, requested: int = 1, handoff: bool = False) -> DataFrame:
    """task_id, level, direct, neighbours, tokens: 0 for mechanical tasks, 3 on low confidence or handoff."""
    low = F.col("confidence") < LOW_CONFIDENCE
    level = F.when(F.col("mechanical"), 0).when(low | F.lit(handoff), 3).otherwise(requested)
    chosen = judged.join(found.select("task_id", "mechanical"), "task_id").withColumn("level", level)
    spark = judged.sparkSession
    budget = spark.createDataFrame(list(C.LEVELS), "level int, direct int, neighbours int, tokens int")
    return chosen.join(F.broadcast(budget), "level").select("task_id", "level", "direct", "neighbours", "tokens", "confidence", "reasons")


def direct_symbols(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """The leading symbols of each task that its level allows."""
    return ranked.join(F.broadcast(chosen.select("task_id", "direct")), "task_id").where("pos <= direct").drop("direct")


def type_dependencies(direct: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, sym_id): declared types whose name is a whole word of a direct symbol's text.

    The words of the direct texts are joined with the names, instead of testing every name on every text.
    """
    words = direct.join(symbols.select("sym_id", "source_text"), "sym_id").select(
        "task_id", "project", F.explode(F.array_distinct(F.split("source_text", r"[^A-Za-z0-9_$]+"))).alias("symbol")
    )
    types = symbols.where(F.col("kind").isin("interface", "type", "enum", "class")).select("project", "symbol", "sym_id")
    return words.where("symbol <> ''").distinct().join(types, ["project", "symbol"]).select("task_id", "sym_id").distinct()


def neighbours(
    direct: DataFrame, chosen: DataFrame, symbols: DataFrame, scored: DataFrame, edges: DataFrame, callees: DataFrame
) -> DataFrame:
    """The best symbols one hop from the direct ones: task_id, rank, sym_id, relation, score."""
    place = symbols.select("sym_id", "project", "file", "symbol")
    files = direct.select("task_id", "project", F.col("file").alias("src")).distinct()
    called = (
        files.join(callees.select("project", F.col("file").alias("src"), F.col("name").alias("symbol")), ["project", "src"])
        .select("task_id", "symbol")
        .distinct()
        .withColumn("called", F.lit(True))
    )
    near = (
        files.join(edges.select("project", "src", "dst"), ["project", "src"])
        .select("task_id", "project", F.col("dst").alias("file"))
        .distinct()
        .join(place, ["project", "file"])
        .join(scored.select("task_id", "sym_id", "score"), ["task_id", "sym_id"], "left")
        .join(called, ["task_id", "symbol"], "left")
    )
    callee = F.coalesce("called", F.lit(False))
    worth = F.coalesce("score", F.lit(0.0)) + F.when(callee, 3.0).otherwise(0.0) + 0.4
    by_edge = near.select(
        "task_id", "sym_id", "file", "symbol", F.round(worth, 6).alias("score"), F.when(callee, "callee").otherwise("imported").alias("relation"), callee.alias("_kept")
    ).where("score > 0.3 or _kept")
    by_type = type_dependencies(direct, symbols).join(place, "sym_id").select(
        "task_id", "sym_id", "file", "symbol", F.lit(5.0).alias("score"), F.lit("type_dependency").alias("relation"), F.lit(True).alias("_kept")
    )
    taken = direct.select("task_id", "file", "symbol").distinct()
    every = by_type.unionByName(by_edge).join(taken, ["task_id", "file", "symbol"], "left_anti")
    order = [F.col("score").desc(), F.when(F.col("relation") == "type_dependency", 0).otherwise(1), "sym_id"]
    same = F.row_number().over(W.partitionBy("task_id", "file", "symbol").orderBy(*order))
    unique = every.withColumn("_same", same).where("_same = 1")
    ranked = unique.withColumn("rank", F.row_number().over(W.partitionBy("task_id").orderBy(*order)))
    return (
        ranked.join(F.broadcast(chosen.select("task_id", "neighbours")), "task_id")
        .where("rank <= neighbours")
        .select("task_id", "rank", "sym_id", "file", "symbol", "relation", "score")
    )


def references(direct: DataFrame, near: DataFrame, symbols: DataFrame) -> DataFrame:
    """All chosen symbols of each task in order, with hop, relation and the score relative to the best."""
    kinds = symbols.select("sym_id", "kind")
    first = direct.select("task_id", F.col("pos").alias("ord"), "sym_id", "symbol", "file", F.lit(0).alias("hop"), F.lit("direct_match").alias("relation"), "score")
    second = near.select("task_id", (F.col("rank") + 100).alias("ord"), "sym_id", "symbol", "file", F.lit(1).alias("hop"), "relation", "score")
    best = F.greatest(F.lit(0.0), F.max("score").over(W.partitionBy("task_id")))
    share = F.when(best > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / best))).otherwise(0.0)
    return first.unionByName(second).join(kinds, "sym_id").withColumn("score", F.round(share, 6))


REF = "array<struct<symbol:string,file:string,kind:string,hop:int,relation:string,score:double>>"


def payload_size(goal, refs, decisions, criteria):
    """Characters of the JSON payload."""
    files = F.slice(F.array_distinct(F.transform(refs, lambda r: r["file"])), 1, 12)
    payload = F.struct(
        goal.alias("goal"), refs.alias("symbols"), files.alias("files"), decisions.alias("decisions"), criteria.alias("criteria")
    )
    return F.length(F.to_json(payload))


def largest(upper, fits):
    """The largest k in 1..upper that fits, else 1; sizes only fall with k, so no search order matters."""
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(upper, F.lit(1))), fits)), F.lit(1))


def pack(found: DataFrame, chosen: DataFrame, refs: DataFrame) -> DataFrame:
    """One capsule per task: kept symbols, files, decisions, criteria, estimated tokens and whether it still overflows.

    What goes first when the budget is short: the tail of long test titles, the note on the method, extra
    criteria, and only then symbols. Goal, one symbol and one criterion always stay.
    """
    listed = refs.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ord", "symbol", "file", "kind", "hop", "relation", "score"))).alias("_refs"))
    plain = F.transform(
        F.slice("_refs", 1, 16),
        lambda r: F.struct(r["symbol"].alias("symbol"), r["file"].alias("file"), r["kind"].alias("kind"), r["hop"].alias("hop"), r["relation"].alias("relation"), r["score"].alias("score")),
    )
    base = (
        found.join(chosen, "task_id")
        .join(listed, "task_id", "left")
        .withColumn("goal", F.substring("task", 1, 240))
        .withColumn("symbols", F.coalesce(plain.cast(REF), F.array().cast(REF)))
        .withColumn("criteria", F.concat(F.array(F.substring("task", 1, 180)), "criteria"))
        .withColumn("decisions", F.array(F.lit("method"), F.when(F.col("mechanical"), "single file").otherwise("widen on evidence"), F.lit("one package")))
        .withColumn("limit", F.col("tokens") * 4)
    )
    shorter = F.transform(
        "symbols",
        lambda r: r.withField("symbol", F.when((r["kind"] == "test") & (F.length(r["symbol"]) > 96), F.concat(F.substring(r["symbol"], 1, 95), F.lit("…"))).otherwise(r["symbol"])),
    )

    def over(symbols, decisions, criteria):
        return payload_size(F.col("goal"), symbols, decisions, criteria) > F.col("limit")

    now = (F.col("symbols"), F.col("decisions"), F.col("criteria"))
    step1 = base.withColumn("symbols", F.when(over(*now), shorter).otherwise(F.col("symbols")))
    fewer = F.filter("decisions", lambda d: d != "method")
    step2 = step1.withColumn("decisions", F.when(over(*now), fewer).otherwise(F.col("decisions")))
    kept_criteria = largest(F.size("criteria"), lambda k: ~over(F.col("symbols"), F.col("decisions"), F.slice("criteria", F.lit(1), k)))
    step3 = step2.withColumn("criteria", F.slice("criteria", F.lit(1), kept_criteria))
    kept_symbols = largest(F.size("symbols"), lambda k: ~over(F.slice("symbols", F.lit(1), k), F.col("decisions"), F.col("criteria")))
    step4 = step3.withColumn("symbols", F.slice("symbols", F.lit(1), kept_symbols))
    size = payload_size(F.col("goal"), *now)
    tokens = F.greatest(F.lit(1), F.ceil(size / 4)).cast("int")
    return step4.select(
        "task_id",
        "level",
        "confidence",
        "reasons",
        "goal",
        "symbols",
        F.slice(F.array_distinct(F.transform("symbols", lambda r: r["file"])), 1, 12).alias("files"),
        "decisions",
        "criteria",
        tokens.alias("estimated_tokens"),
        (tokens > F.col("tokens")).alias("over_budget"),
    )

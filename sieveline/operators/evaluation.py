"""Evaluation runs: token totals, paired comparison, retrieval metrics; usage reports.

An unmeasured counter makes the total of a run unmeasured (null), it is never skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def total_usage(requests: Column) -> Column:
    """Tokens of all requests; null for no requests or if any counter that counts is null or negative."""
    used = F.transform(
        requests,
        lambda r: F.when(
            r["input_includes_cache"], r["input"] + r["output"]
        ).when(~r["input_includes_cache"], r["input"] + r["output"] + r["cache_read"] + r["cache_write"]),
    )
    bad = F.exists(
        requests,
        lambda r: r.isNull()
        | r["input_includes_cache"].isNull()
        | F.coalesce(r["input"] < 0, F.lit(True))
        | F.coalesce(r["output"] < 0, F.lit(True))
        | (~r["input_includes_cache"] & (F.coalesce(r["cache_read"] < 0, F.lit(True)) | F.coalesce(r["cache_write"] < 0, F.lit(True)))),
    )
    total = F.aggregate(used, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when((F.size(requests) > 0) & ~bad, total)


def latest_runs(runs: DataFrame) -> DataFrame:
    """One run per model, oracle-independent task and repetition: the last that finished (ties: the larger id)."""
    rest = [c for c in runs.columns if c not in ("task_id", "repetition", "model")]
    last = F.max_by(F.struct(*rest), F.struct("finished_at", "record_id"))
    return runs.groupBy("model", "task_id", "repetition").agg(last.alias("r")).select("model", "task_id", "repetition", "r.*")


def compare(baseline: DataFrame, candidate: DataFrame, target_tokens: int = 100_000) -> DataFrame:
    """Paired cases by task and repetition; ``paired`` is false where a side is missing."""
    key = ["task_id", "repetition"]

    def side(runs: DataFrame, name: str) -> DataFrame:
        ok = F.coalesce("passed", F.lit(False)) & F.coalesce("protected_inputs_unchanged", F.lit(False))
        return runs.select(*key, total_usage(F.col("requests")).alias(f"{name}_tokens"), ok.alias(f"{name}_ok"), F.lit(True).alias(f"{name}_there"))

    both = side(baseline, "before").join(side(candidate, "after"), key, "full_outer")
    before, after = F.col("before_tokens"), F.col("after_tokens")
    return both.select(
        *key,
        before.alias("before_tokens"),
        after.alias("after_tokens"),
        (F.coalesce("before_there", F.lit(False)) & F.coalesce("after_there", F.lit(False))).alias("paired"),
        F.coalesce("after_ok", F.lit(False)).alias("passed"),
        (F.coalesce("before_ok", F.lit(False)) & ~F.coalesce("after_ok", F.lit(False))).alias("regression"),
        F.coalesce(after <= target_tokens, F.lit(False)).alias("within_target"),
        F.when(before > 0, F.round(1 - after / before, 6)).alias("reduction"),
    )


def select_ranks(values: DataFrame, column: str, keys: list[str], ranks: dict[str, Column], buckets: int = 128) -> DataFrame:
    """The values at given ranks (from 1; expressions over ``n``, the group's size) of each group, exactly.

    Values are counted with a partial aggregation and put into buckets between approximate quantiles of the distinct
    values, so that outliers cannot fill one bucket; only the buckets that hold a wanted rank are ordered, so no
    task sorts a whole group, however large.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    bounds = F.percentile_approx("_v", [i / buckets for i in range(1, max(buckets, 2))], 20 * buckets)
    stats = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), bounds.alias("_bounds"))
    placed = counts.join(stats, keys).withColumn("_b", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")
    sums = placed.groupBy(*keys, "_b", "n").agg(F.sum("_c").alias("_bc"))
    up_to = F.sum("_bc").over(W.partitionBy(*keys).orderBy("_b"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    chosen = (
        sums.withColumn("_to", up_to)
        .withColumn("_before", F.col("_to") - F.col("_bc"))
        .withColumn("_w", wanted)
        .where("_w.rank > _before and _w.rank <= _to")
        .select(*keys, "_b", "_before", "_w.name", "_w.rank")
    )
    ordered = W.partitionBy(*keys, "_b", "name").orderBy("_v")
    inside = placed.select(*keys, "_b", "_v", "_c").join(chosen, [*keys, "_b"]).withColumn("_to", F.col("_before") + F.sum("_c").over(ordered))
    hit = inside.where((F.col("rank") <= F.col("_to")) & (F.col("rank") > F.col("_to") - F.col("_c")))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])


def comparison_summary(cases: DataFrame) -> DataFrame:
    """One row: regressions, unmeasured cases, median and p95 of the candidate's tokens, acceptance."""
    unmeasured = F.col("before_tokens").isNull() | F.col("after_tokens").isNull()
    good = F.col("paired") & F.col("passed") & F.col("within_target") & F.col("before_tokens").isNotNull()
    summary = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("regression").alias("regressions"),
        F.count_if(unmeasured).alias("unmeasured"),
        F.bool_and(good).alias("accepted"),
    )
    n = F.col("n")
    middles = {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95_tokens": F.greatest(F.lit(1), F.ceil(n * 0.95))}
    ranks = select_ranks(cases.select("after_tokens", F.lit(1).alias("g")), "after_tokens", ["g"], middles)
    both = ranks.agg(F.max((F.col("low") + F.col("high")) / 2).alias("median_tokens"), F.max("p95_tokens").alias("p95_tokens"))
    return summary.crossJoin(F.broadcast(both))


def upper_median(values: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The value at 0-based position n / 2 of the sorted values of each group."""
    return select_ranks(values, column, keys, {"upper_median": F.floor(F.col("n") / 2) + 1})


def usage_by_tool(calls: DataFrame, tool: str, duration: str, error: Column) -> DataFrame:
    """Calls, upper median duration, errors and their rate per tool."""
    counts = calls.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.count_if(error).alias("errors"))
    middle = upper_median(calls.select(tool, duration), duration, [tool])
    return counts.join(middle, tool, "left").withColumn("error_rate", F.round(F.col("errors") / F.col("calls"), 6))


def retrieval_metrics(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """answers(task_id, pos, file), truth(task_id, file): hit at 1, recall and precision as micro averages."""
    right = truth.select("task_id", "file").distinct().withColumn("right", F.lit(1))
    per_file = answers.groupBy("task_id", "file").agg(F.min("pos").alias("pos"))
    judged = per_file.join(right, ["task_id", "file"], "left").groupBy("task_id").agg(
        F.count(F.lit(1)).alias("returned"), F.count("right").alias("hits"), F.max(F.when(F.col("pos") == 1, F.col("right"))).alias("first")
    )
    wanted = truth.select("task_id", "file").distinct().groupBy("task_id").agg(F.count(F.lit(1)).alias("wanted"))
    every = wanted.join(judged, "task_id", "left")
    return every.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.round(F.count("first") / F.count(F.lit(1)), 6).alias("hit_at_1"),
        F.round(F.coalesce(F.sum("hits"), F.lit(0)) / F.sum("wanted"), 6).alias("recall"),
        F.round(F.coalesce(F.sum("hits"), F.lit(0)) / F.sum("returned"), 6).alias("precision"),
    )

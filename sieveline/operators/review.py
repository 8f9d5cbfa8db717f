"""Model answers and reviews: JSON arrays out of free text, edit records, blind reviews, diagnostics.

Everything is an expression over columns; invalid input gives null or a reason, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_EDITS = 100
OPERATIONS = ("replace_function_body", "replace_symbol", "delete_symbol", "insert_before_symbol", "insert_after_symbol")
DIMENSIONS = ("correctness", "completeness", "regression_risk", "test_quality", "maintainability")

_EDIT = "array<struct<operation:string,file:string,symbol:string,newBody:string,replacement:string,content:string>>"


def json_array(text: Column) -> Column:
    """The JSON array between the first ``[`` and the last ``]``, after think tags and code fences; else null.

    A truncated array is not repaired.
    """

    def array_in(piece: Column) -> Column:
        start = F.instr(piece, "[")
        end = F.length(piece) - F.instr(F.reverse(piece), "]") + 1
        cut = F.substring(piece, start, end - start + 1)
        usable = (start > 0) & (F.instr(piece, "]") > 0) & (end > start)
        return F.when(usable & F.try_parse_json(cut).isNotNull(), cut)

    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", " "), "</?think>", "")
    plain = F.regexp_replace(F.regexp_replace(F.trim(plain), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.coalesce(array_in(plain), array_in(text))


def edit_error(text: Column) -> Column:
    """Why a model answer is no acceptable batch of edits; null if it is one. All or nothing."""
    found = json_array(text)
    edits = F.from_json(found, _EDIT)
    bad_operation = ~F.forall(edits, lambda e: F.coalesce(e["operation"].isin(*OPERATIONS), F.lit(False)))
    no_target = ~F.forall(edits, lambda e: F.coalesce(F.length(e["file"]) > 0, F.lit(False)) & F.coalesce(F.length(e["symbol"]) > 0, F.lit(False)))
    payload = ~F.forall(
        edits,
        lambda e: F.when(e["operation"] == "replace_function_body", e["newBody"].isNotNull())
        .when(e["operation"] == "replace_symbol", e["replacement"].isNotNull())
        .when(e["operation"] == "delete_symbol", F.lit(True))
        .otherwise(e["content"].isNotNull()),
    )
    return (
        F.when(found.isNull(), "NO_ARRAY")
        .when(edits.isNull() | (F.size(edits) == 0), "EMPTY")
        .when(F.size(edits) > MOST_EDITS, "TOO_MANY")
        .when(bad_operation, "UNKNOWN_OPERATION")
        .when(no_target, "NO_TARGET")
        .when(payload, "NO_PAYLOAD")
    )


def assignment(task_id: Column, seed: str = "blind-review-v1:") -> Column:
    """'X' or 'Y' for the first solution, by the parity of the first byte of a hash."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), task_id), 256), 1, 2), 16, 10).cast("int")
    return F.when(first % 2 == 0, "X").otherwise("Y")


def anonymous_diff(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, diff): the sections of a diff in an order that only a hash of the key decides."""
    sections = F.filter(F.split(F.col(diff), r"(?m)(?=^diff --git )"), lambda s: s != "")
    ranked = F.transform(sections, lambda s: F.struct(F.sha2(F.concat(F.col(key).cast("string"), F.lit(":"), s), 256).alias("h"), s.alias("s")))
    joined = F.array_join(F.transform(F.array_sort(ranked), lambda x: x["s"]), "")
    return diffs.select(key, joined.alias(diff))


def review_total(solution: Column) -> Column:
    """Sum of the five scores; null unless each is a whole number from 1 to 5."""
    scores = [solution[d].cast("int") for d in DIMENSIONS]
    valid = F.lit(True)
    for s in scores:
        valid = valid & F.coalesce(s.between(1, 5), F.lit(False))
    return F.when(valid, sum(scores[1:], scores[0]))


def diagnostic_signature(stdout: Column) -> Column:
    """A hash of compiler errors without their positions; null if there are none."""
    line = r"(?m)^(.+?)\(\d+,\d+\): error (TS\d+): (.+)$"
    parts = [F.regexp_extract_all(stdout, F.lit(line), F.lit(i)) for i in (1, 2, 3)]
    joined = F.transform(
        F.arrays_zip(parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("c")),
        lambda d: F.concat_ws(":", F.replace(d["a"], F.lit("\\"), F.lit("/")), d["b"], F.trim(d["c"])),
    )
    return F.when(F.size(parts[0]) > 0, F.sha2(F.array_join(joined, "\n"), 256))


def dead_patterns(patterns: DataFrame, evidence: DataFrame, pattern: str = "pattern", text: str = "text") -> DataFrame:
    """Patterns that occur in no evidence text of their key. ``patterns(key, pattern)``, ``evidence(key, text)``."""
    keyed = patterns.join(evidence, "key", "left")
    hit = F.coalesce(F.regexp_like(F.col(text), F.concat(F.lit("(?i)"), F.col(pattern))), F.lit(False))
    return keyed.groupBy("key", pattern).agg(F.bool_or(hit).alias("alive")).where("not alive").select("key", pattern)


def with_semantic(direct: DataFrame, similar: DataFrame, extra: int, at: int = 3) -> DataFrame:
    """Positions of a task's references after semantic extras are put in behind the first ``at``.

    ``direct(task_id, pos, file)`` and ``similar(task_id, file, score)``; files that are direct are skipped.
    """
    from pyspark.sql import Window as W

    fresh = similar.join(direct.select("task_id", "file").distinct(), ["task_id", "file"], "left_anti")
    rank = F.row_number().over(W.partitionBy("task_id").orderBy(F.col("score").desc(), "file"))
    added = fresh.withColumn("r", rank).where(F.col("r") <= extra)
    n = direct.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    counted = added.groupBy("task_id").agg(F.max("r").alias("k"))
    moved = direct.join(counted, "task_id", "left").select(
        "task_id", "file", F.when(F.col("pos") > at, F.col("pos") + F.coalesce("k", F.lit(0))).otherwise(F.col("pos")).alias("pos"), F.lit(False).alias("semantic")
    )
    placed = added.join(n, "task_id", "left").select(
        "task_id", "file", (F.least(F.coalesce("n", F.lit(0)), F.lit(at)) + F.col("r")).alias("pos"), F.lit(True).alias("semantic")
    )
    return moved.unionByName(placed)

"""Planning edits: resolve operations to intervals, check preconditions, find overlaps, splice.

An operation is (op_id, file_id, symbol, operation, content, content_hash, symbol_hash); both hashes are preconditions
and may be null. A function's body is what stands between the brace that ends a line and the last one. A batch of one file is
applied as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions import text as X


def resolve(operations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Adds start, end, value and ``code``: null if the operation can be applied, else why not."""
    if "source_text" not in symbols.columns:
        symbols = symbols.withColumn("source_text", F.lit(None).cast("string"))
    opened = F.regexp_instr("source_text", F.lit(r"\{[ \t]*\r?\n"))
    closed = F.length("source_text") - F.instr(F.reverse("source_text"), "}")
    bodied = symbols.withColumn("_from", F.when((opened > 0) & (closed >= opened), F.col("start") + opened)).withColumn("_to", F.col("start") + closed)
    place = bodied.groupBy("file_id", "symbol").agg(
        F.count(F.lit(1)).alias("matches"), F.min("start").alias("sym_start"), F.min("end").alias("sym_end"),
        F.min("_from").alias("body_start"), F.min("_to").alias("body_end"), F.min(F.sha2("source_text", 256)).alias("symbol_hash_now"),
    )
    if "symbol_hash" not in operations.columns:
        operations = operations.withColumn("symbol_hash", F.lit(None).cast("string"))
    texts = files.select("file_id", F.col("text").alias("file_text"), F.sha2("text", 256).alias("file_hash"))
    joined = operations.join(texts, "file_id", "left").join(place, ["file_id", "symbol"], "left")
    op = F.col("operation")
    body = op == "replace_function_body"
    start = F.when(op == "insert_after_symbol", F.col("sym_end")).when(body, F.col("body_start")).otherwise(F.col("sym_start"))
    end = F.when(op == "insert_before_symbol", F.col("sym_start")).when(body, F.col("body_end")).otherwise(F.col("sym_end"))
    value = F.when(op == "delete_symbol", F.lit("")).otherwise(X.match_line_endings(F.col("content"), F.col("file_text")))
    code = (
        F.when(F.col("file_text").isNull(), "FILE_NOT_FOUND")
        .when(F.col("content_hash").isNotNull() & (F.col("content_hash") != F.col("file_hash")), "STALE_CONTENT")
        .when(F.col("matches").isNull(), "SYMBOL_NOT_FOUND")
        .when(F.col("matches") > 1, "AMBIGUOUS_SYMBOL")
        .when(F.col("symbol_hash").isNotNull() & (F.col("symbol_hash") != F.col("symbol_hash_now")), "STALE_SYMBOL")
        .when(body & F.col("body_start").isNull(), "NO_BODY")
        .when(~op.isin("replace_symbol", "replace_function_body", "delete_symbol", "insert_before_symbol", "insert_after_symbol"), "UNSUPPORTED_OPERATION")
    )
    return joined.select("op_id", "file_id", "symbol", "operation", start.alias("start"), end.alias("end"), value.alias("value"), code.alias("code"))


def overlaps(resolved: DataFrame) -> DataFrame:
    """Adds ``overlap``: in falling order of start, the next interval ends behind this one's start."""
    order = W.partitionBy("file_id").orderBy(F.col("start").desc(), F.col("end").desc(), "op_id")
    usable = resolved.where("code is null")
    return usable.withColumn("overlap", F.coalesce(F.lead("end").over(order) > F.col("start"), F.lit(False)))


def plan(resolved: DataFrame) -> DataFrame:
    """Per file: number of operations and of refused ones, overlaps, and whether the batch may be applied."""
    marked = overlaps(resolved).groupBy("file_id").agg(F.bool_or("overlap").alias("overlapping"))
    counts = resolved.groupBy("file_id").agg(F.count(F.lit(1)).alias("operations"), F.count("code").alias("refused"))
    overlap = F.coalesce("overlapping", F.lit(False))
    return counts.join(marked, "file_id", "left").select(
        "file_id", "operations", "refused", overlap.alias("overlapping"), ((F.col("refused") == 0) & ~overlap).alias("applicable")
    )


def splice(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, patched): the texts of all applicable batches, edited from the end to the start."""
    usable = plan(resolved).where("applicable").select("file_id")
    change = F.struct((-F.col("start")).alias("a"), (-F.col("end")).alias("b"), "op_id", "start", "end", "value")
    listed = resolved.join(usable, "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list(change)).alias("changes"))

    def edit(text, c):
        return F.concat(F.substring(text, F.lit(1), c["start"]), c["value"], F.substring(text, c["end"] + 1, F.length(text)))

    return files.select("file_id", "text").join(listed, "file_id").select("file_id", F.aggregate("changes", F.col("text"), edit).alias("patched"))


def rollback_states(current: DataFrame, journal: DataFrame) -> DataFrame:
    """Journal entries (file_id, original_hash, patched_hash) as patched, original or foreign."""
    now = current.select("file_id", F.sha2("text", 256).alias("now"))
    state = F.when(F.col("now") == F.col("patched_hash"), "patched").when(F.col("now") == F.col("original_hash"), "original").otherwise("foreign")
    return journal.join(now, "file_id", "left").select("file_id", state.alias("state"))


def capped_prefix(messages: DataFrame, group: list[str], order: str, text: str, budget: int) -> DataFrame:
    """The leading messages of each group whose running token estimate stays within the budget."""
    running = F.sum(X.token_estimate(F.col(text))).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return messages.withColumn("running_tokens", running).where(F.col("running_tokens") <= budget)

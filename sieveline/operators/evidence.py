"""Evidence: content-addressed records, paging, deltas, symbol lookup.

Defined results: null texts have no reference, page or delta; an empty text is one empty page; a delta
between equal texts deletes and inserts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters that the metadata of a page takes.
PAGE_OVERHEAD = 320


def references(records: DataFrame) -> DataFrame:
    """Adds ``ref``, the content address of a record: equal records share it, whatever their id."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project", "file", "snapshot", "kind", "symbol")]
    address = F.concat(F.lit("ev_"), F.sha2(F.concat_ws("\u001f", *part, F.col("text")), 256))
    return records.where("text is not null").withColumn("ref", address)


def append_new(store: DataFrame, records: DataFrame) -> DataFrame:
    """Records to append: one per reference that the store does not hold yet."""
    fresh = references(records).join(store.select("ref"), "ref", "left_anti")
    return fresh.groupBy("ref").agg(*[F.min_by(c, "evidence_id").alias(c) for c in records.columns if c != "evidence_id"], F.min("evidence_id").alias("evidence_id"))


def pages(records: DataFrame, max_tokens: int = 300) -> DataFrame:
    """(evidence_id, page, offset, next_offset, total_chars, done, source): texts cut to the token budget of a page."""
    size = max_tokens * 4 - PAGE_OVERHEAD
    length = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size))
    each = records.where("text is not null").select("evidence_id", "text", F.posexplode(starts).alias("page", "offset"))
    end = F.least(F.col("offset") + size, length)
    return each.select(
        "evidence_id",
        "page",
        "offset",
        F.when(end < length, end).alias("next_offset"),
        length.alias("total_chars"),
        (end >= length).alias("done"),
        F.substring("text", F.col("offset") + 1, F.lit(size)).alias("source"),
    )


def delta_of(before: str, after: str) -> tuple[int, int, str]:
    """(offset, deleted characters, inserted text) by common prefix and suffix."""
    low, limit = 0, min(len(before), len(after))
    step = limit
    while step > 0:  # the longest common prefix, in halving steps over slices
        while low + step <= limit and before[low : low + step] == after[low : low + step]:
            low += step
        step //= 2
    tail, limit = 0, limit - low
    step = limit
    while step > 0:
        while tail + step <= limit and before[len(before) - tail - step : len(before) - tail] == after[len(after) - tail - step : len(after) - tail]:
            tail += step
        step //= 2
    return low, len(before) - tail - low, after[low : len(after) - tail]


def create_deltas(pairs: DataFrame) -> DataFrame:
    """pairs(key columns, before, after) with offset, delete_chars, insert and both hashes."""
    schema = "offset int, delete_chars int, insert string"

    @F.pandas_udf(schema)
    def delta(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for before, after in batches:
            yield pd.DataFrame([delta_of(b, a) for b, a in zip(before, after)], columns=["offset", "delete_chars", "insert"])

    known = pairs.where("before is not null and after is not null")
    return known.withColumn("d", delta("before", "after")).select(
        *[c for c in pairs.columns if c != "after"], "d.*", F.sha2("before", 256).alias("base_hash"), F.sha2("after", 256).alias("target_hash")
    )


def apply_deltas(deltas: DataFrame) -> DataFrame:
    """Adds ``after`` and ``intact``: whether base hash, range and target hash hold."""
    start, gone = F.col("offset"), F.col("delete_chars")
    after = F.concat(F.substring("before", F.lit(1), start), "insert", F.substring("before", start + gone + 1, F.length("before")))
    in_range = (start >= 0) & (gone >= 0) & (start + gone <= F.length("before"))
    intact = (F.sha2("before", 256) == F.col("base_hash")) & in_range & (F.sha2(after, 256) == F.col("target_hash"))
    return deltas.withColumn("after", after).withColumn("intact", intact)


def successive(records: DataFrame) -> DataFrame:
    """(evidence_id, prev_id, before, after): each record with the earlier one of the same file."""
    order = W.partitionBy("project", "file").orderBy("evidence_id")
    ids = records.where("text is not null").select("project", "file", "evidence_id").withColumn("prev_id", F.lag("evidence_id").over(order))
    texts = records.select("evidence_id", F.col("text").alias("after"))
    earlier = records.select(F.col("evidence_id").alias("prev_id"), F.col("text").alias("before"))
    return ids.where("prev_id is not null").select("evidence_id", "prev_id").join(texts, "evidence_id").join(earlier, "prev_id")


def lookup(symbols: DataFrame, names: DataFrame, most: int = 8) -> DataFrame:
    """names(project, name) against symbols by name or the tail of a qualified name.

    One match is returned with its text at confidence .95, several (the first eight) as signatures at .65. The first
    symbols of a name are taken before names meet them, so a hot name does not multiply its callers.
    """
    wanted = names.select("project", "name", F.element_at(F.split("name", "[.#]"), -1).alias("symbol")).distinct()
    counts = symbols.groupBy("project", "symbol").agg(F.count(F.lit(1)).alias("matches"))
    rank = F.row_number().over(W.partitionBy("project", "symbol").orderBy("sym_id"))
    first = symbols.withColumn("rank", rank).where(F.col("rank") <= most)
    return (
        wanted.join(counts, ["project", "symbol"])
        .join(first, ["project", "symbol"])
        .select(
            "project",
            "name",
            "rank",
            "matches",
            "sym_id",
            "file",
            "signature",
            F.when(F.col("matches") == 1, F.col("source_text")).alias("source"),
            F.when(F.col("matches") == 1, 0.95).otherwise(0.65).alias("confidence"),
        )
    )

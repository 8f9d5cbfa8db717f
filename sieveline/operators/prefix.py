"""Running values over numbered parts of a group, in two levels, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts that one window of the lower level holds.
FAN = 4096


def value_before(parts: DataFrame, keys: list[str], index: str, value: str, name: str, how: str = "sum", fan: int = FAN) -> DataFrame:
    """``parts`` with ``name``: the sum (from 0) or maximum (or null) of ``value`` over the earlier parts of the group.

    Parts are cut into runs of ``fan`` numbers. A window inside each run and one over the totals of the
    runs make up the value; a group of n parts needs windows of at most fan and n / fan rows.
    """
    total = F.sum if how == "sum" else F.max
    run = parts.withColumn("_run", F.floor(F.col(index) / F.lit(fan)))
    inside = W.partitionBy(*keys, "_run").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    outside = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    tops = run.groupBy(*keys, "_run").agg(total(value).alias("_top")).withColumn("_above", total("_top").over(outside)).drop("_top")
    both = run.withColumn("_near", total(value).over(inside)).join(tops, [*keys, "_run"])
    if how == "sum":
        result = F.coalesce("_near", F.lit(0)) + F.coalesce("_above", F.lit(0))
    else:
        result = F.greatest("_near", "_above")
    return both.withColumn(name, result).drop("_run", "_near", "_above")

from __future__ import annotations

import random

import pytest

from sieveline.operators.prefix import value_before


@pytest.mark.parametrize("fan", [1, 3, 4096])
def test_running_values(spark, fan):
    random.seed(1)
    rows = [(g, i, random.choice([None, random.randint(0, 9)])) for g in "ab" for i in random.sample(range(60), 30)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    sums = {(r.g, r.i): r.s for r in value_before(df, ["g"], "i", "v", "s", "sum", fan).collect()}
    tops = {(r.g, r.i): r.s for r in value_before(df, ["g"], "i", "v", "s", "max", fan).collect()}
    for g, i, _ in rows:
        earlier = [v for k, j, v in rows if k == g and j < i and v is not None]
        assert sums[g, i] == sum(earlier)
        assert tops[g, i] == (max(earlier) if earlier else None)

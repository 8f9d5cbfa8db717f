from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sieveline.llm import mixing
from sieveline.llm.mixing import TOKENIZER, count_tokens, mix_report, ordered, sample_mix, token_sizes

TARGETS = "mix_name string, source string, target_share double, max_repeats int, corpus_fraction double"


def sizes(spark, per_source):
    rows, i = [], 0
    for source, n, size in per_source:
        for _ in range(n):
            rows.append((i, source, size))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_copies_follow_the_prefix_sum(spark):
    docs = sizes(spark, [("a", 1000, 10), ("b", 10, 10), (None, 5, 100), ("zero", 3, 0)])
    total = 1000 * 10 + 10 * 10 + 500
    targets = spark.createDataFrame([("m", "a", 0.8, 2, 0.5), ("m", "b", 0.1, 3, 0.5), ("m", "absent", 0.05, 3, 0.5), ("m", "zero", 0.05, 3, 0.5)], TARGETS)
    mix = sample_mix(docs, targets)
    report = {r.source: r for r in mix_report(docs, targets, mix).collect()}
    f = 0.8 * 0.5 * total / 10_000
    assert abs(report["a"].copies - f * 1000) < 1 and report["a"].most_copies <= math.ceil(f)
    assert report["b"].copies == 30 and report["b"].most_copies == 3 and report["b"].short_tokens > 0
    assert report["absent"].copies == 0 and report["absent"].reached_share == 0
    assert report["zero"].copies == 0
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)


def test_places_are_a_permutation_and_do_not_depend_on_partitions(spark):
    docs = sizes(spark, [("a", 500, 1), ("b", 7, 1)])
    one = {(r.doc_id, r.place) for r in ordered(docs, "doc_id", "source", 7, bucket_rows=20).collect()}
    two = {(r.doc_id, r.place) for r in ordered(docs.repartition(9), "doc_id", "source", 7, bucket_rows=20).collect()}
    assert one == two and {p for d, p in one if d < 500} == set(range(1, 501))


def test_clashing_columns_nulls_and_repeated_rows(spark):
    rows = [(1, "a", 5, "m", 9), (1, "a", 5, "m", 9), (2, "a", None, None, None), (3, None, 7, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, mix_name string, place int")
    targets = spark.createDataFrame([("m", "a", 1.0, 2, 1.0), (None, "a", 0.5, 1, 0.1)], TARGETS)
    got = sample_mix(docs, targets).where("mix_name = 'm'").collect()
    assert sum(r.copies for r in got) in (5, 6) and max(r.copies for r in got) <= 2


def test_sizes_are_taken_evenly(spark):
    docs = spark.createDataFrame([(i, "a", 1 + (i * 37) % 1000) for i in range(2000)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 1.0, 2, 0.3)], TARGETS)
    report = mix_report(docs, targets, sample_mix(docs, targets)).first()
    assert report.tokens == pytest.approx(report.target_tokens, rel=0.01)


def test_empty_tables(spark):
    docs = sizes(spark, [("a", 1, 1)])
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], TARGETS)
    assert sample_mix(docs.limit(0), targets).count() == 0
    assert sample_mix(docs, targets.limit(0)).count() == 0
    assert mix_report(docs.limit(0), targets, sample_mix(docs.limit(0), targets)).first().reached_share is None


def test_token_counts(spark):
    assert count_tokens(None) == 0 and count_tokens("") == 0
    assert count_tokens("Hello world<|endoftext|>", TOKENIZER) > 3
    long = "word " * 20_000
    assert abs(count_tokens(long) - 20_000) <= 10
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, None)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.n_tokens for r in token_sizes(df, "doc_id", "text", ["source"]).collect()}
    assert got == {1: 2, 2: 0}
    assert df.agg(F.count("text")).first()[0] == 1


def test_long_texts_are_counted_like_whole_ones():
    indented = "".join(f"{' ' * (4 * (i % 7))}total_{i}x9 = it's(é日本, '{i}')\n\n   \n" for i in range(3000))
    whole = mixing._encoding(TOKENIZER).encode_ordinary(indented)
    assert len(indented) > 3 * mixing.PIECE_CHARS and count_tokens(indented) == len(whole)

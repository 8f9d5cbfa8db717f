"""Mix sources to target weights by systematic sampling.

The documents of a source are put into a fixed order: pseudo-random buckets, and inside a bucket by size, so
that the sample takes all sizes evenly and its tokens come close to their expectation. Each has the same number of
expected copies ``f = min(target tokens / tokens of the source, max_repeats)``. With the prefix sum
``S`` of the expected copies and one random offset ``u`` in [0, 1) per mix and source, a document is
taken once for each integer that ``S + u`` crosses at it: between floor(f) and ceil(f) times, and
floor(f * n + u) times in total, whatever the offset.

Prefix sums at scale: documents are hashed into buckets of bounded size, the buckets are counted
with a partial aggregation, the few counts are summed up per source, and only the place inside a
bucket needs a window. No group grows with the corpus, and since nothing depends on partition
numbers a lost executor recomputes the same sample.

Sizes are tokens of a public byte-level tokenizer whose vocabulary file is a parameter.

Defined results: a wanted source without documents gives no rows and a reached share of 0; a source
that is too small gives each document ``max_repeats`` times and the report shows the shortfall (other
sources keep their own target); documents without source are in no mix but count in the total of all
tokens; null texts have 0 tokens; repeated texts are documents of their own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.operators.prefix import value_before

#: Vocabulary file (token in base64 and its rank per line); a path every executor can read.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary's tokenizer cuts a text before the merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that a bucket holds on average.
BUCKET_ROWS = 20_000
#: Longer texts are counted in pieces, cut only where no token can reach over: before a blank behind a word, and between letter and digit.
PIECE_CHARS = 20_000


@lru_cache(maxsize=4)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS:
        m = _CUT.search(text, at + PIECE_CHARS)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of one text; special tokens' strings are ordinary text."""
    if not text:
        return 0
    encoding = _encoding(path)
    return sum(len(encoding.encode_ordinary(piece)) for piece in _pieces(text))


def token_sizes(docs: DataFrame, id_col: str, text_col: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The kept columns with n_tokens; one pass, no shuffle."""

    @F.pandas_udf("bigint")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: count_tokens(t, path)).astype("int64")

    return docs.select(id_col, *keep, size(F.col(text_col).cast("string")).alias("n_tokens"))


def _unit(*columns, seed: int):
    """A fixed pseudo-random number in [0, 1) of the columns."""
    return (F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")) / F.lit(float(1 << 52))


def plan_mix(sizes: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """Expected copies of each wanted source of each mix; as many rows as ``targets`` has."""
    per_source = sizes.groupBy(source).agg(
        F.count(F.lit(1)).alias("source_docs"), F.sum("n_tokens").alias("source_tokens")
    )
    total = per_source.groupBy().agg(F.sum("source_tokens").alias("all_tokens"))
    wanted = F.col("target_share") * F.col("corpus_fraction") * F.coalesce("all_tokens", F.lit(0))
    copies = F.when(
        F.col("source_tokens") > 0,
        F.least(F.col("target_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double")),
    ).otherwise(F.lit(0.0))
    return (
        targets.select("mix_name", source, "target_share", "max_repeats", "corpus_fraction")
        .join(per_source.where(F.col(source).isNotNull()), source, "left")
        .crossJoin(F.broadcast(total))
        .withColumn("target_tokens", wanted)
        .na.fill(0, ["source_docs", "source_tokens"])
        .withColumn("expected_copies", copies)
    )


def ordered(sizes: DataFrame, id_col: str, source: str, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``place``: the position (from 1) in the order of the document's source.

    The number of buckets follows the size of the table; a source of any size is spread over all.
    """
    sizes = sizes.select(id_col, source, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    rows = sizes.groupBy().agg(F.count(F.lit(1)).alias("n_rows"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(bucket_rows)))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col))
    placed = (
        sizes.where(F.col(source).isNotNull())
        .crossJoin(F.broadcast(rows.select(buckets.cast("bigint").alias("_buckets"))))
        .withColumn("_bucket", F.pmod(hashed, F.col("_buckets")))
        .drop("_buckets")
    )
    counts = placed.groupBy(source, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = value_before(counts, [source], "_bucket", "_n", "_before").drop("_n")
    inside = F.row_number().over(W.partitionBy(source, "_bucket").orderBy("n_tokens", hashed, id_col))
    return (
        placed.withColumn("_inside", inside)
        .join(offsets, [source, "_bucket"])
        .withColumn("place", F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def sample_mix(
    sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id", source: str = "source", seed: int = 7
) -> DataFrame:
    """(mix_name, source, document, n_tokens, copies): how often each taken document occurs in each mix.

    ``sizes`` has the id, the source and n_tokens of every document. The mixes are a small table of
    wanted sources; each document meets only the rows of its own source.
    """
    plan = plan_mix(sizes, targets, source).where("expected_copies > 0")
    offset = _unit(F.col("mix_name"), F.col(source), seed=seed)
    wanted = plan.select("mix_name", source, "expected_copies", offset.alias("_u"))
    place, f, u = F.col("place").cast("double"), F.col("expected_copies"), F.col("_u")
    copies = F.floor(place * f + u) - F.floor((place - 1) * f + u)
    return (
        ordered(sizes, id_col, source, seed)
        .join(F.broadcast(wanted), source)
        .select("mix_name", source, id_col, "n_tokens", copies.cast("bigint").alias("copies"))
        .where("copies > 0")
    )


def mix_report(sizes: DataFrame, targets: DataFrame, mix: DataFrame, source: str = "source") -> DataFrame:
    """Per mix and wanted source: target and reached tokens and share, copies and shortfall."""
    reached = mix.groupBy("mix_name", source).agg(
        F.count(F.lit(1)).alias("docs_taken"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
    )
    per_mix = W.partitionBy("mix_name")
    return (
        plan_mix(sizes, targets, source)
        .join(reached, ["mix_name", source], "left")
        .na.fill(0, ["docs_taken", "copies", "most_copies", "tokens"])
        .withColumn("mix_tokens", F.sum("tokens").over(per_mix))
        .withColumn("reached_share", F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")))
        .withColumn("short_tokens", F.greatest(F.lit(0.0), F.col("target_tokens") - F.col("tokens")))
    )

"""Vectors: exact top-k by dot product (cosine of unit vectors), in blocks of queries, and the embedding cache.

Defined results: null vectors and vectors of another length than the query give no row; ties end in the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors that one broadcast block holds.
BLOCK_QUERIES = 4096


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k rows for each query.

    Each task multiplies its rows with a bounded block of queries and keeps its own best k per query; only
    those meet in the shuffle. More queries mean more blocks, not larger ones.
    """
    numbered = queries.select(F.col(id_col).cast("bigint").alias("q"), F.col(vec_col).alias("v")).where("v is not null")
    found = None
    pending: list = []

    def search(chunk: list) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(
            (np.array([r[0] for r in chunk], dtype=np.int64), np.array([r[1] for r in chunk], dtype=np.float64))
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                keys = batch["k"].to_numpy()
                vectors = [np.asarray(v, dtype=np.float64) for v in batch["v"]]
                fits = np.array([len(v) == matrix.shape[1] for v in vectors], dtype=bool)
                if not fits.any():
                    continue
                keys = keys[fits]
                product = matrix @ np.stack([v for v, ok in zip(vectors, fits) if ok]).T
                for i, scores in enumerate(product):
                    edge = np.partition(-scores, min(k, len(scores)) - 1)[min(k, len(scores)) - 1]
                    at = np.flatnonzero(-scores <= edge)  # ties at the edge stay until the ids decide
                    yield pd.DataFrame({"query_id": ids[i], "vec_id": keys[at], "score": scores[at]})

        narrow = rows.select(F.col(id_col).cast("bigint").alias("k"), F.col(vec_col).alias("v")).where("k is not null and v is not null")
        return narrow.mapInPandas(run, "query_id bigint, vec_id bigint, score double")

    for row in numbered.toLocalIterator():
        pending.append((row["q"], row["v"]))
        if len(pending) == block:
            found = search(pending) if found is None else found.unionByName(search(pending))
            pending = []
    if pending:
        found = search(pending) if found is None else found.unionByName(search(pending))
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    score = F.round("score", 6)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(score.desc(), "vec_id"))
    return found.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k)


def pending_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct content hashes of texts(content) that the cache(key) does not hold."""
    hashed = texts.where("content is not null").select(F.sha2("content", 256).alias("key")).distinct()
    return hashed.join(cache.select("key").distinct(), "key", "left_anti")


def embedding_document(path, text):
    """What a file is embedded as: path words, up to 12 exported names, up to 6 string literals, 500 characters."""
    head = F.substring(text, 1, 4000)
    names = F.slice(F.regexp_extract_all(head, F.lit(r"export\s+(?:async\s+)?(?:function|const|class|interface|type)\s+([A-Za-z0-9_]+)"), F.lit(1)), 1, 12)
    strings = F.slice(F.regexp_extract_all(head, F.lit("[\"'`][^\"'`\n]{8,60}[\"'`]"), F.lit(0)), 1, 6)
    plain = F.regexp_replace(F.array_join(strings, " "), "[\"'`]", "")
    words = F.regexp_replace(path, "[/_.-]", " ")
    return F.substring(F.concat_ws(" ", F.concat(F.lit("passage: "), words), F.array_join(names, " "), plain), 1, 500)

"""Vectors: cosine similarity and exact top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; null for the zero vector."""
    return F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))


#: Queries are taken to the workers in parts of at most so many bytes.
BLOCK_BYTES = 16 << 20


def top_k(queries: DataFrame, catalog: DataFrame, k: int, qid: str = "query_id", cid: str = "vec_id", vec: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, item, score, rank): exact top k by cosine to six places, clamped to 1..20, ties by item; zero vectors have no score.

    Queries are a stated set.  They go to the workers in blocks of a checked
    size, each scored against every catalog batch by one matrix product; a
    batch keeps its own best k per query, so what is shuffled for the final
    rank is bounded by queries, k and batches.  All vectors have one length.
    """
    k = min(max(k, 1), 20)
    width = queries.select(F.size(vec)).first()
    spark, schema = queries.sparkSession, [queries.schema[qid], catalog.schema[cid], T.StructField("score", T.DoubleType())]
    blocks = max(1, -(-queries.count() * (width[0] if width else 1) * 8 // block_bytes))
    part = F.pmod(F.xxhash64(qid), F.lit(blocks))
    parts = []
    for b in range(blocks):
        q = queries.where(part == b).select(qid, vec).toPandas()
        if len(q):
            parts.append(_scored(q[qid].to_numpy(), _unit(np.array(q[vec].tolist(), dtype=np.float64)), catalog, k, cid, vec, T.StructType(schema)))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    best = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(cid)))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, np.nan, n)


def _scored(ids: np.ndarray, unit: np.ndarray, catalog: DataFrame, k: int, cid: str, vec: str, schema: T.StructType) -> DataFrame:
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[vec].notna()]
            if b.empty:
                continue
            s = np.round(_unit(np.array(b[vec].tolist(), dtype=np.float64)) @ unit.T, 6)
            s = np.where(np.isnan(s), -np.inf, s)
            least = np.partition(s, max(0, len(s) - k), axis=0)[max(0, len(s) - k)]
            item, query = np.nonzero((s >= least) & (s > -np.inf))
            yield pd.DataFrame({names[0]: ids[query], names[1]: b[cid].to_numpy()[item], "score": s[item, query]})

    return catalog.select(cid, vec).mapInPandas(run, schema)

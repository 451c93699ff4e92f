"""Embeddings and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries whose vectors travel to the blocks of the base at once; more are asked in turns.
MAX_QUERIES = 10_000


def embed(chunks: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """Adds the embedding a callable gives each text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in model([x or "" for x in s])])

    return chunks.withColumn(out, vectors(text))


def hashing_embedding(texts: list[str], dim: int = 256) -> list[list[float]]:
    """Offline default model: signed hashed word counts, scaled to length one."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(dim, dtype=np.float32)
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h & 0x10000 else -1.0
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return out


def nearest(base: DataFrame, base_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int = 3) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest rows of each query by squared distance, ties by id.

    The stated queries go to every block of the base; each block keeps its own best ``k`` of every
    query, so what is shuffled does not grow with the vectors but with blocks times queries times
    k. More than about MAX_QUERIES queries are asked in turns by a hash of their id, each a scan of the base. Rows with a NULL
    or differently long vector have no distance and are left out.
    """
    asked = queries.select(query_id, query_vec).where(F.col(query_vec).isNotNull())
    turns = -(-asked.count() // MAX_QUERIES) or 1
    parts = [asked.where(F.pmod(F.xxhash64(query_id), F.lit(turns)) == n) for n in range(turns)]
    return reduce(DataFrame.unionByName, (_nearest(base, base_id, vec, p, query_id, query_vec, k) for p in parts))


def _nearest(base: DataFrame, base_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int) -> DataFrame:
    rows = queries.collect()
    ids = [r[0] for r in rows]
    q = np.array([r[1] for r in rows], dtype=np.float64)
    qt, bt = dict(queries.dtypes)[query_id], dict(base.dtypes)[base_id]

    def block_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_d = best_i = None
        for b in batches:
            ok = b.iloc[:, 1].map(lambda v: v is not None and len(q) > 0 and len(v) == q.shape[1])
            b = b[ok]
            for a in range(0, len(b), 4096):
                part = b.iloc[a : a + 4096]
                x = np.stack(part.iloc[:, 1].to_numpy()).astype(np.float64)
                d = np.stack([((x - row) ** 2).sum(axis=1) for row in q])
                i = np.broadcast_to(part.iloc[:, 0].to_numpy(), d.shape)
                if best_d is not None:
                    d, i = np.concatenate((best_d, d), axis=1), np.concatenate((best_i, i), axis=1)
                keep = np.stack([np.lexsort((ii, dd))[:k] for dd, ii in zip(d, i, strict=True)])
                best_d, best_i = np.take_along_axis(d, keep, 1), np.take_along_axis(i, keep, 1)
        if best_d is not None:
            yield pd.DataFrame({"q": np.repeat(np.array(ids), best_d.shape[1]), "i": best_i.ravel(), "d": best_d.ravel()})

    if not ids:
        q = np.zeros((0, 0))
    local = base.select(base_id, vec).mapInPandas(block_best, f"q {qt}, i {bt}, d double")
    top = local.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "i"))), 1, k).alias("t"))
    return top.select(F.col("q").alias(query_id), F.posexplode("t").alias("p", "x")).select(query_id, (F.col("p") + 1).alias("rank"), F.col("x.i").alias("id"), F.col("x.d").alias("distance"))

"""Nearest neighbours by vector, in cells; an inverted-file index for approximate search; similarity links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import matrix
from ..store import ship
from . import cells

#: Queries that meet a list at once.
BLOCK = 4096


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 10, threshold: float = -1.0, key: str = "id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, id, score (cosine, rounded), rank: for each query its k best other rows of the corpus from the threshold on.

    A stated query set against all rows: parts of the queries meet parts of the corpus in cells, and only the k best of a cell go on.
    Equal scores rank by id."""
    q = cells.packed(queries, [], key, vector)
    c = q if queries is corpus else cells.packed(corpus, [], key, vector)
    near = cells.meet(q, c, [], lambda left, same: cells.Best(left, k, threshold, digits, ["query_id", "id", "score"]), "query_id long, id long, score double", most=max(64, min(cells.MOST, 2**22 // max(k, 1))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(corpus: DataFrame, lists: int, key: str = "id", vector: str = "embedding", sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on at most `sample` vectors (those whose hashed id comes first)."""
    rows = corpus.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toPandas()[vector]
    m = matrix(rows)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    c = m[np.linspace(0, len(m) - 1, min(lists, len(m))).astype(int)] if len(m) else np.zeros((1, 1))
    for _ in range(rounds):
        near = (m @ c.T).argmax(axis=1)
        for i in range(len(c)):
            own = m[near == i]
            if len(own):
                v = own.sum(axis=0)
                c[i] = v / max(np.linalg.norm(v), 1e-12)
    return c


def assign(df: DataFrame, c: np.ndarray, nearest: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """id, v (unit vector), list: each row in the lists of its nearest centroids. c is bounded by its parameter."""
    ship(df.sparkSession)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m = matrix(b["v"])
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
            top = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :nearest]
            at = np.repeat(np.arange(len(b)), top.shape[1])
            yield pd.DataFrame({"id": b["k"].to_numpy()[at], "v": [m[i].tolist() for i in at], "list": top.ravel()})

    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInPandas(place, "id long, v array<double>, list int")


def ivf_join(queries: DataFrame, corpus: DataFrame, k: int = 10, lists: int = 64, probes: int = 48, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Approximate knn_join: all rows are indexed in the list of their nearest centroid, a query looks into `probes` lists.
    Lists are split into salted parts before they meet, so that a list that holds many rows is not one task's."""
    c = centroids(corpus, lists, key, vector)
    parts = 16
    rows = assign(corpus, c, 1, key, vector).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    asks = assign(queries, c, probes, key, vector).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            y, ids = matrix(b["v"]), b["id"].to_numpy()
            for at in range(0, len(a), BLOCK):
                part = a.iloc[at : at + BLOCK]
                s = np.round(matrix(part["v"]) @ y.T, 6) + 0.0
                q = part["id"].to_numpy()
                s[q[:, None] == ids[None, :]] = -2
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(q)), top.shape[1])
                out.append(pd.DataFrame({"query_id": q[row], "id": ids[top.ravel()], "score": s[row, top.ravel()]}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})
        return found[found["score"] > -2]

    met = asks.groupBy("list", "part").cogroup(rows.groupBy("list", "part")).applyInPandas(meet, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity_links(df: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """a, b (a < b), score of the rows from the threshold on; within the groups of `by` if given, else over all. Parts of a group meet
    two by two in cells; what a tile of a cell finds goes on before the next is met."""
    p = cells.packed(df, by or [], key, vector)
    return cells.meet(p, p, by or [], lambda left, same: cells.Links(left, same, threshold, digits), "a long, b long, score double", half=True)

"""Vector search: exact scans with native arithmetic, batch k-NN, and an inverted-file index over Parquet partitions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as S

from tessera.errors import ValidationError
from tessera.functions import vectors as V
from tessera.sources.stage import staged

METRICS = ("cosine", "l2")
MAX_BATCH_QUERIES = 100_000
MAX_BATCH_BYTES = 64 << 20
SCORES = 1 << 22


class ExactIndex:
    """Brute-force search. A score is a cosine, or minus the distance for l2; ties go to the smaller id."""

    def __init__(self, df: DataFrame, id_column: str = "id", vector: str = "vector", metric: str = "cosine"):
        if metric not in METRICS:
            raise ValidationError(f"unknown metric {metric!r}")
        self.df, self.id, self.vector, self.metric = df, id_column, vector, metric

    def _scored(self, q: Sequence[float], df: DataFrame | None = None) -> DataFrame:
        q, df = V.check_vector(q), self.df if df is None else df
        score = V.cosine(S.col(self.vector), q) if self.metric == "cosine" else S.lit(0.0) - V.l2(S.col(self.vector), q)
        return df.where(V.usable(S.col(self.vector), len(q))).select(self.id, score.alias("score"))

    def search(self, q: Sequence[float], k: int) -> DataFrame:
        return self._scored(q).orderBy(S.desc("score"), self.id).limit(max(0, k))

    def range_search(self, q: Sequence[float], threshold: float) -> DataFrame:
        bound = threshold if self.metric == "cosine" else -threshold
        return self._scored(q).where(S.col("score") >= bound)

    def search_rows(self, q: Sequence[float], k: int) -> DataFrame:
        """The whole rows of the k nearest, with their scores."""
        return self.df.join(S.broadcast(self.search(q, k)), self.id)

    def near(self, q: Sequence[float], threshold: float) -> DataFrame:
        """The rows that the predicate near[] holds for."""
        return self.df.join(self.range_search(q, threshold).select(self.id), self.id, "left_semi")

    def search_batch(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """The k nearest of every query. Queries go to each task as one matrix, which keeps its best k of each Arrow batch; a
        window merges these partial lists. More than MAX_BATCH_QUERIES queries, or MAX_BATCH_BYTES of them, are dealt into blocks of about that many by a
        hash, each is run against all rows and its result staged before the next one comes to the driver."""
        q = queries.select(S.col(query_id).cast("long").alias("query_id"), S.col(vector).cast("array<double>").alias("vector"))
        n, dim = q.agg(S.count(S.lit(1)), S.coalesce(S.max(S.size("vector")), S.lit(1))).first()
        most = max(1, min(MAX_BATCH_QUERIES, MAX_BATCH_BYTES // (8 * max(1, dim))))
        if n <= most:
            return self._block(q, k)
        # by the id: rows of one query_id are ranked together
        blocks = -(-n // most)
        q = staged(q.withColumn("block", S.pmod(S.xxhash64("query_id"), S.lit(blocks))), "queries")
        out = None
        for i in range(blocks):
            part = staged(self._block(q.where(S.col("block") == i).drop("block"), k), "nearest")
            out = part if out is None else out.unionByName(part)
        return out

    def _block(self, queries: DataFrame, k: int) -> DataFrame:
        rows = queries.collect()
        ids = np.array([r[0] for r in rows], dtype="int64")
        matrix = np.array([r[1] for r in rows], dtype="float64").reshape(len(rows), len(rows[0][1]) if rows else 0)
        metric, id_column, vec = self.metric, self.id, self.vector
        unit = _unit(matrix) if metric == "cosine" else matrix

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                x = np.stack(b[vec].to_numpy()).astype("float64")
                own = b[id_column].to_numpy()
                n = min(k, len(own))
                if n < 1:
                    continue
                y = _unit(x) if metric == "cosine" else x
                # so many queries at a time that their scores stay small
                step = max(1, SCORES // len(own))
                for a in range(0, len(ids), step):
                    u = unit[a : a + step]
                    s = u @ y.T if metric == "cosine" else -np.sqrt(np.maximum(0, (u**2).sum(1)[:, None] - 2 * u @ y.T + (y**2).sum(1)))
                    best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(own) else np.tile(np.arange(len(own)), (len(u), 1))
                    edge = np.take_along_axis(s, best, 1).min(1)
                    at, col = np.nonzero(s >= edge[:, None])
                    yield pd.DataFrame({"query_id": ids[a + at], "id": own[col], "score": s[at, col]})

        usable = self.df.where(V.usable(S.col(vec), matrix.shape[1] if len(ids) else None)).select(id_column, vec)
        part = usable.mapInPandas(run, "query_id long, id long, score double")
        w = Window.partitionBy("query_id").orderBy(S.desc("score"), "id")
        return part.withColumn("rank", S.row_number().over(w)).where(S.col("rank") <= k)

    def add(self, rows: DataFrame) -> ExactIndex:
        """Upsert by id."""
        kept = self.df.join(rows.select(self.id), self.id, "left_anti").select(*self.df.columns)
        return ExactIndex(kept.unionByName(rows.select(*self.df.columns)), self.id, self.vector, self.metric)

    def remove(self, ids: DataFrame) -> ExactIndex:
        return ExactIndex(self.df.join(ids.select(self.id), self.id, "left_anti"), self.id, self.vector, self.metric)

    def stats(self) -> dict[str, Any]:
        n, dim = self.df.agg(S.count(S.lit(1)), S.max(S.size(self.vector))).first()
        return {"size": n, "dim": dim or 0, "metric": self.metric}


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _centroids(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """k-means of a bounded sample: seeds far from each other, then Lloyd's steps; an empty cell keeps its centroid."""
    if not len(x):
        return np.zeros((1, max(1, x.shape[1])))
    rng = np.random.default_rng(seed)
    c = x[rng.integers(len(x))][None]
    near = ((x - c[0]) ** 2).sum(1)
    while len(c) < min(k, len(x)) and near.sum() > 0:
        c = np.vstack([c, x[rng.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, ((x - c[-1]) ** 2).sum(1))
    for _ in range(iterations):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class IvfIndex(ExactIndex):
    """Inverted file: k-means cells (fitted on at most `fit_rows` rows on the driver, then every row is indexed), a search
    scans the `nprobe` nearest cells and ranks exactly. With nprobe = nlist it equals the exact search."""

    def __init__(self, df: DataFrame, id_column: str, vector: str, metric: str, centroids: np.ndarray, nprobe: int):
        super().__init__(df, id_column, vector, metric)
        self.centroids, self.nprobe, self._radii = centroids, nprobe, None

    @staticmethod
    def build(df: DataFrame, id_column: str = "id", vector: str = "vector", metric: str = "cosine", nlist: int = 16, nprobe: int = 4, fit_rows: int = 20_000, seed: int = 42, iterations: int = 10) -> IvfIndex:
        usable = df.where(V.usable(S.col(vector)))
        fit = usable.select(id_column, S.col(vector).cast("array<double>").alias("v")).orderBy(S.xxhash64(id_column), id_column).limit(fit_rows)
        x = np.array([r[1] for r in fit.collect()], dtype="float64")
        x = _unit(x) if metric == "cosine" and len(x) else x.reshape(len(x), -1)
        index = IvfIndex(df, id_column, vector, metric, _centroids(x, nlist, iterations, seed), nprobe)
        return index._with(index._cells(usable))

    def _cells(self, rows: DataFrame) -> DataFrame:
        """Usable rows with the cell of the nearest centroid."""
        centroids, metric = self.centroids, self.metric

        @S.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="int32")
            x = np.stack(v.to_numpy()).astype("float64")
            x = _unit(x) if metric == "cosine" else x
            return pd.Series(((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1).astype("int32"))

        # only usable vectors reach the function: the others get no cell
        usable = rows.where(V.usable(S.col(self.vector), self.centroids.shape[1]))
        return usable.withColumn("cid", nearest(S.col(self.vector)))

    def _with(self, df: DataFrame) -> IvfIndex:
        return type(self)(df, self.id, self.vector, self.metric, self.centroids, self.nprobe)

    def add(self, rows: DataFrame) -> IvfIndex:
        """Upsert by id: rows come without a cell and go to that of the nearest centroid; unusable ones only take out the old row."""
        kept = self.df.join(rows.select(self.id), self.id, "left_anti").select(*self.df.columns)
        return self._with(kept.unionByName(self._cells(rows).select(*self.df.columns)))

    def remove(self, ids: DataFrame) -> IvfIndex:
        return self._with(super().remove(ids).df)

    def radii(self) -> dict[int, float]:
        """How far a cell's farthest vector is from its centroid; one row for each cell reaches the driver."""
        centroids, metric = self.centroids, self.metric

        @S.pandas_udf("double")
        def far(v: pd.Series, cid: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="float64")
            x = np.stack(v.to_numpy()).astype("float64")
            return pd.Series(np.linalg.norm((_unit(x) if metric == "cosine" else x) - centroids[cid.to_numpy()], axis=1))

        if self._radii is None:
            self._radii = {r[0]: r[1] for r in self.df.groupBy("cid").agg(S.max(far(S.col(self.vector), S.col("cid")))).collect()}
        return self._radii

    def near(self, q: Sequence[float], threshold: float) -> DataFrame:
        """Exact, and reads only the cells that the triangle inequality leaves."""
        x = np.array(V.check_vector(q))
        x = x / (np.linalg.norm(x) or 1) if self.metric == "cosine" else x
        reach = np.sqrt(max(0.0, 2 - 2 * threshold)) if self.metric == "cosine" else threshold
        cells = [c for c, r in self.radii().items() if np.linalg.norm(self.centroids[c] - x) <= reach + r + 1e-6]
        rows = self.df.where(S.col("cid").isin(cells)) if cells else self.df.limit(0)
        return ExactIndex(rows, self.id, self.vector, self.metric).near(q, threshold)

    def probes(self, q: Sequence[float]) -> list[int]:
        x = np.array(V.check_vector(q))
        x = x / (np.linalg.norm(x) or 1) if self.metric == "cosine" else x
        return [int(i) for i in np.argsort(((self.centroids - x) ** 2).sum(1), kind="stable")[: self.nprobe]]

    def _scored(self, q: Sequence[float], df: DataFrame | None = None) -> DataFrame:
        return super()._scored(q, self.df.where(S.col("cid").isin(self.probes(q))))

    def save(self, path: str) -> None:
        """One Parquet folder for each cell, so that a probe reads only its cells; the model lies beside it."""
        self.df.write.mode("overwrite").partitionBy("cid").parquet(f"{path}/cells")
        meta = {"id": self.id, "vector": self.vector, "metric": self.metric, "nprobe": self.nprobe, "centroids": self.centroids.tolist()}
        self.df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: Any, path: str) -> IvfIndex:
        m = json.loads(spark.read.parquet(f"{path}/model").first()[0])
        return cls(spark.read.parquet(f"{path}/cells"), m["id"], m["vector"], m["metric"], np.array(m["centroids"]), m["nprobe"])


class GraphIndex(IvfIndex):
    """The interface of a graph index (build, add, remove, search, save, load) served by exact probing of all cells:
    Spark has no navigable graph, and a full probe gives a superset of what one would find."""

    @staticmethod
    def build(df: DataFrame, id_column: str = "id", vector: str = "vector", metric: str = "cosine", **_: Any) -> GraphIndex:
        return GraphIndex(df.where(V.usable(S.col(vector))).withColumn("cid", S.lit(0)), id_column, vector, metric, np.zeros((1, 1)), 1)

    def probes(self, q: Sequence[float]) -> list[int]:
        """There is one cell."""
        return [0]

    def near(self, q: Sequence[float], threshold: float) -> DataFrame:
        return ExactIndex(self.df, self.id, self.vector, self.metric).near(q, threshold)

    def _cells(self, rows: DataFrame) -> DataFrame:
        return rows.where(V.usable(S.col(self.vector))).withColumn("cid", S.lit(0))

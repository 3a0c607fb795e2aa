"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits the space again and again by a random direction at the median; vectors near the split (within `SPILL`)
go to both sides. Vectors are compared only within a leaf, and only with their own label. The trees (their medians) are
fitted on at most `FIT` vectors, for the first `FITTED` levels; every vector is then sent down every tree, as deep as
leaves of about `LEAF` vectors of the largest label call for. A pair that shares leaves of several trees is
counted in the first one only, which both rows' lists of leaves show; so leaf tasks send counts and a spanning forest of
their links, not all pairs. Equal vectors are collapsed first and counted by multiplicity.

A leaf with more than `LEAF_ROWS` vectors of a label is cut into blocks, and each pair of blocks is compared by a task of
its own, so memory stays bounded. Pairs are verified with cosines in double precision. Recall: pairs at the threshold are
together in a tree with probability over 0.9, so six trees miss about one in a million (see the tests).

Null, zero or non-finite vectors, those with null components, and those with a null label link with nothing; they are
components of their own. Vectors of every dimension are compared, each with those of its own dimension: the dimension counts
as part of the label, and each has its own trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.llm.arrow import partitions
from tessera.llm.components import components
from tessera.sources.stage import staged

THRESHOLD = 0.98
TREES = 6
SPILL = 0.02
LEAF = 256
LEAF_ROWS = 4000
FIT = 20_000
FITTED = 12  # levels with medians
DEEPEST = 40


class Forest:
    """Directions and medians; node k has the children 2k + 1 and 2k + 2. Below `fitted` levels, for which the sample would
    be too small, all nodes of a level share a direction and split at 0, so the depth can follow the number of vectors."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int = 11, fitted: int | None = None):
        rng = np.random.default_rng(seed)
        self.depth, self.spill, self.fitted = depth, spill, min(depth, FITTED if fitted is None else fitted)
        self.direction, self.middle, self.below = [], [], []
        for _ in range(trees):
            d = rng.standard_normal((2**self.fitted - 1, sample.shape[1]))
            d /= np.linalg.norm(d, axis=1, keepdims=True)
            m = np.zeros(len(d))
            rows = {0: np.arange(len(sample))}
            for k in range(len(d)):
                own = rows.pop(k)
                p = sample[own] @ d[k]
                m[k] = np.median(p) if len(own) else 0.0
                rows[2 * k + 1], rows[2 * k + 2] = own[p <= m[k]], own[p > m[k]]
            self.direction.append(d)
            self.middle.append(m)
            deep = rng.standard_normal((depth - self.fitted, sample.shape[1]))
            self.below.append(deep / np.linalg.norm(deep, axis=1, keepdims=True))

    def leaves(self, x: np.ndarray) -> list[np.ndarray]:
        """For each tree (row, leaf) pairs, rows ascending."""
        out = []
        for d, m, deep in zip(self.direction, self.middle, self.below):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                p = np.einsum("ij,ij->i", x[row], d[node]) - m[node] if level < self.fitted else (x @ deep[level - self.fitted])[row]
                left, right = p <= self.spill, p > -self.spill
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            order = np.lexsort((node, row))
            out.append(np.stack([row[order], node[order] - (2**self.depth - 1)], axis=1))
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """(counts: rep, linked; edges: u, v) for distinct vectors (rep, label, times, embedding)."""
    spark = vectors.sparkSession
    dim = F.size("embedding").alias("dim")
    most = vectors.groupBy("label", dim).count().groupBy("dim").agg(F.max("count"), F.sum("count")).collect()
    if not most:
        return spark.createDataFrame([], "rep long, linked long"), spark.createDataFrame([], "u long, v long")
    forests = {}
    for size, largest, total in most:
        depth = int(min(DEEPEST, max(0, np.ceil(np.log2(largest / leaf)))))
        if not depth:
            # one leaf, nothing to fit
            forests[size] = Forest(np.zeros((0, size)), 0, 1, spill)
            continue
        own = vectors.where(dim == size)
        fit = own.orderBy(F.xxhash64("rep")).limit(FIT) if total > FIT else own
        sample = np.array([list(r[0]) for r in fit.select(F.col("embedding").cast("array<double>")).collect()]).reshape(-1, size)
        forests[size] = Forest(_unit(sample), depth, trees, spill)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 2000):
                part = b.slice(a, 2000)
                emb = part.column(3)
                x = emb.to_pylist()
                sizes = np.array([len(v) for v in x])
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    found = forests[size].leaves(_unit(np.array([x[i] for i in rows], float)))
                    own = [[] for _ in rows]
                    for t, f in enumerate(found):
                        for r, n in f.tolist():
                            own[r].append(t << 56 | n)
                    lens = np.array([len(o) for o in own])
                    rep = np.repeat(rows, lens)
                    key = np.concatenate([np.array(o, np.int64) for o in own])
                    idx = pa.array(rep)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1).take(idx), pa.array(key), part.column(0).take(idx), part.column(2).take(idx), emb.take(idx), pa.array([own[i] for i in np.repeat(np.arange(len(rows)), lens)], pa.list_(pa.int64()))],
                        names=["label", "leaf", "rep", "times", "embedding", "own"],
                    )

    # components travel as they are given; anything but float as double
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    placed = staged(vectors.select("rep", F.concat_ws(":", F.size("embedding"), F.col("label").cast("string")).alias("label"), "times", F.col("embedding").cast(kind).alias("embedding")).mapInArrow(place, f"label string, leaf long, rep long, times long, embedding {kind}, own array<long>"), "leaves")
    sizes = placed.groupBy("label", "leaf").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).alias("blocks")).where("blocks > 1")
    cut = placed.join(sizes, ["label", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("label", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "times", "embedding", "own")

    def compare(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        leaf_key, i, j = keys[1], keys[2], keys[3]
        m = _unit(np.stack(g["embedding"].to_numpy()).astype(np.float64))
        rep, times, block = g["rep"].to_numpy(), g["times"].to_numpy(), g["block"].to_numpy()
        width = max(len(o) for o in g["own"])
        own = np.full((len(g), width), -1, np.int64)
        for k, o in enumerate(g["own"]):
            own[k, : len(o)] = o
        count, parent, edges = np.zeros(len(g), np.int64), np.arange(len(g)), []

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for a in range(0, len(g), 512):
            s = m[a : a + 512] @ m.T
            x, y = np.nonzero(s >= threshold)
            x = x + a
            ok = (x < y) & ((i == j) | (block[x] != block[y]))
            x, y = x[ok], y[ok]
            for c in range(0, len(x), 100_000):
                p, q = x[c : c + 100_000], y[c : c + 100_000]
                first = np.full(len(p), np.iinfo(np.int64).max)
                for col in range(width):
                    mine = own[p, col]
                    shared = (own[q] == mine[:, None]).any(1) & (mine >= 0)
                    first = np.where(shared, np.minimum(first, mine), first)
                here = first == leaf_key
                p, q = p[here], q[here]
                np.add.at(count, p, times[q])
                np.add.at(count, q, times[p])
                for u, v in zip(p.tolist(), q.tolist()):
                    ru, rv = root(u), root(v)
                    if ru != rv:
                        parent[max(ru, rv)] = min(ru, rv)
                        edges.append((u, v))
        hit = np.flatnonzero(count)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"rep": np.concatenate([rep[hit], rep[e[:, 0]]]), "linked": np.concatenate([count[hit], np.zeros(len(e), np.int64)]), "v": np.concatenate([np.full(len(hit), -1), rep[e[:, 1]]]), "is_edge": np.concatenate([np.zeros(len(hit), bool), np.ones(len(e), bool)])})

    out = staged(cut.groupBy("label", "leaf", "i", "j").applyInPandas(compare, "rep long, linked long, v long, is_edge boolean"), "links")
    counts = out.where("not is_edge").groupBy("rep").agg(F.sum("linked").alias("linked"))
    return counts, out.where("is_edge").select(F.col("rep").alias("u"), "v")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector of (vec_id, embedding, label)."""
    ok = V.usable(F.col("embedding")) & (V.norm(F.col("embedding")) > 0) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(ok, F.lit(False)).alias("ok"))
    same = rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"))
    distinct = staged(same.select("rep", "label", "times", "embedding"), "distinct")
    counts, edges = links(distinct, threshold, **options)
    found = components(edges)
    info = distinct.join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = rows.where("ok").join(info, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

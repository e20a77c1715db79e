"""K-means by Lloyd's steps: assignment on Arrow batches, new centroids as sums that each task adds up first.

The start is k-means||: candidates are drawn from all vectors, by squared distance, in a few rounds; the driver chooses
among them by k-means++, weighted with the vectors that are nearest to each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.operators.vectors import assert_model_size, lists, matrix, nearest_centroid
from unitloom.storage import materialize, release

#: Rounds of drawing candidates at least, and candidates a round as a multiple of k.
ROUNDS, OVERSAMPLING = 5, 1.0


def step(vectors: DataFrame, vec: str, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """New centroids (an empty cluster keeps its own), cluster sizes, and the total squared distance before."""
    assert_model_size(centroids)
    norms = np.einsum("ij,ij->i", centroids, centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, cost = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                x = matrix(b.column(0).slice(at, 1024))
                d = norms - 2 * x @ centroids.T + np.einsum("ij,ij->i", x, x)[:, None]
                best = d.argmin(axis=1)
                np.add.at(total, best, x)
                count += np.bincount(best, minlength=len(centroids))
                cost += np.bincount(best, weights=np.maximum(0, d.min(axis=1)), minlength=len(centroids))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), lists(total[seen]) if len(seen) else pa.array([], pa.list_(pa.float64())), pa.array(count[seen]), pa.array(cost[seen])], ["cluster", "total", "n", "cost"])

    parts = vectors.select(vec).mapInArrow(sums, "cluster long, total array<double>, n long, cost double")
    added = parts.groupBy("cluster").applyInArrow(_added, parts.schema).toArrow().combine_chunks()  # a row a cluster, as large as the model
    out, sizes = centroids.copy(), np.zeros(len(centroids), dtype=np.int64)
    if not added.num_rows:
        return out, sizes, 0.0
    at, n = added.column("cluster").to_numpy(), added.column("n").to_numpy()
    out[at] = matrix(added.column("total").chunk(0)) / n[:, None]
    sizes[at] = n
    return out, sizes, float(added.column("cost").to_numpy().sum())


def _added(parts: pa.Table) -> pa.Table:
    """The sum of a cluster's parts, one from each task."""
    parts = parts.combine_chunks()
    total = matrix(parts.column("total").chunk(0)).sum(axis=0)
    return pa.table({"cluster": parts.column("cluster")[:1], "total": lists(total[None]), "n": [int(parts.column("n").to_numpy().sum())], "cost": [float(parts.column("cost").to_numpy().sum())]})


def _nearer(state: DataFrame, fresh: np.ndarray, first: int) -> DataFrame:
    """state (id, vec, near, far) after the candidates ``fresh``, which are numbered from ``first`` on."""
    norms = np.einsum("ij,ij->i", fresh, fresh)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, near, far = matrix(part.column(1)), part.column(2).to_numpy(), part.column(3).to_numpy()
                best = (norms - 2 * x @ fresh.T).argmin(axis=1)
                d = ((x - fresh[best]) ** 2).sum(axis=1)  # exact, so nothing is left of a candidate itself
                closer = d < far
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.where(closer, best + first, near)), pa.array(np.where(closer, d, far))], schema=part.schema)

    return state.mapInArrow(compare, state.schema)


def initial(vectors: DataFrame, ident: str, vec: str, k: int, seed: int = 42) -> np.ndarray:
    """k-means|| over all vectors. A vector's draws are hashes of its id, the seed and the round."""
    state = materialize(vectors.select(F.col(ident).alias("id"), F.col(vec).cast("array<double>").alias("vec"), F.lit(-1).cast("long").alias("near"), F.lit(float("inf")).alias("far")), "kmeans")
    n = state.count()
    if n < k:
        raise ValueError(f"{n} vectors for {k} clusters")
    fresh = np.array([r.vec for r in state.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vec").limit(1).collect()], dtype=np.float64)
    found, round_ = fresh, 0
    while True:
        closer = materialize(_nearer(state, assert_model_size(fresh), len(found) - len(fresh)), "kmeans")
        release(state)
        state, round_ = closer, round_ + 1
        cost = state.agg(F.sum("far")).first()[0]
        if not cost > 0 or (round_ > ROUNDS and len(found) >= k):
            break
        draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(round_)), 11) / F.lit(float(1 << 53))
        drawn = state.where(draw * cost < F.col("far") * (OVERSAMPLING * k)).orderBy("id").select("vec").collect()
        drawn = drawn or state.orderBy(F.desc("far"), "id").select("vec").limit(1).collect()
        fresh = np.array([r.vec for r in drawn], dtype=np.float64)
        found = np.concatenate([found, fresh])
    weights = np.zeros(len(found))
    for r in state.groupBy("near").count().collect():
        weights[r.near] = r["count"]
    release(state)
    return _chosen(found, weights, k, np.random.default_rng(seed))


def _chosen(x: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++; where fewer than k rows differ, some are chosen again."""
    chosen = [int(rng.choice(len(x), p=weights / weights.sum()))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        mass = far * weights
        if not mass.sum() > 0:
            mass = far if far.sum() > 0 else np.ones(len(x))
        chosen.append(int(rng.choice(len(x), p=mass / mass.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def train(vectors: DataFrame, ident: str, vec: str, k: int, rounds: int = 15, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Centroids after ``rounds`` steps, and the cost before each."""
    centroids, costs = initial(vectors, ident, vec, k, seed), []
    for _ in range(rounds):
        centroids, _, cost = step(vectors, vec, centroids)
        costs.append(cost)
    return centroids, costs


def clusters(vectors: DataFrame, vec: str, centroids: np.ndarray) -> DataFrame:
    return nearest_centroid(vectors, vec, centroids, np.arange(len(centroids)))

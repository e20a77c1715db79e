"""Vector operators: standardising, PCA, exact cosine joins, nearest centroids, label votes.

Dense arithmetic runs on Arrow batches in double precision. The joins compare blocks: each side is dealt into blocks of
bounded size by a hash of the id, and a task takes one pair of blocks, so neither side is broadcast and nothing is
compared on the driver. Only models (a mean and scale for each dimension, components, centroids) travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Rows of a block at most, about; a task holds two blocks and a part of their products.
BLOCK = 16384
#: Bytes of a model that tasks may carry.
MODEL_BYTES = 256 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix in double precision."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row stays zero."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm == 0, 1, norm)[:, None]


def lists(x: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))


def assert_model_size(x: np.ndarray) -> np.ndarray:
    if x.nbytes > MODEL_BYTES:
        raise ValueError(f"a model of {x.nbytes} bytes; tasks carry {MODEL_BYTES} at most")
    return x


def scan_validate(vectors: DataFrame, vec: str) -> DataFrame:
    """One row: how many vectors, their least and largest length, and how many values are null or not finite."""
    v = F.col(vec).cast("array<double>")
    odd = F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return vectors.agg(F.count("*").alias("n"), F.min(F.size(v)).alias("least_dim"), F.max(F.size(v)).alias("most_dim"), F.sum(odd).alias("odd_values"))


def scaler_fit(vectors: DataFrame, vec: str) -> DataFrame:
    """(dim, mean, scale): means and population deviations. Tasks return a row a dimension, with the mean and the squares around it."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, 0.0, 0.0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = matrix(b.column(0).slice(at, 4096))
                own = x.mean(axis=0)
                apart = own - mean
                square = square + ((x - own) ** 2).sum(axis=0) + apart**2 * (n * len(x) / (n + len(x)))
                mean = mean + apart * (len(x) / (n + len(x)))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean), dtype=np.int32)), pa.array(np.full(len(mean), float(n))), pa.array(mean), pa.array(square)], ["dim", "n", "m", "s"])

    parts = vectors.select(vec).where(F.col(vec).isNotNull()).mapInArrow(moments, "dim int, n double, m double, s double")
    whole = parts.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("dim")) / F.sum("n").over(Window.partitionBy("dim")))
    square = F.sum(F.col("s") + F.col("n") * (F.col("m") - F.col("mean")) ** 2)
    return whole.groupBy("dim").agg(F.max("mean").alias("mean"), F.sqrt(square / F.sum("n")).alias("scale"))


def scaler_model(fitted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and divisor of each dimension (a row each); without spread the divisor is 1."""
    rows = sorted(fitted.collect(), key=lambda r: r["dim"])
    scale = np.array([r["scale"] for r in rows])
    return np.array([r["mean"] for r in rows]), np.where(scale == 0, 1.0, scale)


def _mapped(vectors: DataFrame, vec: str, apply, to: str) -> DataFrame:
    """vectors with column ``to``: ``apply`` on each batch's matrix."""
    names = vectors.drop(to).columns
    schema = StructType([*vectors.drop(to).schema, StructField(to, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = lists(np.ascontiguousarray(apply(matrix(b.column(vec)))))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), made], [*names, to])

    return vectors.mapInArrow(run, schema)


def standardized(vectors: DataFrame, vec: str, model: tuple[np.ndarray, np.ndarray], to: str = "scaled") -> DataFrame:
    mean, scale = model
    return _mapped(vectors, vec, lambda x: (x - mean) / scale, to)


def pca_fit(vectors: DataFrame, vec: str, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components as rows). Tasks return their sums and products (dim squared numbers each), the driver solves.

    A component's sign is fixed: its loading of largest size is positive.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.ones(b.num_rows), matrix(b.column(0))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            r, c = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(total.ravel())], ["r", "c", "x"])

    sums = vectors.select(vec).mapInArrow(products, "r long, c long, x double").groupBy("r", "c").agg(F.sum("x").alias("x")).collect()
    size = max((row.r for row in sums), default=-1) + 1
    if size < 2:
        raise ValueError("no vectors")
    gram = np.zeros((size, size))
    for row in sums:
        gram[row.r, row.c] = row.x
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    _, basis = np.linalg.eigh((cov + cov.T) / 2)
    top = basis[:, ::-1][:, :components].T
    sign = np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])
    return mean, top * np.where(sign == 0, 1, sign)[:, None]


def projected(vectors: DataFrame, vec: str, model: tuple[np.ndarray, np.ndarray], to: str = "projected") -> DataFrame:
    mean, top = model
    return _mapped(vectors, vec, lambda x: (x - mean) @ top.T, to)


def _blocks(rows: DataFrame, ident: str, vec: str, n: int, side: str) -> DataFrame:
    return rows.select(F.col(ident).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(ident), F.lit(n)).cast("int").alias("block"), F.lit(side).alias("side"))


def _block_count(rows: DataFrame, block: int) -> int:
    n = rows.count()
    return max(-(-n // block), 3 if n > 1024 else 1)  # a few tasks for small tables too


def _pairs_of_blocks(queries: DataFrame, others: DataFrame | None, ident: str, vec: str, block: int) -> DataFrame:
    """Rows with ``task``: every pair of blocks of the two sides; of one side, (i, j) for i <= j."""
    n = _block_count(queries, block)
    q = _blocks(queries, ident, vec, n, "q")
    if others is None:
        mates = F.sequence(F.lit(0), F.lit(n - 1))
        spread = q.withColumn("mate", F.explode(mates))
        return spread.withColumn("task", F.struct(F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j")))
    m = _block_count(others, block)
    o = _blocks(others, ident, vec, m, "o")
    a = q.withColumn("mate", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("task", F.struct(F.col("block").alias("i"), F.col("mate").alias("j")))
    b = o.withColumn("mate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("task", F.struct(F.col("mate").alias("i"), F.col("block").alias("j")))
    return a.unionByName(b)


def _sides(task: pd.DataFrame, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    task = task.sort_values("id", kind="stable")
    x = unit_rows(np.array(task.v.tolist(), dtype=np.float64))
    ids = task.id.to_numpy()
    if single:
        i, j = task.task.iloc[0]["i"], task.task.iloc[0]["j"]
        a, b = task.block.to_numpy() == i, task.block.to_numpy() == j
    else:
        a, b = task.side.to_numpy() == "q", task.side.to_numpy() == "o"
    return ids[a], x[a], ids[b], x[b]


def cosine_edges(vectors: DataFrame, ident: str, vec: str, least: float, block: int = BLOCK) -> DataFrame:
    """(src, dst, weight) of all pairs src < dst with cosine >= least. A task emits links only, never all pairs."""

    def compare(task: pd.DataFrame) -> pd.DataFrame:
        ids, x, others, y = _sides(task, True)
        found = []
        for at in range(0, len(ids), 512):
            sims = x[at : at + 512] @ y.T
            r, c = np.nonzero(sims >= least)
            a, b = ids[at + r], others[c]
            once = a < b if len(ids) == len(others) and (ids == others).all() else a != b
            found.append(pd.DataFrame({"src": np.minimum(a, b)[once], "dst": np.maximum(a, b)[once], "weight": sims[r, c][once]}))
        return pd.concat(found) if found else pd.DataFrame({"src": [], "dst": [], "weight": []})

    return _pairs_of_blocks(vectors, None, ident, vec, block).groupBy("task").applyInPandas(compare, "src long, dst long, weight double")


def best_of(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, least: float) -> pd.DataFrame:
    """(id, other, sim): for each row of x the k rows of y of largest product (ties by id), never itself; others ascend."""
    found = []
    for at in range(0, len(ids), 512):
        sims = x[at : at + 512] @ y.T
        sims[ids[at : at + 512][:, None] == others[None]] = -np.inf
        if sims.shape[1] > k:
            cut = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
            r, c = np.nonzero((sims >= cut[:, None]) & (sims >= least))
        else:
            r, c = np.nonzero(sims >= least)
        order = np.lexsort((others[c], -sims[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[place < k], c[place < k]
        found.append(pd.DataFrame({"id": ids[at + r], "other": others[c], "sim": sims[r, c]}))
    return pd.concat(found) if found else pd.DataFrame({"id": [], "other": [], "sim": []})


def nearest(queries: DataFrame, references: DataFrame, ident: str, vec: str, k: int, least: float = -2.0, block: int = BLOCK) -> DataFrame:
    """(id, other, sim, rn): each query's k references of largest cosine (ties by id), never itself.

    Each task keeps k candidates a query; a window merges them.
    """

    def compare(task: pd.DataFrame) -> pd.DataFrame:
        return best_of(*_sides(task, False), k, least)

    candidates = _pairs_of_blocks(queries, references, ident, vec, block).groupBy("task").applyInPandas(compare, "id long, other long, sim double")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return candidates.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def knn_edges(vectors: DataFrame, ident: str, vec: str, k: int, least: float = 0.0) -> DataFrame:
    """(src, dst, weight): undirected edges from each vector to its k nearest others with cosine >= least."""
    found = nearest(vectors, vectors, ident, vec, k, least)
    return found.groupBy(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).agg(F.max("sim").alias("weight"))


def nearest_centroid(vectors: DataFrame, vec: str, centroids: np.ndarray, names: np.ndarray, to: str = "cluster") -> DataFrame:
    """vectors with the name of the nearest centroid (Euclidean; ties: the first) and the squared distance to it."""
    assert_model_size(centroids)
    own = vectors.drop(to, "distance").columns
    schema = StructType([*vectors.drop(to, "distance").schema, StructField(to, LongType()), StructField("distance", DoubleType())])
    norms = np.einsum("ij,ij->i", centroids, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, least = [], []
            for at in range(0, b.num_rows, 1024):
                x = matrix(b.column(vec).slice(at, 1024))
                d = norms - 2 * x @ centroids.T + np.einsum("ij,ij->i", x, x)[:, None]
                best.append(d.argmin(axis=1))
                least.append(np.maximum(0, d.min(axis=1)))
            if best:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(names[np.concatenate(best)]), pa.array(np.concatenate(least))], [*own, to, "distance"])

    return vectors.mapInArrow(run, schema)


def majority_vote(neighbours: DataFrame, k: int) -> DataFrame:
    """(id, label) of neighbours (id, rn, label): k = 1 the nearest; k = 3 two of three, else the nearest; else the commonest, ties the smallest."""
    near = neighbours.where(F.col("rn") <= k)
    if k == 1:
        return near.select("id", "label")
    counts = near.groupBy("id", "label").agg(F.count("*").alias("n"), F.min("rn").alias("first"))
    tie = "first" if k == 3 else "label"
    w = Window.partitionBy("id").orderBy(F.desc("n"), tie)
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "label")

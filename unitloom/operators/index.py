"""Approximate nearest neighbours by an inverted file: references are filed under their nearest centroid, a query looks into the
cells of its ``probes`` nearest ones. More probes find more of the exact neighbours; as many as there are cells find all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitloom.operators import kmeans
from unitloom.operators.vectors import BLOCK, assert_model_size, best_of, matrix, unit_rows
from unitloom.storage import materialize

PROBES = 16


def centroids(references: DataFrame, ident: str, vec: str, cells: int | None = None, rounds: int = 5, seed: int = 42) -> np.ndarray:
    """Unit centroids of the references, about as many as the square root of their number, by K-means over all of them."""
    n = references.count()
    cells = min(cells or max(1, round(n**0.5)), n)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit_rows(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "vec"])

    rows = references.select(F.col(ident).cast("long").alias("id"), F.col(vec).alias("vec")).mapInArrow(unit, "id long, vec array<double>")
    return unit_rows(kmeans.train(materialize(rows, "unit"), "id", "vec", cells, rounds, seed)[0])


def _filed(rows: DataFrame, ident: str, vec: str, centers: np.ndarray, probes: int) -> DataFrame:
    """(id, v, cell): a row for each of the probes nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(assert_model_size(centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sims = unit_rows(matrix(part.column(1))) @ y.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                picked = part.take(pa.array(np.repeat(np.arange(part.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(near.ravel().astype(np.int64))], ["id", "v", "cell"])

    return rows.select(F.col(ident).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "id long, v array<double>, cell long")


def nearest_probed(queries: DataFrame, references: DataFrame, ident: str, vec: str, k: int, centers: np.ndarray, probes: int = PROBES, least: float = -2.0, block: int = BLOCK) -> DataFrame:
    """(id, other, sim, rn) as of `vectors.nearest`, among the references in each query's cells. Cells of over ``block`` rows of a
    side are cut into blocks, and every pair of blocks is a task, so a cell that holds a third of all is many of them."""
    q = materialize(_filed(queries, ident, vec, centers, min(probes, len(centers))), "probes")
    r = materialize(_filed(references, ident, vec, centers, 1), "cells")
    sizes = [side.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name)) for side, name in ((q, "nq"), (r, "nr"))]
    blocks = F.broadcast(sizes[0].join(sizes[1], "cell"))  # a row a centroid at most

    def dealt(side: DataFrame, name: str, own: str, mates: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        spread = side.join(blocks, "cell").withColumn("mine", mine).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col(mates) - 1)))
        i, j = ("mine", "mate") if name == "q" else ("mate", "mine")
        return spread.select(F.struct("cell", F.col(i).alias("i"), F.col(j).alias("j")).alias("task"), F.lit(name).alias("side"), "id", "v")

    def compare(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values("id", kind="stable")
        x, ids, asks = unit_rows(np.array(task.v.tolist(), dtype=np.float64)), task.id.to_numpy(), (task.side == "q").to_numpy()
        return best_of(ids[asks], x[asks], ids[~asks], x[~asks], k, least)

    found = dealt(q, "q", "nq", "nr").unionByName(dealt(r, "o", "nr", "nq")).groupBy("task").applyInPandas(compare, "id long, other long, sim double")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def recall(exact: DataFrame, found: DataFrame) -> float:
    """The share of exact (id, other) pairs that are found."""
    both = exact.select("id", "other").join(found.select("id", "other", F.lit(True).alias("hit")), ["id", "other"], "left")
    return float(both.agg(F.coalesce(F.avg(F.col("hit").isNotNull().cast("double")), F.lit(1.0))).first()[0])

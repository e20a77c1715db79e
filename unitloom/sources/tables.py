"""Tables of runs and models: CSV logs with a growing set of columns, model tables, artefacts that are written once."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from unitloom.operators.runs import appended
from unitloom.storage import hadoop_path, materialize


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def append_to_log(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Add rows to a CSV log: the union of old and new columns, written anew beside it; then the two change places.

    The old log is gone only when the new one stands. Should that be broken off in between, the next call finds the old one
    beside the path and takes it back. A log that cannot be read or joined is an error, and stays as it is.
    """
    path = path.rstrip("/")
    store, log = hadoop_path(spark, path)
    old, new = hadoop_path(spark, f"{path}.old")[1], hadoop_path(spark, f"{path}.new-{uuid.uuid4().hex}")[1]
    if not store.exists(log) and store.exists(old):
        _renamed(store, old, log)
    there = store.exists(log)
    whole = materialize(appended(read_log(spark, path), rows) if there else rows, "log")
    whole.coalesce(1).write.option("header", True).csv(new.toString())
    if there:
        store.delete(old, True)
        _renamed(store, log, old)
    _renamed(store, new, log)
    store.delete(old, True)
    return whole


def _renamed(store, a, b) -> None:
    if not store.rename(a, b):
        raise OSError(f"{a.toString()} could not be renamed to {b.toString()}")


def write_scaler(fitted: DataFrame, path: str) -> None:
    fitted.write.mode("overwrite").parquet(path)


def write_matrix(spark: SparkSession, x: np.ndarray, path: str) -> None:
    """A model's rows as (row, vec)."""
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row long, vec array<double>").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.vec for r in spark.read.parquet(path).orderBy("row").collect()], dtype=np.float64)


def write_once(rows: DataFrame, path: str) -> None:
    """Artefacts of a run: nothing is written if the folder is there."""
    rows.write.mode("ignore").parquet(path)

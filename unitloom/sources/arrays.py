"""`.npy` matrices, one file an utterance, as tables, and tables as `.npy` files. Files are read and written by the executors.

Files are listed and read by Spark (binaryFile), so any store that Spark reaches will do; the key of a file is its path below
the root without the extension.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = 10_000


def files(spark: SparkSession, root: str, extension: str = ".npy") -> DataFrame:
    """(utt, content): files below the root, an error if there are none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(root)
    if not found.inputFiles():
        raise FileNotFoundError(f"no {extension} file in {root}")
    return found.select(key_of(F.col("path"), root, extension).alias("utt"), "path", "content")


def key_of(path: Column, root: str, extension: str) -> Column:
    """The path below the root, without its extension. Of a root with wildcards, the part before the first of them counts
    as the root, so the names that it stands for (the datasets) are part of the key."""
    fixed = re.split(r"[*?\[{]", root)[0]
    root = root if fixed == root else fixed[: fixed.rindex("/") + 1]
    below = root.split("://", 1)[-1].rstrip("/") + "/"
    short = F.substring_index(path, below, -1)
    return F.substring(short, F.lit(1), F.length(short) - len(extension))


def features(spark: SparkSession, root: str) -> DataFrame:
    """(utt, seg_idx, vec) of two-dimensional matrices that all have as many columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for utt, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim != 2:
                    raise ValueError(f"{utt}: {x.ndim} dimensions, not 2")
                for at in range(0, len(x), _BATCH):
                    part = np.ascontiguousarray(x[at : at + _BATCH], dtype=np.float32)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * x.shape[1], pa.int32()), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([utt] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int64()), vec], ["utt", "seg_idx", "vec"])

    return files(spark, root).select("utt", "content").mapInArrow(run, "utt string, seg_idx long, vec array<float>")


def segments(spark: SparkSession, root: str) -> DataFrame:
    """(utt, seg_idx, start_frame, end_frame, unit_id) of matrices of three columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for utt, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim != 2 or x.shape[1] != 3:
                    raise ValueError(f"{utt}: shape {x.shape}, not (n, 3)")
                x = x.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([utt] * len(x), pa.string()), pa.array(np.arange(len(x))), *(pa.array(x[:, k]) for k in range(3))], ["utt", "seg_idx", "start_frame", "end_frame", "unit_id"])

    return files(spark, root).select("utt", "content").mapInArrow(run, "utt string, seg_idx long, start_frame long, end_frame long, unit_id long")


def write_segments(rows: DataFrame, root: str) -> DataFrame:
    """Write (utt, seg_idx, start_frame, end_frame, unit_id) as one `.npy` an utterance under ``root``; see `_written`."""
    return _written(rows, root, 3, lambda pdf: pdf[["start_frame", "end_frame", "unit_id"]].to_numpy(dtype=np.int64))


def write_features(rows: DataFrame, root: str) -> DataFrame:
    """Write (utt, seg_idx, vec) as one single-precision `.npy` an utterance under ``root``; see `_written`."""
    return _written(rows, root, None, lambda pdf: np.array(pdf["vec"].tolist(), dtype=np.float32))


def _written(rows: DataFrame, root: str, columns: int | None, matrix: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """(utt, n_rows); using it runs the write. ``root`` is a path that all executors share or a URI of a store that Arrow reaches;
    another scheme is an error here. Files that are complete are left alone; a file is whole or not there."""
    _store(root)  # fails on the driver, before anything is written

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        store, base = _store(root)
        path, pdf = f"{base}/{key[0]}.npy", pdf.sort_values("seg_idx")
        if not complete(f"{root.rstrip('/')}/{key[0]}.npy", len(pdf), columns):
            part = f"{path}.{uuid.uuid4().hex}.part"
            store.create_dir(os.path.dirname(path), recursive=True)
            held = io.BytesIO()
            np.save(held, matrix(pdf))
            with store.open_output_stream(part) as f:
                f.write(held.getvalue())
            store.move(part, path)
        return pd.DataFrame({"utt": [key[0]], "n_rows": [len(pdf)]})

    return rows.groupBy("utt").applyInPandas(run, "utt string, n_rows long")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path there."""
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), uri.rstrip("/")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/")
    try:
        store, path = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    except pa.ArrowInvalid as e:
        raise ValueError(f"no store for {uri}") from e
    return store, path.rstrip("/")


def complete(path: str, rows: int, columns: int | None = 3) -> bool:
    """Whether a file is there, loads, and has as many rows and columns (None: any)."""
    store, at = _store(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return False
    try:
        with store.open_input_stream(at) as f:
            x = np.load(io.BytesIO(f.read()), allow_pickle=False)
    except (ValueError, EOFError):
        return False
    return x.ndim == 2 and len(x) == rows and columns in (None, x.shape[1])

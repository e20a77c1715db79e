"""Session settings and intermediate tables that survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where the setting is absent."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        known = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
        root = known or "file://" + tempfile.mkdtemp(prefix="unitloom-")
        sc.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and every executor sees the rows.

    The files stay until the session's process ends (results are lazy, so an earlier end is not known).
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/unitloom/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean)
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def release(df: DataFrame) -> None:
    """Delete the table behind a frame returned by `materialize`; its rows must not be needed any more."""
    for known in [x for x in _written if x[1] == df.written_to]:
        _delete(*known)
        _written.remove(known)


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system that Spark uses for a path, and the path there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    store, target = hadoop_path(spark, path)
    store.delete(target, True)


def clean() -> None:
    """Delete every intermediate table written so far (at the end of the process)."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

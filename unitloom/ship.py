"""What Python workers need: the package's source, where they do not see the driver's folders, and batches of bounded size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch of rows handed to a Python worker. Spark's own bound is 64 MB, which each task holds several times over
#: (buffers that grow by doubling, the worker's copy, the batch before it); a batch of long texts needs no more than this.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_sent: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send the source, and bound the batches unless the session or the application sets a size of its own."""
    ship(spark)
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Once an application, hand the package to Spark, which serves it to every worker, those started later included."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="unitloom-source-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/unitloom.zip", "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/unitloom.zip")
    _sent.add(app)

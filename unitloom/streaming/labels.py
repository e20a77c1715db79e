"""Incremental label inference: new files of vectors are labelled as they come, each once.

The stream's checkpoint remembers which files are done, so a restart goes on where it stopped. A micro-batch is labelled by
the same function as a table, so results do not depend on how files are batched. Its rows go to a folder named by the
batch, which is replaced if the batch is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def label_stream(spark: SparkSession, source: str, schema: StructType, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Label all files that ``source`` has, and end. Call it again for newer ones."""
    vectors = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        label(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return vectors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

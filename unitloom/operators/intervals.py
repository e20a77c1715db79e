"""Interval and sequence operators: running bounds, islands, range joins, first rows of groups, global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds_from_durations(rows: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """rows with start and end: running sums of the durations within each key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(duration).over(w).cast("long")).withColumn("start", (F.col("end") - F.col(duration)).cast("long"))


def unit_table(rows: DataFrame, key: str, order: str, duration: str, unit: str, padding: Column) -> DataFrame:
    """(key, seg_idx, start, end, unit) of the rows that are no padding; bounds and numbers are of what is left."""
    real = bounds_from_durations(rows.where(~padding), key, order, duration)
    w = Window.partitionBy(key).orderBy(order)
    return real.select(key, (F.row_number().over(w) - 1).cast("long").alias("seg_idx"), "start", "end", F.col(unit).alias("unit_id"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_width: int) -> DataFrame:
    """Pairs of rows with one key whose ranges overlap: each begins before the other ends.

    left: (key, start, end, ...); right: (key, r_start, r_end, ...). Both are filed under the bins they touch, so a key with a
    long time line is many join keys; a pair is kept in the bin where the later one begins, so none comes twice.
    """

    def filed(rows: DataFrame, start: str, end: str) -> DataFrame:
        last = F.greatest(F.floor((F.col(end) - 1) / bin_width), F.floor(F.col(start) / bin_width))
        return rows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), last)))

    r = filed(right, "r_start", "r_end").withColumnsRenamed({key: "__key", "__bin": "__r_bin"})
    l = filed(left, "start", "end")  # noqa: E741
    shares = (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    begins = F.floor(F.greatest("start", "r_start") / bin_width) == F.col("__bin")
    return l.join(r, (F.col(key) == F.col("__key")) & (F.col("__bin") == F.col("__r_bin")) & shares & begins).drop("__key", "__bin", "__r_bin")


def islands(rows: DataFrame, key: str, order: Sequence[str], inside: Column) -> DataFrame:
    """The rows that are inside, with ``island``: a number from 1 for each unbroken stretch of them in a key."""
    w = Window.partitionBy(key).orderBy(*order)
    begins = (inside & ~F.coalesce(F.lag(inside).over(w), F.lit(False))).cast("int")
    return rows.withColumn("__in", inside).withColumn("__begins", begins).withColumn("island", F.sum("__begins").over(w).cast("long")).where("__in").drop("__in", "__begins")


def first_of_each(rows: DataFrame, group: str, order: Sequence[str], most: int) -> DataFrame:
    """The first rows of each group. Spark keeps only ``most`` rows of a group from each task before it shuffles."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= most)


def with_row_ids(rows: DataFrame, file: str, position: str) -> DataFrame:
    """rows with row_id: files in path order (by path components), rows in file order, without a global sort of rows."""
    sizes = rows.groupBy(file).agg(F.count("*").alias("__n"))  # one row a file
    w = Window.orderBy(F.split(F.col(file).cast("string"), "/"), file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(file).alias("__file"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    return rows.join(offsets, F.col(file) == F.col("__file")).withColumn("row_id", (F.col("__before") + F.col(position)).cast("long")).drop("__file", "__before")


def paired(left: DataFrame, right: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Inner join by key after keeping, of right rows with one key, the last in order; keys missing on a side are left out."""
    payload = F.struct(*[c for c in right.columns if c != key])
    last = right.groupBy(key).agg(F.max_by(payload, F.struct(*order)).alias("__p")).select(key, "__p.*")
    return left.join(last, key)


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def paired_strictly(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full pairing by key: an error if a key stands on one side only."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), key, "full_outer")
    checked = F.assert_true(F.col("__l").isNotNull() & F.col("__r").isNotNull(), "a key has no counterpart")
    return both.where(checked.isNull()).drop("__l", "__r")

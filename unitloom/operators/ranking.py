"""Ranks over a whole table without a global window: rows are dealt by range, and numbered by partition offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitloom.storage import materialize

_LOW = (1 << 33) - 1


def with_rank(rows: DataFrame, order: Sequence[Column], to: str = "rank") -> DataFrame:
    """rows with column ``to``: 0, 1, 2 ... along ``order``, which should leave no ties that matter.

    The numbering is written once, so the range bounds that Spark samples are the same for offsets and rows. The driver gets one
    count a partition.
    """
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33).cast("int"))
    sizes = {r[0]: r[1] for r in dealt.groupBy("__part").count().collect()}
    before, n = [], 0
    for part in sorted(sizes):
        before.append((part, n))
        n += sizes[part]
    offsets = rows.sparkSession.createDataFrame(before, "__p int, __before long")
    ranked = dealt.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return ranked.withColumn(to, F.col("__before") + F.col("__at").bitwiseAND(_LOW)).drop("__at", "__part", "__p", "__before")


def rank_frequency(counts: DataFrame, *groups: str) -> DataFrame:
    """counts (groups, name, n) with rank (from 1; by n, ties by name) and probability within the groups."""
    ranked = with_rank(counts, [*(F.col(g).asc() for g in groups), F.desc("n"), F.asc("name")])
    totals = ranked.groupBy(*[F.col(g).alias(f"__{g}") for g in groups]).agg(F.min("rank").alias("__first"), F.sum("n").alias("__total"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    joined = ranked.join(F.broadcast(totals), same) if not groups else ranked.join(totals, same)
    return joined.select(*counts.columns, (F.col("rank") - F.col("__first") + 1).alias("rank"), F.round(F.col("n") / F.col("__total"), 9).alias("probability"))

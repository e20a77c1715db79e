"""Consistency of discovered units with reference sequences: PAcc, iPAcc, wNES, iwNES and their F1.

Input is (cluster, code): a row a segment with a non-empty sequence, code being the encoded sequence. All metrics first count
(cluster, code), so pairs are compared once however often they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.functions.scalars import f1, normalized_distance
from unitloom.storage import materialize

#: Distinct sequences of a cluster that are compared with as many others in one join key.
BLOCK = 1024


def counted(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster", "code").agg(F.count("*").alias("n"))


def pacc(counts: DataFrame) -> DataFrame:
    """One row: 1 - mean distance to the cluster's modal sequence by its length; of tied modes the longest with the least total."""
    top = counts.groupBy("cluster").agg(F.max(F.struct("n", F.length("code").alias("size"))).alias("top"))  # commonest, then longest
    modes = counts.join(top, "cluster").where((F.col("n") == F.col("top.n")) & (F.length("code") == F.col("top.size"))).select(F.col("cluster").alias("c"), F.col("code").alias("mode"))
    total = counts.join(modes, F.col("cluster") == F.col("c")).groupBy("cluster", "mode").agg((F.sum(F.levenshtein("code", "mode") * F.col("n")) / F.length("mode")).alias("d"), F.sum("n").alias("n"))
    best = total.groupBy("cluster").agg(F.min("d").alias("d"), F.max("n").alias("n"))
    return best.agg((1 - F.coalesce(F.sum("d") / F.sum("n"), F.lit(0.0))).alias("pacc"))


def ipacc(counts: DataFrame) -> DataFrame:
    """One row: share of the commonest cluster in each type that occurs more than once; 1 without such a type."""
    types = counts.groupBy("code").agg(F.sum("n").alias("n"), F.max("n").alias("top")).where("n > 1")
    return types.agg(F.coalesce(F.sum("top") / F.sum("n"), F.lit(1.0)).alias("ipacc"))


def wnes(counts: DataFrame) -> DataFrame:
    """One row: 1 - mean normalised distance of a cluster's pairs, weighted by its size; single segments count as 0.

    A cluster's distinct sequences are dealt into blocks of about ``BLOCK`` by hash, and each pair of blocks is a join key of its
    own, so the pairs of a large cluster are many tasks.
    """
    blocks = counts.groupBy(F.col("cluster").alias("k")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = counts.join(blocks, F.col("cluster") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("own", "mate"), "high": F.greatest("own", "mate")})
    a = dealt.select("cluster", "low", "high", "own", F.col("code").alias("x"), F.col("n").alias("nx"))
    b = dealt.select(F.col("cluster").alias("c"), F.col("low").alias("l"), F.col("high").alias("h"), F.col("own").alias("other"), F.col("code").alias("y"), F.col("n").alias("ny"))
    meet = (F.col("cluster") == F.col("c")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))
    once = (F.col("own") != F.col("other")) | (F.col("low") == F.col("high"))
    pairs = a.join(b, meet & once & (F.col("x") < F.col("y")))
    sums = pairs.groupBy("cluster").agg(F.sum(normalized_distance(F.col("x"), F.col("y")) * F.col("nx") * F.col("ny")).alias("s"))
    sizes = counts.groupBy("cluster").agg(F.sum("n").alias("n"))
    weighed = sizes.join(sums, "cluster", "left").select("n", F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) * 2 / (F.col("n") - 1)).otherwise(0.0).alias("d"))
    return weighed.agg((1 - F.coalesce(F.sum("d") / F.sum("n"), F.lit(0.0))).alias("wnes"))


def iwnes(counts: DataFrame) -> DataFrame:
    """One row: the same for the clusters of each sequence; two labels are equal or wholly different, so it has a closed form."""
    types = counts.groupBy("code").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("n > 1")
    return types.agg(F.coalesce(F.sum(F.col("same") / (F.col("n") - 1)) / F.sum("n"), F.lit(1.0)).alias("iwnes"))


def cardinalities(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """One row; labels: segments with a sequence, segments: (utt, cluster) of all of them."""
    own = labels.agg(F.count("*").alias("num_segments"), F.countDistinct("cluster").alias("num_clusters"), F.countDistinct("code").alias("num_gold_types"))
    every = segments.agg(F.countDistinct("utt").alias("num_utterances"), F.countDistinct("cluster").alias("num_clusters_all"))
    return own.join(every)


def clustering_metrics(labels: DataFrame, segments: DataFrame, compute_nes: bool = True) -> DataFrame:
    """The metrics row: joins of one-row aggregates. Without compute_nes the pairwise scores are NaN."""
    labels = materialize(labels, "labels")
    counts = materialize(counted(labels), "counts")
    row = cardinalities(labels, segments).join(pacc(counts)).join(ipacc(counts))
    row = row.withColumn("f1_pacc", f1(F.col("pacc"), F.col("ipacc")))
    if not compute_nes:
        return row.withColumns({c: F.lit(float("nan")) for c in ("wnes", "iwnes", "f1_wnes")})
    return row.join(wnes(counts)).join(iwnes(counts)).withColumn("f1_wnes", f1(F.col("wnes"), F.col("iwnes")))

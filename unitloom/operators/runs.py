"""Run names, registry lookups, resumption, evaluation logs and reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENT = ("wnes", "pacc", "iwnes", "ipacc", "f1_wnes")


def run_name(clustering: Column, neighbours: Column, min_sim: Column, resolution: Column, clusters: Column, runtime: Column, ram: Column) -> Column:
    """The name of a run: graph runs with their edges, threshold and resolution; results only where all three are known."""
    graph = F.concat(F.when(neighbours.isNull(), "_full").otherwise(F.concat(F.lit("_knn_"), neighbours.cast("string"))), F.lit("_tau_"), min_sim.cast("string"), F.lit("_gamma_"), F.format_string("%.4f", resolution))
    told = F.concat(F.lit("_clusters_"), clusters.cast("string"), F.lit("_runtime_"), runtime.cast("string"), F.lit("_peakram_"), ram.cast("string"))
    return F.concat(clustering, F.when(clustering == "graph", graph).otherwise(""), F.coalesce(told, F.lit("")))


def parsed(path: Column) -> Column:
    """struct(clustering, num_neighbours, min_sim, resolution, k_vote, ef_search) from a run's path."""
    part = F.split(F.element_at(F.split(path, "/"), -1), "_")
    at = lambda i: F.get(part, F.lit(i))
    inferred = path.contains("inferred_segments")
    knn = (at(0) == "graph") & (at(1) == "knn")
    full = (at(0) == "graph") & (at(1) == "full")
    kmeans = at(0).isin("kmeans", "kmeans++")
    vote = F.regexp_extract(path, r"(?:^|/)(knn_[^/]*)", 1)
    suffix = F.when(inferred, "_inferred").otherwise("")
    name = F.when(knn, F.concat(F.lit("graph_knn"), suffix)).when(full, "graph_full").when(kmeans, F.concat(F.lit("kmeans"), suffix))
    voted = knn & inferred & (vote != "")
    return F.struct(
        name.alias("clustering"),
        F.when(knn, at(2).try_cast("int")).alias("num_neighbours"),
        F.when(knn, at(4).try_cast("double")).when(full, at(3).try_cast("double")).alias("min_sim"),
        F.when(knn, at(6).try_cast("double")).when(full, at(5).try_cast("double")).alias("resolution"),
        F.when(voted, F.get(F.split(vote, "_"), F.lit(1)).try_cast("int")).alias("k_vote"),
        F.when(voted, F.element_at(F.split(vote, "_"), -1).try_cast("int")).alias("ef_search"),
    )


def latest(runs: DataFrame, name: str, like: str) -> DataFrame:
    """One row: the last run name in string order that fits the pattern."""
    return runs.where(F.col(name).like(like)).agg(F.max(name).alias("latest"))


def pending(expected: DataFrame, done: DataFrame, key: str = "utt", size: str = "n_rows") -> DataFrame:
    """Keys of expected (key, size) that done does not have with the same size."""
    return expected.join(done.select(key, size), [key, size], "left_anti")


def appended(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of both; a column that is text in one of them is text in all."""
    a, b = dict(log.dtypes), dict(rows.dtypes)
    text = [c for c in a.keys() & b.keys() if a[c] != b[c] and "string" in (a[c], b[c]) and "<" not in a[c] + b[c]]
    wide = lambda df: df.withColumns({c: F.col(c).cast("string") for c in text})
    return wide(log).unionByName(wide(rows), allowMissingColumns=True)


def sweep(settings: Sequence[Mapping[str, object]], run: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``run(**setting)`` for each setting in one table, with the settings as columns."""
    every = None
    for setting in settings:
        one = run(**setting).withColumns({name: F.lit(value) for name, value in setting.items()})
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return every


def report(log: DataFrame, most: int = 10) -> DataFrame:
    """The best runs by f1_wnes (unknown last, NaN among them), scores in percent, resources with two digits."""
    known = F.when(~F.isnan("f1_wnes"), F.col("f1_wnes"))
    best = log.orderBy(known.desc_nulls_last(), "run").limit(most)
    percent = {c: F.round(F.col(c) * 100, 2) for c in PERCENT if c in log.columns}
    return best.withColumns(percent | {c: F.round(c, 2) for c in ("runtime_seconds", "peak_ram_mb") if c in log.columns})


def parameter_sets(log: DataFrame) -> DataFrame:
    """(name, values): the distinct known values of each parameter, in order."""
    columns = {"num_neighbours": "K", "min_sim": "τ", "resolution": "γ"}
    pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in columns.values()]), F.array(*[F.col(c).cast("double") for c in columns]))).alias("name", "value")
    known = log.select(pairs).where("value is not null").distinct()
    return known.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("values"))


def metrics_view(metrics: DataFrame) -> DataFrame:
    """(name, shown): every known metric as text, scores in percent with two digits, counts with commas."""
    shown = []
    for name, kind in metrics.dtypes:
        c = F.col(name)
        text = F.when(~F.isnan(c), F.format_number(c * 100, 2)) if kind == "double" else F.format_number(c, 0)
        shown.append(F.struct(F.lit(name).alias("name"), text.alias("shown")))
    return metrics.select(F.explode(F.array(*shown)).alias("m")).select("m.*").where("shown is not null")

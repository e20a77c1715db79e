"""Queries over run names, logs and reports, with their SQL. The logs are small rows given here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.functions import scalars
from unitloom.operators import runs
from unitloom.plans import timeline
from unitloom.plans.sequence_queries import _tl
from unitloom.plans.sequence_queries import clustering_metrics as metrics

#: clustering, num_neighbours, min_sim, resolution, clusters, runtime, ram
RUNS = [
    ("graph", 100, 0.65, 0.11, 78978, 1326.82, 13979.0),
    ("graph", None, 0.55, 0.25, 512, 12.5, 801.25),
    ("graph", 5, 0.4, 0.5, None, 3.5, 90.5),
    ("kmeans++", None, None, None, 33902, 77.25, 1024.5),
    ("kmeans++", None, None, None, None, None, None),
]
PATHS = [
    "out/graph_knn_100_tau_0.65_gamma_0.1100_clusters_78978_runtime_1326.82_peakram_13979.0",
    "out/inferred_segments/knn_3_hnswm_32_search_256/graph_knn_100_tau_0.65_gamma_0.1100",
    "out/graph_full_tau_0.55_gamma_0.2500",
    "out/kmeans++_clusters_33902_runtime_77.25_peakram_1024.5",
    "out/inferred_segments/kmeans++_clusters_33902",
    "out/other",
]
#: run, clustering, num_neighbours, min_sim, resolution, wnes, iwnes, f1_wnes, pacc, ipacc, runtime_seconds, peak_ram_mb
LOG = [
    ("a", "graph_knn", 100, 0.65, 0.11, 0.51234, 0.4, 0.4492, 0.61, 0.5, 1326.823, 13979.041),
    ("b", "graph_full", None, 0.55, 0.25, 0.48125, 0.41, 0.4428, 0.6, 0.52, 12.555, 801.256),
    ("c", "kmeans", None, None, None, 0.4, 0.39, 0.39494, 0.55, 0.45, 77.25, 1024.5),
    ("d", "kmeans", None, None, None, None, None, None, 0.5, 0.4, 5.125, 99.0),
    ("e", "graph_knn", 50, 0.65, 0.25, 0.505, 0.405, 0.4495, 0.6125, 0.505, 900.0, 9000.0),
]
_LOG_TYPES = "run string, clustering string, num_neighbours int, min_sim double, resolution double, wnes double, iwnes double, f1_wnes double, pacc double, ipacc double, runtime_seconds double, peak_ram_mb double"


def _log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOG, _LOG_TYPES)


def run_name_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(RUNS, "clustering string, k int, tau double, gamma double, clusters long, runtime double, ram double")
    return rows.select(runs.run_name(*[F.col(c) for c in rows.columns]).alias("name"))


def run_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", runs.parsed(F.col("path")).alias("p")).select("path", "p.*")


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(spark.createDataFrame([(p,) for p in PATHS], "path string"), "path", "out/graph%")


def method_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in [*PATHS, "KMEANS_full", "full_kmeans"]], "path string")
    return rows.select("path", scalars.method_label(F.col("path")).alias("label"), scalars.method_color(F.col("path")).alias("color"))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_log(spark), 4)


def eval_param_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.parameter_sets(_log(spark)).select("name", F.array_join(F.transform("values", lambda v: F.format_string("%.4f", v)), ", ").alias("shown"))


def metrics_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics(spark, sf_dir).select("num_segments", "num_utterances", "num_clusters", "num_clusters_all", "num_gold_types")
    return runs.metrics_view(counts)


def pending_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose segments are not all labelled yet: every third has none, every fourth one too few."""
    expected = timeline.segments(spark, sf_dir).groupBy("utt").agg(F.count("*").alias("n_rows"))
    done = expected.where("utt % 3 <> 0").withColumn("n_rows", F.when(F.col("utt") % 4 == 0, F.col("n_rows") - 1).otherwise(F.col("n_rows")))
    return runs.pending(expected, done)


QUERIES = [run_name_encode, run_name_parse, latest_run, method_label, eval_report, eval_param_sets, metrics_view, pending_utterances]


def _values(rows: list[tuple], types: list[str]) -> str:
    def one(v, t: str) -> str:
        text = "NULL" if v is None else "'" + v + "'" if isinstance(v, str) else repr(v)
        return f"CAST({text} AS {t})"

    return "(VALUES " + ", ".join("(" + ", ".join(one(v, t) for v, t in zip(r, types, strict=True)) + ")" for r in rows) + ")"


_P = f"p AS (SELECT path, string_split(string_split(path, '/')[-1], '_') AS a, contains(path, 'inferred_segments') AS i, string_split(regexp_extract(path, '(?:^|/)(knn_[^/]*)', 1), '_') AS v FROM {_values([(p,) for p in PATHS], ['VARCHAR'])} t(path))"
_L = f"l AS (SELECT * FROM {_values(LOG, ['VARCHAR', 'VARCHAR', 'INTEGER', *['DOUBLE'] * 9])} t(run, clustering, num_neighbours, min_sim, resolution, wnes, iwnes, f1_wnes, pacc, ipacc, runtime_seconds, peak_ram_mb))"
SQL = {
    "run_name_encode": f"""
SELECT clustering || CASE WHEN clustering = 'graph' THEN CASE WHEN k IS NULL THEN '_full' ELSE '_knn_' || k END || '_tau_' || tau || '_gamma_' || printf('%.4f', gamma) ELSE '' END
       || coalesce('_clusters_' || clusters || '_runtime_' || runtime || '_peakram_' || ram, '') AS name
FROM {_values(RUNS, ['VARCHAR', 'INTEGER', 'DOUBLE', 'DOUBLE', 'BIGINT', 'DOUBLE', 'DOUBLE'])} t(clustering, k, tau, gamma, clusters, runtime, ram)""",
    "run_name_parse": f"""WITH {_P}, q AS (SELECT *, a[1] = 'graph' AND a[2] = 'knn' AS g, a[1] = 'graph' AND a[2] = 'full' AS f FROM p)
SELECT path, CASE WHEN g THEN 'graph_knn' || CASE WHEN i THEN '_inferred' ELSE '' END WHEN f THEN 'graph_full' WHEN a[1] IN ('kmeans', 'kmeans++') THEN 'kmeans' || CASE WHEN i THEN '_inferred' ELSE '' END END AS clustering,
       CASE WHEN g THEN TRY_CAST(a[3] AS INTEGER) END AS num_neighbours, CASE WHEN g THEN TRY_CAST(a[5] AS DOUBLE) WHEN f THEN TRY_CAST(a[4] AS DOUBLE) END AS min_sim,
       CASE WHEN g THEN TRY_CAST(a[7] AS DOUBLE) WHEN f THEN TRY_CAST(a[6] AS DOUBLE) END AS resolution,
       CASE WHEN g AND i THEN TRY_CAST(v[2] AS INTEGER) END AS k_vote, CASE WHEN g AND i THEN TRY_CAST(v[-1] AS INTEGER) END AS ef_search FROM q""",
    "latest_run": f"WITH {_P} SELECT max(path) AS latest FROM p WHERE path LIKE 'out/graph%'",
    "method_label": f"""
SELECT path, CASE WHEN contains(lower(path), 'kmeans') THEN 'K-means' WHEN contains(lower(path), 'full') THEN 'Full Graph' WHEN contains(lower(path), 'knn') THEN 'kNN Graph' ELSE 'Induced clusters' END AS label,
       CASE WHEN contains(path, 'full') THEN 'tab:blue' WHEN contains(path, 'kmeans') THEN 'tab:gray' WHEN contains(path, 'knn') THEN 'tab:orange' ELSE 'tab:green' END AS color
FROM {_values([(p,) for p in [*PATHS, "KMEANS_full", "full_kmeans"]], ['VARCHAR'])} t(path)""",
    "eval_report": f"""WITH {_L} SELECT run, clustering, num_neighbours, min_sim, resolution, round(wnes * 100, 2) AS wnes, round(iwnes * 100, 2) AS iwnes, round(f1_wnes * 100, 2) AS f1_wnes,
       round(pacc * 100, 2) AS pacc, round(ipacc * 100, 2) AS ipacc, round(runtime_seconds, 2) AS runtime_seconds, round(peak_ram_mb, 2) AS peak_ram_mb FROM l ORDER BY l.f1_wnes DESC NULLS LAST, run LIMIT 4""",
    "eval_param_sets": f"""WITH {_L}, u AS (SELECT DISTINCT * FROM (SELECT 'K' AS name, CAST(num_neighbours AS DOUBLE) AS v FROM l UNION ALL SELECT 'τ', min_sim FROM l UNION ALL SELECT 'γ', resolution FROM l) WHERE v IS NOT NULL)
SELECT name, string_agg(printf('%.4f', v), ', ' ORDER BY v) AS shown FROM u GROUP BY name""",
    "metrics_view": _tl("""
SELECT k AS name, format('{:,}', v) AS shown FROM (
  SELECT 'num_segments' AS k, (SELECT count(*) FROM lab) AS v UNION ALL SELECT 'num_utterances', (SELECT count(DISTINCT utt) FROM seg) UNION ALL SELECT 'num_clusters', (SELECT count(DISTINCT cluster) FROM lab)
  UNION ALL SELECT 'num_clusters_all', (SELECT count(DISTINCT cluster) FROM seg) UNION ALL SELECT 'num_gold_types', (SELECT count(DISTINCT code) FROM lab))"""),
    "pending_utterances": _tl("SELECT utt, count(*) AS n_rows FROM seg WHERE utt % 3 = 0 OR utt % 4 = 0 GROUP BY utt"),
}

"""Queries over vectors and their graphs, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.functions import scalars
from unitloom.operators import graph, index, infer, kmeans, leiden, runs, vectors
from unitloom.operators.intervals import with_row_ids
from unitloom.storage import checkpoint_root, materialize, read_table
from unitloom.streaming.labels import label_stream

TAU, TAU_SPARSE, GAMMA, K = 0.35, 0.40, 0.11, 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


def _long(rows: DataFrame, ident: str, vec: str) -> DataFrame:
    return rows.select(ident, F.posexplode(vec).alias("dim", "x")).select(ident, "dim", F.round("x", 6).alias("x"))


def scan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.scan_validate(read_table(spark, sf_dir, "embeddings"), "embedding")


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir).withColumn("u", scalars.l2_normalized(F.col("vec"))), "vec_id", "u")


def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.scaler_fit(_vectors(spark, sf_dir), "vec").select("dim", F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale"))


def scaler_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _long(vectors.standardized(v, "vec", vectors.scaler_model(vectors.scaler_fit(v, "vec"))), "vec_id", "scaled")


def _pca(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    v = _vectors(spark, sf_dir)
    scaled = vectors.standardized(v, "vec", vectors.scaler_model(vectors.scaler_fit(v, "vec")))
    return scaled, vectors.pca_fit(scaled, "scaled", 16)


def pca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (_, top) = _pca(spark, sf_dir)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(top)], "component int, vec array<double>")


def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, model = _pca(spark, sf_dir)
    return vectors.projected(scaled, "scaled", model).select("vec_id", "projected")


def _edges(spark: SparkSession, sf_dir: str, least: float = TAU) -> DataFrame:
    return vectors.cosine_edges(_vectors(spark, sf_dir), "vec_id", "vec", least)


def _rounded(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.round("weight", 9).alias("weight"))


def cosine_threshold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_edges(spark, sf_dir))


def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.knn_edges(_vectors(spark, sf_dir), "vec_id", "vec", K))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(_vectors(spark, sf_dir), _edges(spark, sf_dir)).withColumn("avg_degree", F.round("avg_degree", 9))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.degrees(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id")), _edges(spark, sf_dir))
    return found.withColumn("strength", F.round("strength", 9))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_edges(spark, sf_dir))


def cpm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return leiden.cpm_quality(member, _edges(spark, sf_dir), GAMMA).select(F.round("quality", 6).alias("quality"), "clusters")


def leiden_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leiden.communities(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id")), materialize(_edges(spark, sf_dir, TAU_SPARSE), "edges"), GAMMA)


def resolution_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"))
    found = leiden.resolution_search(v, _edges(spark, sf_dir, TAU_SPARSE), target=int(0.93 * v.count()), tolerance=5)
    return spark.createDataFrame([(found.point, int(found.value), int(found.difference))], "resolution double, clusters long, difference long")


def _means(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector of each label: ten, the initial centroids of the fixtures."""
    sums = _vectors(spark, sf_dir).select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x")).collect()
    names = sorted({r.label for r in sums})
    out = np.zeros((len(names), max(r.dim for r in sums) + 1))
    for r in sums:
        out[names.index(r.label), r.dim] = r.x
    return out, np.array(names)


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.nearest_centroid(_vectors(spark, sf_dir), "vec", *_means(spark, sf_dir))
    return found.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, names = _means(spark, sf_dir)
    moved, _, _ = kmeans.step(_vectors(spark, sf_dir), "vec", start)
    rows = spark.createDataFrame([(int(n), [float(x) for x in r]) for n, r in zip(names, moved, strict=True)], "cluster long, vec array<double>")
    return _long(rows, "cluster", "vec")


def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    found, _ = kmeans.train(v, "vec_id", "vec", 10)
    return kmeans.clusters(v, "vec", found).select("vec_id", "cluster")


def knn_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against all others: the labels of its nearest ones (a vector is never its own reference)."""
    v = _vectors(spark, sf_dir)
    near = vectors.nearest(v, v, "vec_id", "vec", K)
    return near.join(v.select(F.col("vec_id").alias("other"), "label"), "other").select("id", "other", F.col("rn").cast("long").alias("rn"), F.round("sim", 9).alias("sim"), "label")


def _vote(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return vectors.majority_vote(knn_label_join(spark, sf_dir).select("id", "rn", "label"), k)


def majority_vote_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vote(spark, sf_dir, 1)


def majority_vote_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vote(spark, sf_dir, 3)


def majority_vote_k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vote(spark, sf_dir, 10)


def subsample_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subsample(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id", 0.3)


def subsample(rows: DataFrame, ident: str, fraction: float, seed: int = 42, method: str = "hash") -> DataFrame:
    """int(fraction * n) rows without replacement: those of least hash, or those that numpy's generator draws (by row order of id)."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    n = rows.count()
    if method == "numpy":  # the driver draws row numbers, as many as are kept
        chosen = np.random.default_rng(seed).choice(n, size=int(fraction * n), replace=False)
        ids = rows.sparkSession.createDataFrame([(int(i),) for i in sorted(chosen)], f"`{ident}` long")
    else:
        ids = rows.select(ident, F.md5(F.concat(F.lit(f"{seed}/"), F.col(ident).cast("string"))).alias("h")).orderBy("h", ident).limit(int(fraction * n)).select(ident)
    return rows.join(ids, ident, "left_semi")


def apply_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the label of their row_id, where the membership has one."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    numbered = with_row_ids(rows.withColumn("file", F.format_string("%012d", "conv_id")), "file", "turn")
    member = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("unit_id"))
    return numbered.join(member, "row_id").select("row_id", "conv_id", "turn", "unit_id")


def rms_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir).withColumn("samples", scalars.rms_normalized(F.col("vec"))), "vec_id", "samples")


def knn_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of knn_label_join by the approximate index: half of the cells are looked into."""
    v = _vectors(spark, sf_dir)
    centers = index.centroids(v, "vec_id", "vec")
    near = index.nearest_probed(v, v, "vec_id", "vec", K, centers, probes=-(-len(centers) // 2))
    return near.select("id", "other", F.col("rn").cast("long").alias("rn"), F.round("sim", 9).alias("sim"))


def sweep_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference for each of a few numbers of neighbours, and how many labels it gets right, in one table."""
    near = materialize(knn_label_join(spark, sf_dir).select("id", "rn", "label"), "neighbours")
    known = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("own"))

    def run(k_neighbors: int) -> DataFrame:
        return vectors.majority_vote(near, k_neighbors).join(known, "id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("own")).alias("right"))

    return runs.sweep([{"k_neighbors": k} for k in (1, 2, 3, 5, 10)], run)


def stream_infer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of majority_vote_k3, computed by the incremental form."""
    v = _vectors(spark, sf_dir)
    root = materialize(v, "queries")
    folder = root.inputFiles()[0].rsplit("/", 1)[0]
    base = f"{checkpoint_root(spark)}/unitloom/stream-{folder.rsplit('-', 1)[-1]}"
    label = infer.infer("graph_knn", references=v, ident="vec_id", vec="vec", label="label", k=3)
    label_stream(spark, folder, v.schema, label, f"{base}/out", f"{base}/checkpoint", files_per_batch=1).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "label")


QUERIES = [
    scan_validate, l2_normalize, scaler_fit, scaler_transform, pca_fit, pca_transform, cosine_threshold_edges, knn_edges, graph_stats, graph_degree, graph_components, cpm_quality, leiden_clusters,
    resolution_search, nearest_centroid, kmeans_step, kmeans_train, knn_label_join, majority_vote_k1, majority_vote_k3, majority_vote_k10, subsample_semi, apply_membership, rms_normalize, knn_probed, sweep_union, stream_infer_labels,
]

_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_X = "x AS (SELECT vec_id, label, CAST(unnest(range(len(e))) AS INTEGER) AS dim, unnest(e) AS x FROM v)"
_E = f"ed AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.e, b.e) AS weight FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {TAU})"
_NEAR = f"""
s AS (SELECT q.vec_id AS id, r.vec_id AS other, r.label AS label, list_cosine_similarity(q.e, r.e) AS sim FROM v q JOIN v r ON q.vec_id <> r.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rn FROM s) WHERE rn <= {K})
"""
_C = """
m AS (SELECT label, dim, avg(x) AS x FROM x GROUP BY label, dim),
d AS (SELECT x.vec_id, m.label, sum((x.x - m.x) * (x.x - m.x)) AS d FROM x JOIN m ON x.dim = m.dim GROUP BY x.vec_id, m.label),
near AS (SELECT vec_id, CAST(label AS BIGINT) AS cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d) WHERE r = 1)
"""


def _voted(k: int, tie: str) -> str:
    return f"""WITH {_V}, {_NEAR}, c AS (SELECT id, label, count(*) AS n, min(rn) AS first FROM nn WHERE rn <= {k} GROUP BY id, label)
SELECT id, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, {tie}) AS r FROM c) WHERE r = 1"""


SQL = {
    "scan_validate": "SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS least_dim, CAST(max(len(embedding)) AS INTEGER) AS most_dim, CAST(sum(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))) AS BIGINT) AS odd_values FROM embeddings",
    "l2_normalize": f"WITH {_V}, {_X}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM x GROUP BY vec_id) SELECT vec_id, dim, round(CASE WHEN n = 0 THEN 0 ELSE x / n END, 6) AS x FROM x JOIN n USING (vec_id)",
    "scaler_fit": f"WITH {_V}, {_X} SELECT dim, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS scale FROM x GROUP BY dim",
    "scaler_transform": f"WITH {_V}, {_X}, f AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY dim) SELECT vec_id, dim, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS x FROM x JOIN f USING (dim)",
    "cosine_threshold_edges": f"WITH {_V}, {_E} SELECT src, dst, round(weight, 9) AS weight FROM ed",
    "knn_edges": f"""WITH {_V}, s AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rn FROM s) WHERE rn <= {K} AND sim >= 0)
SELECT least(id, other) AS src, greatest(id, other) AS dst, round(max(sim), 9) AS weight FROM nn GROUP BY 1, 2""",
    "graph_stats": f"WITH {_V}, {_E} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM ed) AS edges, round(2 * (SELECT count(*) FROM ed) / (SELECT count(*) FROM v), 9) AS avg_degree",
    "graph_degree": f"WITH {_V}, {_E}, n AS (SELECT id, count(*) AS degree, sum(weight) AS strength FROM (SELECT src AS id, weight FROM ed UNION ALL SELECT dst, weight FROM ed) GROUP BY id) SELECT vec_id AS id, coalesce(degree, 0) AS degree, round(coalesce(strength, 0), 9) AS strength FROM v LEFT JOIN n ON vec_id = id",
    "graph_components": f"WITH RECURSIVE {_V}, {_E}, b AS (SELECT src AS x, dst AS y FROM ed UNION ALL SELECT dst, src FROM ed), reach(x, y) AS (SELECT x, y FROM b UNION SELECT reach.x, b.y FROM reach JOIN b ON reach.y = b.x) SELECT x AS node, least(x, min(y)) AS component FROM reach GROUP BY x",
    "cpm_quality": f"WITH {_V}, {_E} SELECT round((SELECT coalesce(sum(weight), 0) FROM ed JOIN v a ON a.vec_id = src JOIN v b ON b.vec_id = dst WHERE a.label = b.label) - {GAMMA}::DOUBLE * sum(n * (n - 1) / 2), 6) AS quality, count(*) AS clusters FROM (SELECT label, count(*) AS n FROM v GROUP BY label)",
    "nearest_centroid": f"WITH {_V}, {_X}, {_C} SELECT vec_id, cluster, round(d, 6) AS distance FROM near",
    "kmeans_step": f"WITH {_V}, {_X}, {_C}, z AS (SELECT cluster, dim, avg(x) AS x FROM x JOIN near USING (vec_id) GROUP BY cluster, dim) SELECT CAST(m.label AS BIGINT) AS cluster, m.dim, round(coalesce(z.x, m.x), 6) AS x FROM m LEFT JOIN z ON z.cluster = m.label AND z.dim = m.dim",
    "knn_label_join": f"WITH {_V}, {_NEAR} SELECT id, other, rn, round(sim, 9) AS sim, CAST(label AS BIGINT) AS label FROM nn",
    "majority_vote_k1": f"WITH {_V}, {_NEAR} SELECT id, CAST(label AS BIGINT) AS label FROM nn WHERE rn = 1",
    "majority_vote_k3": _voted(3, "first"),
    "majority_vote_k10": _voted(10, "label"),
    "stream_infer_labels": _voted(3, "first"),
    "sweep_union": " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k_neighbors, count(*) AS n, count(*) FILTER (WHERE o.label = e.label) AS \"right\" FROM ({_voted(k, 'first' if k == 3 else 'label')}) o JOIN embeddings e ON e.vec_id = o.id" for k in (1, 2, 3, 5, 10)),
    "rms_normalize": f"WITH {_V}, {_X}, r AS (SELECT vec_id, sqrt(sum(x * x) / count(*)) AS r FROM x GROUP BY vec_id) SELECT vec_id, dim, round(CASE WHEN r > 1e-8 THEN x * (0.1::DOUBLE / r) ELSE x END, 6) AS x FROM x JOIN r USING (vec_id)",
    "subsample_semi": "SELECT vec_id, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (ORDER BY md5('42/' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= CAST(floor(0.3 * (SELECT count(*) FROM embeddings)) AS BIGINT)",
    "apply_membership": "WITH c AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id FROM conversations) SELECT row_id, conv_id, turn, CAST(label AS BIGINT) AS unit_id FROM c JOIN embeddings ON vec_id = row_id",
}

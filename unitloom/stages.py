"""The stages over folders of arrays and annotations: models, graph or k-means training, inference, evaluation, reports.

Each stage is a function of a session and a configuration; `python -m unitloom STAGE --option value` runs it. A run's
folder holds its labelled segments, its reference table (row_id, vec, label) or centroids, and a record of what was asked
and measured, so a later stage reads one folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.functions.encoding import encoded
from unitloom.functions.scalars import FRAME_RATE, cleaned, frame_to_sample, method_label, overlaps
from unitloom.operators import agreement, boundaries, intervals, kmeans, leiden, runs, vectors
from unitloom.operators.infer import Preparation, infer
from unitloom.operators.ranking import rank_frequency
from unitloom.sources import arrays, tables, textgrid
from unitloom.storage import hadoop_path, materialize
from unitloom.track import Usage, tracked

BIN = 64


@dataclass
class ModelsConfig:
    features_dir: str
    output_dir: str
    number_of_components: int = 350


@dataclass
class EdgesConfig:
    num_neighbors: int | None = None  # None: all pairs
    min_sim: float = 0.0


@dataclass
class ClusterConfig:
    cluster_count_target: int | None = None
    cluster_count_tolerance: int = 10
    resolution_specified: float | None = None
    resolution_init_low: float = 0.0
    resolution_init_high: float = 1.0
    search_max_iterations: int = 15
    search_worker_count: int = 4
    leiden_iterations: int = 1
    seed: int = 42


@dataclass
class TrainConfig:
    features_dir: str
    segments_dir: str
    output_dir: str = "output/clustering"
    models_dir: str | None = None  # None: vectors as they are
    subsample: float | None = None
    subsample_seed: int = 42
    subsample_cache: str | None = None  # a folder that keeps the prepared subsample for later runs
    num_clusters: int = 10_000  # k-means only
    edges: EdgesConfig = field(default_factory=EdgesConfig)
    cluster: ClusterConfig = field(default_factory=ClusterConfig)


@dataclass
class InferConfig:
    clustering_method: str  # graph_knn, kmeans++ or kmeans
    run_dir: str
    features_dir: str
    segments_dir: str
    output_dir: str
    models_dir: str | None = None
    k_neighbors: int = 3


@dataclass
class EvaluateConfig:
    segments_dir: str
    textgrid_dir: str
    compute_nes: bool = False
    tier: str = "phones"
    csv_path: str | None = None


@dataclass
class BoundaryConfig:
    segments_dir: str
    textgrid_dir: str
    constant_shift: float = 0.0
    tolerance: float = 0.05
    tier: str = "syllables"


@dataclass
class SweepConfig:
    clustering_method: str
    run_dir: str
    features_dir: str
    segments_dir: str
    textgrid_dir: str
    output_dir: str
    k_neighbors: str = "1,3,10"
    models_dir: str | None = None
    compute_nes: bool = False
    tier: str = "phones"
    csv_path: str | None = None


@dataclass
class ChainConfig:
    train: TrainConfig
    textgrid_dir: str | None = None
    clustering_method: str = "graph_knn"
    run_dir: str | None = None
    number_of_components: int = 350
    k_neighbors: int = 3
    compute_nes: bool = False
    tier: str = "phones"
    csv_path: str | None = None
    models: bool = True
    training: bool = True
    inference: bool = True
    evaluation: bool = True


def fit_models(spark: SparkSession, config: ModelsConfig) -> Preparation:
    rows = materialize(arrays.features(spark, config.features_dir).withColumn("vec", F.col("vec").cast("array<double>")), "features")
    fitted = vectors.scaler_fit(rows, "vec")
    scaler = vectors.scaler_model(fitted)
    pca = vectors.pca_fit(vectors.standardized(rows, "vec", scaler), "scaled", config.number_of_components)
    tables.write_matrix(spark, np.vstack(scaler), f"{config.output_dir}/scaler")
    tables.write_matrix(spark, np.vstack([pca[0][None], pca[1]]), f"{config.output_dir}/pca")
    return Preparation(scaler, pca)


def read_models(spark: SparkSession, folder: str | None) -> Preparation:
    if folder is None:
        return Preparation()
    scaler, pca = tables.read_matrix(spark, f"{folder}/scaler"), tables.read_matrix(spark, f"{folder}/pca")
    return Preparation((scaler[0], scaler[1]), (pca[0], pca[1:]))


def _prepared(spark: SparkSession, config: TrainConfig) -> DataFrame:
    """(utt, seg_idx, row_id, vec): prepared vectors, of the subsample if one is asked for."""
    if config.subsample is not None and config.subsample_cache:
        store, at = hadoop_path(spark, config.subsample_cache)
        if store.exists(at):
            return spark.read.parquet(config.subsample_cache)
    rows = intervals.with_row_ids(arrays.features(spark, config.features_dir), "utt", "seg_idx").withColumn("vec", F.col("vec").cast("array<double>"))
    rows = materialize(read_models(spark, config.models_dir).apply(rows, "vec"), "prepared")
    if config.subsample is None:
        return rows
    from unitloom.plans.vector_queries import subsample

    chosen = materialize(subsample(rows, "row_id", config.subsample, config.subsample_seed, "numpy"), "subsample")
    if config.subsample_cache:
        tables.write_once(chosen, config.subsample_cache)
    return chosen


def checked_segments(spark: SparkSession, features: DataFrame, segments_dir: str) -> DataFrame:
    """Segments, an error if an utterance with vectors has none or another number of them."""
    segments = arrays.segments(spark, segments_dir)
    a = features.groupBy("utt").agg(F.count("*").alias("n_vectors"))
    b = segments.groupBy("utt").agg(F.count("*").alias("n_segments"))
    odd = a.join(b, "utt", "left").where(~F.col("n_vectors").eqNullSafe(F.col("n_segments")))
    if (first := odd.first()) is not None:
        raise ValueError(f"{first.utt}: {first.n_vectors} vectors and {first.n_segments} segments")
    return segments


def _finish(spark: SparkSession, config: TrainConfig, name: str, rows: DataFrame, member: DataFrame, record: dict) -> str:
    """Write the labelled segments, the reference table and the record of a run; returns its folder."""
    out = f"{config.output_dir}/{name}"
    labels = rows.join(member.select(F.col("id").alias("row_id"), F.col("cluster").alias("label")), "row_id")
    tables.write_once(labels.select("row_id", "vec", "label"), f"{out}/reference")
    segments = arrays.segments(spark, config.segments_dir).join(labels.select("utt", "seg_idx", "label"), ["utt", "seg_idx"])
    arrays.write_segments(segments.withColumn("unit_id", F.col("label")), f"{out}/segments").count()
    spark.createDataFrame([record]).write.mode("overwrite").json(f"{out}/record")
    return out


def _name(spark: SparkSession, kind: str, k: int | None, tau: float | None, gamma: float | None, clusters: int, usage: Usage) -> str:
    row = spark.createDataFrame([(kind, k, tau, gamma, clusters, round(usage.seconds, 2), round(usage.peak_mb, 1))], "a string, k int, tau double, gamma double, n long, s double, m double")
    return row.select(runs.run_name(*[F.col(c) for c in row.columns])).first()[0]


def _graph_communities(ids: DataFrame, edges: DataFrame, c: ClusterConfig) -> tuple[DataFrame, float]:
    if c.cluster_count_target is None:
        if c.resolution_specified is None:
            raise ValueError("give a resolution, a number of clusters, or both")
        return leiden.communities(ids, edges, c.resolution_specified, c.leiden_iterations, c.seed), c.resolution_specified
    low, high = c.resolution_init_low, c.resolution_init_high
    if c.resolution_specified is not None:
        low, high = max(0.0, c.resolution_specified - 0.1), c.resolution_specified + 0.1
    found = leiden.resolution_search(ids, edges, c.cluster_count_target, c.cluster_count_tolerance, low, high, c.search_max_iterations, c.search_worker_count, c.leiden_iterations, c.seed)
    return found.state, found.point


def train_graph(spark: SparkSession, config: TrainConfig) -> str:
    rows, e = _prepared(spark, config), config.edges
    if not config.subsample:
        checked_segments(spark, rows, config.segments_dir)
    with tracked() as usage:
        if e.num_neighbors is None:
            edges = vectors.cosine_edges(rows, "row_id", "vec", e.min_sim)
        else:
            edges = vectors.knn_edges(rows, "row_id", "vec", e.num_neighbors, e.min_sim)
        member, gamma = _graph_communities(rows.select(F.col("row_id").alias("id")), materialize(edges, "edges"), config.cluster)
        member = materialize(member, "membership")
        n = member.select("cluster").distinct().count()
    name = _name(spark, "graph", e.num_neighbors, e.min_sim, gamma, n, usage)
    return _finish(spark, config, name, rows, member, {"clustering": "graph", "resolution": float(gamma), "clusters": n, "seconds": usage.seconds, "peak_mb": usage.peak_mb})


def train_kmeans(spark: SparkSession, config: TrainConfig) -> str:
    rows = _prepared(spark, config)
    with tracked() as usage:
        centroids, costs = kmeans.train(rows, "row_id", "vec", config.num_clusters, seed=config.cluster.seed)
        member = materialize(kmeans.clusters(rows.withColumnRenamed("row_id", "id"), "vec", centroids).select("id", "cluster"), "membership")
        n = member.select("cluster").distinct().count()
    record = {"clustering": "kmeans++", "num_clusters": config.num_clusters, "clusters": n, "seconds": usage.seconds, "peak_mb": usage.peak_mb, "cost": costs[-1]}
    out = _finish(spark, config, _name(spark, "kmeans++", None, None, None, n, usage), rows, member, record)
    tables.write_matrix(spark, centroids, f"{out}/centroids")
    return out


def infer_labels(spark: SparkSession, config: InferConfig) -> int:
    """Label the segments that are not labelled yet; returns how many utterances were written."""
    rows = arrays.features(spark, config.features_dir).withColumn("vec", F.col("vec").cast("array<double>"))
    expected = rows.groupBy("utt").agg(F.count("*").alias("n_rows"))
    try:
        done = arrays.segments(spark, config.output_dir).groupBy("utt").agg(F.count("*").alias("n_rows"))
        todo = runs.pending(expected, done)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, FileNotFoundError):
            raise
        todo = expected
    segments = checked_segments(spark, rows, config.segments_dir)
    numbered = intervals.with_row_ids(rows.join(todo.select("utt"), "utt", "left_semi"), "utt", "seg_idx")
    queries = materialize(read_models(spark, config.models_dir).apply(numbered, "vec"), "queries")
    if config.clustering_method == "graph_knn":
        # queries and references are numbered apart: a query never is its own reference
        references = spark.read.parquet(f"{config.run_dir}/reference").withColumn("row_id", -1 - F.col("row_id"))
        label = infer("graph_knn", references=references, ident="row_id", vec="vec", label="label", k=config.k_neighbors)
        found = label(queries).select(F.col("id").alias("row_id"), "label")
    else:
        found = infer(config.clustering_method, vec="vec", centroids=tables.read_matrix(spark, f"{config.run_dir}/centroids"))(queries).select("row_id", "label")
    labelled = queries.join(found, "row_id").select("utt", "seg_idx", "label")
    return arrays.write_segments(segments.join(labelled, ["utt", "seg_idx"]).withColumn("unit_id", F.col("label")), config.output_dir).count()


def stem(column: Column) -> Column:
    return F.element_at(F.split(column, "/"), -1)


def labelled_sequences(spark: SparkSession, segments_dir: str, textgrid_dir: str, tier: str = "phones") -> tuple[DataFrame, DataFrame]:
    """Segments (utt, seg_idx, cluster) of utterances that have annotations, and those with a non-empty sequence (phones, code).

    Utterances pair by the last part of their path; of annotations with one name the last counts.
    """
    ticks = lambda c: F.round(F.col(c) * 100).cast("long")
    notes = textgrid.intervals(spark, textgrid_dir, tier)
    last = notes.groupBy(stem(F.col("utt")).alias("s")).agg(F.max(F.struct(F.split("utt", "/").alias("p"), "utt"))["utt"].alias("last"))
    gold = notes.join(last, F.col("utt") == F.col("last")).select(F.col("s").alias("utt"), "idx", ticks("start_time").alias("r_start"), ticks("end_time").alias("r_end"), "text")
    per_tick = 100 // FRAME_RATE
    own = arrays.segments(spark, segments_dir).select(stem(F.col("utt")).alias("utt"), F.col("utt").alias("path"), "seg_idx", (F.col("start_frame") * per_tick).alias("start"), (F.col("end_frame") * per_tick).alias("end"), F.col("unit_id").alias("cluster"))
    own = materialize(own.join(last.select(F.col("s").alias("utt")), "utt", "left_semi"), "segments")
    pairs = intervals.overlap_join(own, gold, "utt", BIN).where(overlaps(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end")))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("r_start", "idx", "text"))), lambda x: x["text"])
    found = pairs.groupBy("path", "seg_idx", "cluster").agg(cleaned(texts).alias("phones")).where(F.size("phones") > 0)
    return own, encoded(materialize(found, "sequences"), "phones", "code")


def evaluate(spark: SparkSession, config: EvaluateConfig) -> DataFrame:
    own, labels = labelled_sequences(spark, config.segments_dir, config.textgrid_dir, config.tier)
    row = agreement.clustering_metrics(labels, own.withColumnRenamed("utt", "stem").withColumnRenamed("path", "utt"), config.compute_nes)
    known = row.withColumn("run", F.lit(config.segments_dir.rstrip("/").removesuffix("/segments"))).withColumn("p", runs.parsed(F.col("run"))).select("*", "p.*").drop("p")
    if config.csv_path:
        tables.append_to_log(spark, config.csv_path, known)
    return known


def evaluate_boundaries(spark: SparkSession, config: BoundaryConfig) -> DataFrame:
    """Boundary metrics of folders that hold the same utterances; an error if one stands on a side only."""
    ticks = lambda c: F.round(F.col(c) * 100).cast("long")
    gold = textgrid.intervals(spark, config.textgrid_dir, config.tier).select(stem(F.col("utt")).alias("utt"), "idx", ticks("start_time").alias("start"), ticks("end_time").alias("end"), "text")
    own = arrays.segments(spark, config.segments_dir).withColumn("utt", stem(F.col("utt")))
    names = intervals.paired_strictly(own.select("utt").distinct(), gold.select("utt").distinct(), "utt")
    names.count()  # fails here if a name has no counterpart
    shift = round(config.constant_shift * 100)
    at = lambda c: (F.col(c) * (100 // FRAME_RATE) + shift).alias("at")
    cuts = own.select("utt", at("start_frame")).unionByName(own.groupBy("utt").agg(F.max_by("end_frame", "seg_idx").alias("end_frame")).select("utt", at("end_frame")))
    return boundaries.boundary_metrics(gold, cuts, round(config.tolerance * 100))


def sweep(spark: SparkSession, config: SweepConfig) -> DataFrame:
    """Inference and evaluation for each number of neighbours; one row each, in the log too if there is one."""

    def run(k_neighbors: int) -> DataFrame:
        out = f"{config.output_dir}/knn_{k_neighbors}"
        infer_labels(spark, InferConfig(config.clustering_method, config.run_dir, config.features_dir, config.segments_dir, out, config.models_dir, k_neighbors))
        return evaluate(spark, EvaluateConfig(out, config.textgrid_dir, config.compute_nes, config.tier, config.csv_path))

    return runs.sweep([{"k_neighbors": int(k)} for k in config.k_neighbors.split(",")], run)


def chain(spark: SparkSession, config: ChainConfig) -> DataFrame | str:
    """The stages that are switched on, one after the other: models, training, inference on the same folders, evaluation of what was made last."""
    t, run_dir = config.train, config.run_dir
    if config.models:
        t.models_dir = t.models_dir or f"{t.output_dir}/models"
        fit_models(spark, ModelsConfig(t.features_dir, t.models_dir, config.number_of_components))
    if config.training:
        run_dir = (train_kmeans if config.clustering_method.startswith("kmeans") else train_graph)(spark, t)
    if run_dir is None:
        raise ValueError("without training a run's folder is needed")
    made = f"{run_dir}/segments"
    if config.inference:
        made = f"{t.output_dir}/inferred_segments/knn_{config.k_neighbors}/{run_dir.rstrip('/').rsplit('/', 1)[-1]}"
        infer_labels(spark, InferConfig(config.clustering_method, run_dir, t.features_dir, t.segments_dir, made, t.models_dir, config.k_neighbors))
    if config.evaluation:
        return evaluate(spark, EvaluateConfig(made, config.textgrid_dir, config.compute_nes, config.tier, config.csv_path))
    return made


def report(spark: SparkSession, eval_path: str, top_n: int = 10) -> DataFrame:
    return runs.report(tables.read_log(spark, eval_path), top_n)


def zipf(spark: SparkSession, segments_dir: str, textgrid_dir: str, run_name: str) -> DataFrame:
    """Rank-frequency rows of the clusters and of one to three tokens in a row: (method, name, n, rank, probability)."""
    from unitloom.plans.sequence_queries import ngram_counts

    own, labels = labelled_sequences(spark, segments_dir, textgrid_dir)
    clusters = own.groupBy(F.col("cluster").cast("string").alias("name")).agg(F.count("*").alias("n")).withColumn("method", method_label(F.lit(run_name)))
    grams = ngram_counts(labels).select(F.col("gram").alias("name"), "n", F.concat(F.lit("phones "), F.col("order").cast("string")).alias("method"))
    return rank_frequency(clusters.unionByName(grams), "method")


def examples(spark: SparkSession, segments_dir: str, top_k: int = 5, examples_per_cluster: int = 100, sample_rate: int = 16_000) -> DataFrame:
    """The first examples of the largest clusters, with the samples they span in their recording."""
    own = arrays.segments(spark, segments_dir)
    order = F.struct(F.split("utt", "/"), "seg_idx")
    largest = own.groupBy("unit_id").agg(F.count("*").alias("size"), F.min(order).alias("first")).orderBy(F.desc("size"), "first").limit(top_k)
    rows = own.join(F.broadcast(largest.select("unit_id", "size")), "unit_id").withColumn("parts", F.split("utt", "/"))
    best = intervals.first_of_each(rows, "unit_id", ["parts", "seg_idx"], examples_per_cluster)
    return best.select(F.col("unit_id").alias("cluster"), "size", "rn", "utt", frame_to_sample(F.col("start_frame"), sample_rate).alias("first_sample"), frame_to_sample(F.col("end_frame"), sample_rate).alias("end_sample"))

"""The stages from files to scores, on planted data: four units whose vectors and phones agree."""

import numpy as np
import pytest

from unitloom import __main__ as cli
from unitloom import stages

PHONES = ["AH1", "K", "IY0", "T"]


def grid(tmp, name, units, rng):
    """An utterance of segments of ten frames (0.2 s), its vectors and its annotation."""
    n = len(units)
    vec = np.eye(4)[units] * 5 + rng.normal(0, 0.1, (n, 4))
    for kind, x in (("features", vec.astype(np.float32)), ("segments", np.array([[10 * i, 10 * i + 10, 0] for i in range(n)]))):
        path = tmp / kind / f"{name}.npy"
        path.parent.mkdir(parents=True, exist_ok=True)
        np.save(path, x)
    lines = ['"ooTextFile"', '"TextGrid"', "0", f"{0.2 * n}", "<exists>", "2"]
    for tier in ("phones", "syllables"):
        lines += ['"IntervalTier"', f'"{tier}"', "0", f"{0.2 * n}", str(n)]
        for i, u in enumerate(units):
            lines += [f"{0.2 * i:.2f}", f"{0.2 * i + 0.2:.2f}", f'"{PHONES[u]}"']
    path = tmp / "grids" / f"{name}.TextGrid"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines))


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    tmp, rng = tmp_path_factory.mktemp("data"), np.random.default_rng(0)
    for name in ("spk1/u1", "spk1/u2", "spk2/u3"):
        grid(tmp, name, rng.integers(0, 4, 25).tolist() + [0, 1, 2, 3], rng)
    return tmp


def common(data, run):
    return ["--features_dir", str(data / "features"), "--segments_dir", str(data / "segments"), "--output_dir", str(data / run)]


def run(spark, *argv):
    return cli.call(spark, *cli.parse([str(a) for a in argv]))


def test_graph_run_inference_and_scores(spark, data):
    run(spark, "models", "--features_dir", data / "features", "--output_dir", data / "models", "--number_of_components", 3)
    out = run(spark, "graph", *common(data, "graph"), "--models_dir", data / "models", "--edges.min_sim", 0.8, "--edges.num_neighbors", 6, "--cluster.resolution_specified", 0.01)
    scores = run(spark, "evaluate", "--segments_dir", f"{out}/segments", "--textgrid_dir", data / "grids", "--compute_nes", "--csv_path", data / "log.csv").first()
    assert (scores.pacc, scores.wnes, scores.num_utterances, scores.num_gold_types) == (1.0, 1.0, 3, 4)
    assert (scores.clustering, scores.num_neighbours, scores.min_sim) == ("graph_knn", 6, 0.8)
    args = ["infer", "--clustering_method", "graph_knn", "--run_dir", out, *common(data, "inferred"), "--models_dir", data / "models"]
    assert run(spark, *args) == 3
    assert run(spark, *args) == 0  # all are there
    again = run(spark, "evaluate", "--segments_dir", data / "inferred", "--textgrid_dir", data / "grids", "--csv_path", data / "log.csv").first()
    assert again.pacc == 1.0 and np.isnan(again.wnes)
    best = run(spark, "report", "--eval_path", data / "log.csv", "--top_n", 5).collect()
    assert [r.pacc for r in best] == [100.0, 100.0] and best[0].wnes == 100.0


def test_kmeans_run_and_reports(spark, data):
    out = run(spark, "kmeans", *common(data, "kmeans"), "--num_clusters", 4)
    assert "kmeans++_clusters_4" in out
    assert run(spark, "infer", "--clustering_method", "kmeans", "--run_dir", out, *common(data, "inferred-k")) == 3
    scores = run(spark, "evaluate", "--segments_dir", data / "inferred-k", "--textgrid_dir", data / "grids", "--compute_nes").first()
    assert (scores.pacc, scores.ipacc, scores.iwnes) == (1.0, 1.0, 1.0)
    ranks = run(spark, "zipf", "--segments_dir", f"{out}/segments", "--textgrid_dir", data / "grids", "--run_name", out)
    assert {r.method for r in ranks.select("method").distinct().collect()} == {"K-means", "phones 1"}
    first = run(spark, "examples", "--segments_dir", f"{out}/segments", "--top_k", 2, "--examples_per_cluster", 3).collect()
    assert len(first) == 6 and first[0].end_sample - first[0].first_sample == 3200


def test_boundaries(spark, data):
    found = run(spark, "boundaries", "--segments_dir", data / "segments", "--textgrid_dir", data / "grids").first()
    assert (found.precision, found.recall, found.r_value, found.token_f1) == (1.0, 1.0, 1.0, 1.0)


def test_wrong_segment_counts_are_an_error(spark, data, tmp_path):
    path = tmp_path / "segments" / "spk1" / "u1.npy"
    path.parent.mkdir(parents=True)
    np.save(path, np.zeros((2, 3), dtype=np.int64))
    config = stages.TrainConfig(str(data / "features"), str(tmp_path / "segments"), str(tmp_path))
    with pytest.raises(ValueError, match="segments"):
        stages.train_graph(spark, config)

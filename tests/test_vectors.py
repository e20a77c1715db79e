import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitloom.operators import graph, index, infer, kmeans, leiden, runs, vectors
from unitloom.operators.ranking import rank_frequency
from unitloom.plans import vector_queries
from unitloom.plans.vector_queries import subsample
from unitloom.sources import arrays, tables, textgrid
from unitloom.streaming.labels import label_stream
from unitloom.track import tracked


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(4) * 6
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(0, 0.2, 4)], i % 4) for i in range(200)]
    return spark.createDataFrame(rows, "vec_id long, vec array<double>, label long")


def arr(df, column):
    rows = sorted(df.collect(), key=lambda r: r.vec_id)
    return np.array([r[column] for r in rows])


def same_parts(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_scaler_and_pca(spark, blobs):
    x = arr(blobs, "vec")
    scaled = vectors.standardized(blobs, "vec", vectors.scaler_model(vectors.scaler_fit(blobs, "vec")))
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(arr(scaled, "scaled"), z)
    mean, top = vectors.pca_fit(scaled, "scaled", 2)
    assert np.allclose(top @ top.T, np.eye(2), atol=1e-9)
    spread = np.linalg.svd(z - z.mean(0), compute_uv=False)[:2] ** 2 / len(z)
    assert np.allclose(((z - mean) @ top.T).var(0), spread)
    assert (top[np.arange(2), np.abs(top).argmax(1)] > 0).all()


def test_constant_dimension_is_divided_by_one(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 4.0])], "vec_id long, vec array<double>")
    assert arr(vectors.standardized(v, "vec", vectors.scaler_model(vectors.scaler_fit(v, "vec"))), "scaled").tolist() == [[0, -1], [0, 1]]


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_cosine_edges_and_neighbours_agree_with_brute_force(spark, blobs, block):
    x = arr(blobs, "vec")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sims = u @ u.T
    found = {(r.src, r.dst) for r in vectors.cosine_edges(blobs, "vec_id", "vec", 0.9993, block).collect()}
    assert found == {(i, j) for i in range(200) for j in range(i + 1, 200) if sims[i, j] >= 0.9993}
    near = {(r.id, r.rn): r.other for r in vectors.nearest(blobs, blobs, "vec_id", "vec", 3, block=block).collect()}
    for i in range(0, 200, 17):
        order = sorted((j for j in range(200) if j != i), key=lambda j: (-sims[i, j], j))
        assert [near[i, k] for k in (1, 2, 3)] == order[:3]


def test_knn_edges_are_threshold_edges(spark, blobs):
    knn = {(r.src, r.dst) for r in vectors.knn_edges(blobs, "vec_id", "vec", 5, 0.5).collect()}
    assert knn <= {(r.src, r.dst) for r in vectors.cosine_edges(blobs, "vec_id", "vec", 0.5).collect()}


def test_votes(spark):
    rows = [(1, 1, 5), (1, 2, 4), (1, 3, 3), (2, 1, 5), (2, 2, 4), (2, 3, 4), (3, 1, 9), (3, 2, 2)]
    near = spark.createDataFrame(rows, "id long, rn int, label long")
    vote = lambda k: {r.id: r.label for r in vectors.majority_vote(near, k).collect()}
    assert vote(1) == {1: 5, 2: 5, 3: 9}
    assert vote(3) == {1: 5, 2: 4, 3: 9}  # three labels: the nearest
    assert vote(2) == {1: 4, 2: 4, 3: 2}  # ties: the smallest label


def test_kmeans_finds_blobs_and_cost_falls(spark, blobs):
    centroids, costs = kmeans.train(blobs, "vec_id", "vec", 4, rounds=5)
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:], strict=False))
    found = kmeans.clusters(blobs, "vec", centroids)
    assert same_parts(arr(found, "cluster").tolist(), arr(found, "label").tolist())


def test_kmeans_starts_in_a_cluster_that_is_rare(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "vec_id").withColumn("h", F.xxhash64("vec_id", F.lit(42)))
    last = [r.vec_id for r in ids.orderBy(F.desc("h")).limit(4).collect()]  # of the largest hashes
    x = F.when(F.col("vec_id").isin(last), 1000.0).otherwise(F.rand(1))
    start = kmeans.initial(ids.select("vec_id", F.array(x, F.rand(2)).alias("vec")), "vec_id", "vec", 3)
    assert start.shape == (3, 2) and start[:, 0].max() == 1000


@pytest.mark.parametrize(("n", "kinds", "k"), [(30, 30, 30), (30, 3, 5), (30, 1, 2)])
def test_kmeans_starts_with_as_many_as_there_are(spark, n, kinds, k):
    v = spark.createDataFrame([(i, [float(i % kinds), 1.0]) for i in range(n)], "vec_id long, vec array<double>")
    start = kmeans.initial(v, "vec_id", "vec", k)
    assert len(start) == k and len(np.unique(start, axis=0)) == min(k, kinds)
    with pytest.raises(ValueError):
        kmeans.initial(v, "vec_id", "vec", n + 1)


def test_leiden_finds_blobs(spark, blobs):
    edges = vectors.cosine_edges(blobs, "vec_id", "vec", 0.3)
    bridge = spark.createDataFrame([(0, 1, 0.31)], "src long, dst long, weight double")  # joins two blobs in one component
    ids = blobs.select(F.col("vec_id").alias("id"))
    found = leiden.communities(ids, edges.unionByName(bridge), 0.5)
    by = {r.id: r.cluster for r in found.collect()}
    assert same_parts([by[i] for i in range(200)], [i % 4 for i in range(200)])
    with pytest.raises(ValueError):
        leiden.partition(ids, edges)


def quality(n, edges, part, gamma):
    sizes = [part.count(c) for c in set(part)]
    return sum(w for a, b, w in edges if part[a] == part[b]) - gamma * sum(s * (s - 1) / 2 for s in sizes)


@pytest.mark.parametrize("seed", range(4))
def test_leiden_is_locally_best(seed):
    rng = np.random.default_rng(seed)
    n = 40
    edges = [(i, j, float(rng.uniform(0.2, 1))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.15]
    part = leiden.leiden(n, edges, 0.2, rounds=8, seed=seed)
    best = quality(n, edges, part, 0.2)
    assert best >= max(quality(n, edges, list(range(n)), 0.2), quality(n, edges, [0] * n, 0.2))
    for v in range(n):
        for c in {*part, n}:
            assert quality(n, edges, [c if u == v else p for u, p in enumerate(part)], 0.2) <= best + 1e-9


def test_cpm_quality(spark):
    member = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "id long, cluster long")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.7)], "src long, dst long, weight double")
    assert tuple(leiden.cpm_quality(member, edges, 0.2).first()) == (pytest.approx(0.3), 2)


def line(point):
    if point > 0.95:
        raise ZeroDivisionError
    return point * 100, None


def test_search():
    found = leiden.search(line, 37, 0.5, 0.0, 1.0)
    assert abs(found.value - 37) <= 0.5
    with pytest.raises(RuntimeError):
        leiden.search(line, 5, 1, 0.96, 1.0)


def test_search_says_when_it_does_not_settle(caplog):
    leiden.search(line, 37, 0.5, 0.0, 1.0)
    assert not caplog.records
    leiden.search(line, 37.123, 1e-9, 0.0, 1.0, rounds=2)
    assert "did not settle" in caplog.text


def test_the_points_of_a_round_run_at_once():
    together = threading.Barrier(4, timeout=20)

    def evaluate(point):
        together.wait()
        return point, None

    assert leiden.search(evaluate, 0.2, 0.01, 0.0, 1.0).point == pytest.approx(0.2)


def test_resolution_search_query_runs_in_full(spark, blobs, monkeypatch):
    seen = []
    monkeypatch.setattr(vector_queries, "_vectors", lambda *_: blobs)
    monkeypatch.setattr(vector_queries, "_edges", lambda *_: vectors.cosine_edges(blobs, "vec_id", "vec", 0.3))
    monkeypatch.setattr(leiden, "search", lambda evaluate, target, tolerance, low, high, rounds, points: seen.append((rounds, points)) or leiden.Found(0.5, 4, 0, None))
    assert vector_queries.resolution_search(spark, "").collect()[0].clusters == 4
    assert seen == [(15, 4)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101)], [(5, 3), (3, 5), (None, 4)]])
@pytest.mark.parametrize("chunk", [4, 500_000])
def test_components(spark, monkeypatch, edges, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root


@pytest.mark.parametrize("n", [300, 100_001])
def test_components_have_the_type_of_the_ends_at_every_size(spark, n):
    near = spark.range(n).select((F.col("id") * 2).alias("src"), (F.col("id") * 2 + 1).alias("dst"))
    for kind in ("int", "long", "string"):
        found = graph.connected_components(near.select(F.col("src").cast(kind), F.col("dst").cast(kind)))
        assert [t for _, t in found.dtypes] == ["bigint" if kind == "long" else kind] * 2
        assert found.agg(F.count("*"), F.countDistinct("component")).first()[:] == (2 * n, n)


def test_subsample(spark, blobs):
    for method in ("hash", "numpy"):
        assert subsample(blobs, "vec_id", 0.301, method=method).count() == 60
    with pytest.raises(ValueError):
        subsample(blobs, "vec_id", 3)


def test_stream_gives_what_the_table_gives(spark, blobs, tmp_path):
    q, r = blobs.where("vec_id % 5 = 0"), blobs.where("vec_id % 5 <> 0")
    label = infer.infer("graph_knn", references=r, ident="vec_id", vec="vec", label="label", k=3)
    q.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        label_stream(spark, f"{tmp_path}/in", q.schema, label, f"{tmp_path}/out", f"{tmp_path}/state", 1).awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select("id", "label").collect()) == sorted(label(q).collect())
    with pytest.raises(ValueError):
        infer.infer("nearest")


def test_array_files(spark, tmp_path):
    for name, n in (("b/two", 3), ("a", 0), ("b-c/x", 2)):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        np.save(tmp_path / "f" / f"{name}.npy", np.arange(n * 2, dtype=np.float32).reshape(n, 2))
    found = arrays.features(spark, str(tmp_path / "f"))
    assert {(r.utt, r.seg_idx): r.vec for r in found.collect()} == {("b/two", i): [2.0 * i, 2.0 * i + 1] for i in range(3)} | {("b-c/x", i): [2.0 * i, 2.0 * i + 1] for i in range(2)}
    rows = spark.createDataFrame([("u/v", 1, 5, 9, 2), ("u/v", 0, 0, 5, 1)], "utt string, seg_idx long, start_frame long, end_frame long, unit_id long")
    assert arrays.write_segments(rows, str(tmp_path / "s")).collect()[0].n_rows == 2
    assert sorted(map(tuple, arrays.segments(spark, str(tmp_path / "s")).collect())) == [("u/v", 0, 0, 5, 1), ("u/v", 1, 5, 9, 2)]
    assert arrays.complete(str(tmp_path / "s/u/v.npy"), 2) and not arrays.complete(str(tmp_path / "s/u/v.npy"), 3)
    wild = arrays.features(spark, str(tmp_path / "f" / "b*"))
    assert {r.utt for r in wild.collect()} == {"b/two", "b-c/x"}
    with pytest.raises(FileNotFoundError):
        arrays.files(spark, str(tmp_path), ".none")


LONG = '''File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 1.5
tiers? <exists>
size = 1
item []:
    item [1]:
        class = "IntervalTier"
        name = "phones"
        xmin = 0
        xmax = 1.5
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = ""
        intervals [2]:
            xmin = 0.5
            xmax = 1.5
            text = "AH""1"
'''
SHORT = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n1.5\n<exists>\n1\n"IntervalTier"\n"phones"\n0\n1.5\n2\n0\n0.5\n""\n0.5\n1.5\n"AH""1"\n'


@pytest.mark.parametrize("text", [LONG, SHORT])
def test_textgrid(spark, tmp_path, text):
    (tmp_path / "x.TextGrid").write_text(text)
    found = textgrid.intervals(spark, str(tmp_path), "phones").collect()
    assert [tuple(r) for r in found] == [("x", "phones", 0, 0.0, 0.5, ""), ("x", "phones", 1, 0.5, 1.5, 'AH"1')]


def test_log_and_models(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    tables.append_to_log(spark, path, spark.createDataFrame([("a", 0.5)], "run string, wnes double"))
    tables.append_to_log(spark, path, spark.createDataFrame([("b", 3)], "run string, k int"))
    assert {tuple(r) for r in tables.read_log(spark, path).select("run", "wnes", "k").collect()} == {("a", 0.5, None), ("b", None, 3)}
    tables.write_matrix(spark, np.array([[1.0, 2.0], [3.0, 4.0]]), str(tmp_path / "m"))
    assert tables.read_matrix(spark, str(tmp_path / "m")).tolist() == [[1, 2], [3, 4]]


def test_ranks_over_a_table(spark):
    rows = [(g, f"{i:03}", (i * 7) % 10 + 1) for g in "ab" for i in range(60)]
    made = spark.createDataFrame(rows, "g string, name string, n int").repartition(5)
    found = {(r.g, r.name): (r.rank, r.probability) for r in rank_frequency(made, "g").collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        total = sum(r[2] for r in order)
        assert [found[g, r[1]] for r in order] == [(i, round(r[2] / total, 9)) for i, r in enumerate(order, 1)]
    assert rank_frequency(made.limit(0).drop("g")).count() == 0


def test_tracked():
    with tracked(0.01) as usage:
        held = bytearray(30 << 20)
    assert usage.seconds > 0 and usage.peak_mb >= len(held) / (1 << 20)


def test_report_puts_unknown_scores_last(spark):
    log = spark.createDataFrame([("a", float("nan")), ("b", 0.25), ("c", None)], "run string, f1_wnes double")
    assert [(r.run) for r in runs.report(log).collect()] == ["b", "a", "c"]


def test_a_log_is_never_lost(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_to_log(spark, path, spark.createDataFrame([("a", 1), ("b", 2)], "run string, k int"))
    tables.append_to_log(spark, path, spark.createDataFrame([("c", "many")], "run string, k string"))  # another type
    assert {r.run for r in tables.read_log(spark, path).collect()} == {"a", "b", "c"}
    with pytest.raises(Exception):  # noqa: B017
        tables.append_to_log(spark, path, spark.createDataFrame([("d", [1])], "run string, k array<int>"))
    assert {r.run for r in tables.read_log(spark, path).collect()} == {"a", "b", "c"}
    (tmp_path / "log").rename(tmp_path / "log.old")  # broken off between the two renames
    tables.append_to_log(spark, path, spark.createDataFrame([("e", "5")], "run string, k string"))
    assert {r.run for r in tables.read_log(spark, path).collect()} == {"a", "b", "c", "e"}


def test_arrays_go_to_the_store_that_is_named(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a/u", 0, 0, 5, 1), ("a/u", 1, 5, 9, 2)], "utt string, seg_idx long, start_frame long, end_frame long, unit_id long")
    for root in (f"file://{tmp_path}/x", f"file:{tmp_path}/y", str(tmp_path / "z")):
        assert arrays.write_segments(rows, root).collect()[0].n_rows == 2
        assert arrays.segments(spark, root).count() == 2
    with pytest.raises(ValueError, match="no store"):
        arrays.write_segments(rows, "nowhere://bucket/out")
    made = spark.createDataFrame([("b/u", 1, [3.0, 4.0]), ("b/u", 0, [1.0, 2.0])], "utt string, seg_idx long, vec array<double>")
    arrays.write_features(made, str(tmp_path / "f")).collect()
    assert np.load(tmp_path / "f/b/u.npy").tolist() == [[1, 2], [3, 4]]


def test_probed_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 12))
    v = spark.createDataFrame([(i, [float(x) for x in base[i % 40] + rng.normal(0, 0.4, 12)]) for i in range(1200)], "vec_id long, vec array<double>")
    exact = vectors.nearest(v, v, "vec_id", "vec", 5)
    centers = index.centroids(v, "vec_id", "vec", 30)
    every = index.nearest_probed(v, v, "vec_id", "vec", 5, centers, len(centers), block=150)
    key = lambda df: sorted((r.id, r.rn, r.other) for r in df.collect())
    assert key(every) == key(exact)
    assert index.recall(exact, index.nearest_probed(v, v, "vec_id", "vec", 5, centers, 8)) >= 0.9


def test_leiden_of_one_large_component_is_quick():
    rng = np.random.default_rng(1)
    began = time.perf_counter()
    leiden.leiden(20_000, [(i, i + 1, 0.5) for i in range(19_999)] + [(int(a), int(b), 0.05) for a, b in rng.integers(0, 20_000, (20_000, 2)) if a != b], 0.3)
    assert time.perf_counter() - began < 60


def groups_and_bridges(seed):
    """Edges of 30 groups of 12 vertices, of at least 0.6, and weaker ones between the groups that join them all."""
    rng = np.random.default_rng(seed)
    groups = rng.permutation(360).reshape(30, 12)
    strong = [(int(g[i]), int(g[j]), float(rng.uniform(0.6, 1))) for g in groups for i in range(12) for j in range(i) if i - j == 1 or rng.random() < 0.4]
    weak = {(int(groups[i, a]), int(groups[j, b])): float(rng.uniform(0.3, 0.55)) for i in range(30) for j in range(i) for a, b in rng.integers(0, 12, (4, 2))}
    return strong, [(*ends, w) for ends, w in weak.items()]


def test_edges_below_the_resolution_change_nothing(spark):
    strong, weak = groups_and_bridges(0)
    ids, kinds = spark.range(365), "src long, dst long, weight double"
    alone, joined = (leiden.communities(ids, spark.createDataFrame(e, kinds), 0.6).collect() for e in (strong, [*strong, *weak]))
    assert len(alone) == 365 and len({r.cluster for r in alone}) < 300
    assert sorted(alone) == sorted(joined)


@pytest.mark.parametrize("gamma", [0.2, 0.35, 0.5, 0.62, 0.8])
def test_components_of_the_resolution_are_locally_best(gamma):
    edges = [(min(a, b), max(a, b), w) for a, b, w in sum(groups_and_bridges(1), [])]
    edges = sorted({(a, b): w for a, b, w in edges}.items())
    src, dst, w = np.array([e[0][0] for e in edges]), np.array([e[0][1] for e in edges]), np.array([e[1] for e in edges])
    part = np.arange(360)
    ids, found = leiden._clustered(src, dst, w, gamma, 8, 42)
    part[ids] = found
    near, size = np.zeros((360, 360)), np.bincount(part, minlength=360)
    near[src, dst] = near[dst, src] = w
    to = near @ (part[:, None] == np.arange(360))  # gains of every vertex by every cluster, and by none
    gain = to - gamma * (size[None, :] - (part[:, None] == np.arange(360)))
    own = gain[np.arange(360), part]
    assert (own >= -1e-9).all()
    loss = (gain.max(axis=1) - own) > 1e-9
    assert loss.sum() <= 360 * 0.02  # only neighbours of what moves are looked at again
    whole = leiden.leiden(360, list(zip(src.tolist(), dst.tolist(), w.tolist(), strict=True)), gamma, 8)
    value = lambda p: w[p[src] == p[dst]].sum() - gamma * (lambda n: n * (n - 1) / 2)(np.unique(p, return_counts=True)[1]).sum()
    assert value(part) >= 0.98 * value(np.array(whole))


@pytest.mark.parametrize("chunk", [40, 500_000])
def test_a_round_of_the_search_gives_the_communities_of_each_point(spark, chunk):
    strong, weak = groups_and_bridges(2)
    ids, edges = spark.range(350), spark.createDataFrame([*strong, *weak, (5, 5, 1.0), *[(b, a, 0.01) for a, b, _ in weak[:9]]], "src long, dst long, weight double")
    points = leiden._Points(ids, edges, 2, 42, chunk)
    for inner in ([0.25, 0.97], [0.6, 0.7], [0.2, 1.5]):
        points.begin(inner)
        for p in inner:
            n, state = points(p)
            rows = sorted(state.collect())
            assert [r.id for r in rows] == list(range(360)) and len({r.cluster for r in rows}) == n
            assert rows == sorted(leiden.communities(ids, edges, p).collect())
    found = leiden.resolution_search(ids, edges, 100, 2)
    assert abs(found.state.select("cluster").distinct().count() - 100) == found.difference <= 2


def test_copies_are_one_cluster_without_moves(monkeypatch):
    ids = np.array([3, 5, 8, 9, 20, 21])
    a, b = np.triu_indices(4, 1)
    src, dst, w = np.append(ids[a], [9, 20]), np.append(ids[b], [20, 21]), np.append(np.full(6, 0.99), [0.4, 0.7])
    monkeypatch.setattr(leiden, "_leiden", None)
    found = dict(zip(*(x.tolist() for x in leiden._clustered(src, dst, w, 0.6, 2, 42)), strict=True))
    assert found == {3: 3, 5: 3, 8: 3, 9: 3, 20: 20, 21: 20}

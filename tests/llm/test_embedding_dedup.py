import numpy as np
import pytest

from unitloom.llm import embedding_dedup as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=np.float32).astype(float)
        return v / np.linalg.norm(v)

    units = {i: unit(v) for i, v, _ in rows}
    link = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95
    near = {i: {j for j in units if j != i and link(units[i], units[j])} for i in units}
    root = {i: i for i in units}
    for _ in units:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in units}
    return {i: (len(near[i]), root[i], root[i] == i) for i in units}


def result(spark, rows):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize(("tile", "tiles"), [(2048, 3), (16, 100)])
def test_agrees_with_brute_force(spark, monkeypatch, tile, tiles):
    monkeypatch.setattr(op, "LEAST_TILE", tile)
    monkeypatch.setattr(op, "LEAST_TILES", tiles)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in base[i % 30] + rng.normal(0, rng.choice([0, 0.1, 0.25]), 8)], i % 3) for i in range(160)]
    rows += [(200 + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(300 + i, [2 * x for x in rows[1][1]], 0) for i in range(3)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0, None] * 4, 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] + [0.0] * 7, 1), (405, [], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 2), (408, [-0.0] * 8, 1), (409, [3e38] * 8, 0), (410, [1e-38] * 8, 0)]
    assert result(spark, rows) == brute(rows)


def test_empty_and_repeated(spark):
    assert result(spark, []) == {}
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)]
    found = op.near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS node", "'y' AS v", "1 AS links")).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_one_id_with_two_vectors_joins_their_groups(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 1.0], 0)]
    found = op.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in found} == {1}

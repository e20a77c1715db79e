"""Graph operators over edge tables: components, degrees, statistics and the constant Potts quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.storage import materialize, release

#: Edges that a task contracts at a time.
CHUNK = 500_000


def _forest(u: pa.Array, v: pa.Array) -> pa.RecordBatch:
    """(u, v) edges from each node to the smallest one that these edges connect it with, but for that one itself."""
    nodes = pc.unique(pa.concat_arrays([u, v]))
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(x, value_set=nodes).to_numpy().astype(np.int64) for x in (u, v))
    root = np.arange(len(nodes))
    while (apart := (root[a] != root[b])).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(hung)), nodes.take(pa.array(root[hung]))], ["u", "v"])


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: each task replaces ``CHUNK`` edges at a time by their forest of stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield forest(held)
                held, n = [], 0
        if n:
            yield forest(held)

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return _forest(*(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)))

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another one; component = smallest node reachable.

    Both columns have the type of the ends, numbers or strings; graphs of every size go the same way. Tasks first contract the
    edges they read, then those of balanced partitions, to forests of stars in chunks of bounded size. If these
    are not the components yet, alternating large-star and small-star rounds follow: each hangs every neighbour of
    a node on the smallest node it knows, and its edges are contracted again. No adjacency list is collected: minima are
    partial aggregates, written as a table before they are joined back, so both join sides are plain exchanges and a
    hub's rows can be split by the adaptive skew join. Self loops, repeated edges and rows with a null end are ignored.
    """
    u, v = F.col(src), F.col(dst)
    real = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = materialize(_contracted(_contracted(real).hint("rebalance")), "edges")
    for _ in range(max_rounds):
        if _are_stars(e):
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialize(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = materialize(_contracted(small.unionByName(least.select("u", F.col("m").alias("v"))).hint("rebalance")), "edges")
        for old in (e, low, large, least):
            release(old)
        e = out
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionByName(roots)


def _are_stars(e: DataFrame) -> bool:
    """Whether every node that hangs on one hangs on one only, which hangs on none."""
    hung = e.groupBy("u").agg((F.min("v") != F.max("v")).alias("odd")).select(F.col("u").alias("n"), "odd")
    held = e.select(F.col("v").alias("n")).distinct().select("n", F.lit(False).alias("odd"))
    return hung.unionByName(held).groupBy("n").agg(F.max("odd").alias("odd"), F.count("*").alias("k")).where("odd or k > 1").isEmpty()


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges and the mean degree (0 without vertices)."""
    v, e = vertices.agg(F.count("*").alias("vertices")), edges.agg(F.count("*").alias("edges"))
    return v.join(e).withColumn("avg_degree", F.when(F.col("vertices") == 0, 0.0).otherwise(2 * F.col("edges") / F.col("vertices")))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, strength); vertices without an edge have 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return vertices.select("id").join(ends, "id", "left").na.fill(0, ["degree"]).na.fill(0.0, ["strength"])

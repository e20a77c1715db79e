"""Embedding near-dedup by an exact metric range join.

Vectors are scaled to unit length, so cosine >= c is a distance of r = sqrt(2 - 2c) at most. Equal vectors are joined first into
classes, told apart by two hashes of 64 bits. One class vector of each tile's worth (those of smallest hash) is a pivot, so
pivots grow with the table, as far as ``MODEL_BYTES`` of them; a class lives in the cell of its nearest pivot. It also visits
each cell with a smaller number that may hold a neighbour: by the triangle inequality, one no further than r plus that
cell's radius from its pivot, and no further than r beyond the plane halfway between the two pivots. Any pair within
r then meets in the smaller-numbered cell of the two, and cells are joined independently.

A cell's own and visiting vectors are cut into tiles of a bounded number of values and a task compares two tiles, so a cell
that holds a third of all vectors is many tasks of bounded size. Vectors move in their own type, and only to be
compared: all else is done on ids and hashes. Candidates are found in single precision with a margin that covers
its rounding at the vectors' length, and decided in double. A task returns its vectors' link counts, and a forest of edges that
connects what its links connect, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different length do not link (each length is joined on its own); rows that share a vec_id are one vertex, whose n_links is
the largest of its rows; repeated rows give repeated result rows; other columns, labels among them, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from unitloom.operators.graph import connected_components
from unitloom.storage import materialize

COSINE, MODEL_BYTES = 0.95, 64 << 20
#: Values of a tile's vectors at most; its rows at least, and the tiles that a small table is cut into.
TILE_VALUES, LEAST_TILE, LEAST_TILES = 1 << 20, 2048, 3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, first by their largest component so that nothing overflows."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def slack(dim: int) -> float:
    """More than the rounding of sqrt(2 - 2 dot) in double precision, which is largest near zero."""
    return 4 * float(np.sqrt(dim * np.finfo(np.float64).eps))


def margin(dim: int) -> float:
    """More than the rounding of a product of unit vectors in single precision."""
    return 2 * (dim + 4) * float(np.finfo(np.float32).eps)


def tile_rows(count: int, dim: int) -> int:
    return min(max(LEAST_TILE, count // LEAST_TILES), max(256, TILE_VALUES // dim))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2) of the rows that can link; v has the type of the column, single or double precision."""
    kind = vectors.schema["embedding"].dataType
    to = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    v = F.col("embedding").cast(f"array<{to}>")
    low, high = F.array_min(v), F.array_max(v)
    none = F.array_contains(F.transform(v, lambda x: x.isNull() | F.isnan(x)), True)
    valid = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~none & (low > float("-inf")) & (high < float("inf")) & ((low != 0) | (high != 0))
    clear = F.transform(v, lambda x: x + F.lit(0.0).cast(to))  # -0.0 is 0.0

    def hashed(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), "v").alias(f"h{seed}")

    return vectors.where(valid).select("vec_id", clear.alias("v")).select("vec_id", "v", hashed(1), hashed(2))


class _Cells:
    """The cells of vectors of one length: pivots, radii, and which cells each vector lives in or visits."""

    def __init__(self, found: DataFrame, dim: int, cosine: float):
        self.found, self.dim, count = found, dim, found.count()
        self.tile = tile_rows(count, dim)
        most = min(count // self.tile + 1, max(1, MODEL_BYTES // (8 * dim)))
        pivots = unit(np.array([r.v for r in found.orderBy(F.xxhash64("v"), "node").limit(most).select("v").collect()], dtype=np.float64))
        self.rows = max(64, (1 << 22) // len(pivots))  # compared with the pivots at a time
        self.reach = float(np.sqrt(2 - 2 * cosine)) + slack(dim)
        self.shared = found.sparkSession.sparkContext.broadcast((pivots, np.full(len(pivots), 2.0)))
        near = self._mapped(self._nearest, "cell long, reach double").groupBy("cell").agg(F.max("reach").alias("reach"))
        radius = np.zeros(len(pivots))
        for row in near.collect():  # a row for each pivot
            radius[row.cell] = row.reach
        self.shared = found.sparkSession.sparkContext.broadcast((pivots, radius))

    def _mapped(self, function, schema: str) -> DataFrame:
        shared, dim, rows, reach = self.shared, self.dim, self.rows, self.reach

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, radius = shared.value
            yield from function(((b.slice(at, rows), dim) for b in batches for at in range(0, b.num_rows, rows)), pivots, radius, reach)

        return self.found.select("v", "node", "n").mapInArrow(run, schema)

    @staticmethod
    def _nearest(parts, pivots: np.ndarray, radius: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
        far = np.zeros(len(pivots))
        for b, dim in parts:
            d = np.sqrt(np.maximum(0, 2 - 2 * unit(_matrix(b.column(0), dim)) @ pivots.T))
            np.maximum.at(far, d.argmin(axis=1), d.min(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(far)], ["cell", "reach"])

    @staticmethod
    def _places(b: pa.RecordBatch, dim: int, pivots: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, cell) pairs: first the home of each row, as many as rows, then the visits."""
        dots = unit(_matrix(b.column(0), dim)) @ pivots.T
        home = dots.argmax(axis=1)
        own = dots[np.arange(len(home)), home]
        d = np.sqrt(np.maximum(0, 2 - 2 * dots))
        gap = np.sqrt(np.maximum(0, 2 - 2 * pivots[home] @ pivots.T))
        visit = (d <= radius + reach) & (own[:, None] - dots <= reach * np.maximum(gap, 1e-9)) & (np.arange(len(pivots)) < home[:, None])
        row, cell = np.nonzero(visit)
        return np.concatenate([np.arange(len(home)), row]), np.concatenate([home, cell]), len(home)

    @classmethod
    def _sizes(cls, parts, pivots: np.ndarray, radius: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
        own, other = np.zeros((2, len(pivots)), dtype=np.int64)
        for b, dim in parts:
            _, cell, n = cls._places(b, dim, pivots, radius, reach)
            own += np.bincount(cell[:n], minlength=len(pivots))
            other += np.bincount(cell[n:], minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(own), pa.array(other)], ["c", "own", "other"])

    @classmethod
    def _rows(cls, parts, pivots: np.ndarray, radius: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
        for b, dim in parts:
            row, cell, n = cls._places(b, dim, pivots, radius, reach)
            picked = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.arange(len(row)) < n), picked.column(1), picked.column(2), picked.column(0)], ["cell", "home", "node", "n", "v"])

    def tasks(self) -> DataFrame:
        """Rows with the pairs of tiles they are compared in: (cell, i, j) for i <= j; visitors' tiles come after a cell's own."""
        kind = self.found.schema["v"].dataType.simpleString()
        cells = self._mapped(self._rows, f"cell long, home boolean, node long, n long, v {kind}")
        sizes = self._mapped(self._sizes, "c long, own long, other long").groupBy("c").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))  # a row for each pivot
        tiles = sizes.select("c", F.ceil(F.col("own") / self.tile).cast("int").alias("own"), F.ceil(F.col("other") / self.tile).cast("int").alias("other"))
        known = cells.join(F.broadcast(tiles), F.col("cell") == F.col("c")).where("own > 0")
        tile = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("node"), F.greatest("other", F.lit(1)))).cast("int")
        partners = F.when(F.col("home"), F.sequence(F.lit(0), F.col("own") + F.col("other") - 1)).otherwise(F.sequence(F.lit(0), F.col("own") - 1))
        spread = known.withColumn("tile", tile).withColumn("partner", F.explode(partners))
        return spread.select(F.struct("cell", F.least("tile", "partner").alias("i"), F.greatest("tile", "partner").alias("j")).alias("task"), "tile", "node", "n", "v")


def _hang(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after the rows a and b are linked pairwise; every row's root is the first row of its group."""
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _compare(cosine: float):
    def run(task: pa.Table) -> pa.Table:
        task = task.sort_by([("tile", "ascending"), ("node", "ascending")]).combine_chunks()
        values = task.column("v").chunk(0)
        dim = len(values[0])
        v = unit(_matrix(values, dim))
        ids, n, tile = (task.column(c).to_numpy() for c in ("node", "n", "tile"))
        i, j = (task.column("task")[0][k].as_py() for k in ("i", "j"))
        first = np.flatnonzero(tile == i)
        second = first if i == j else np.flatnonzero(tile == j)
        links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        small = v.astype(np.float32)
        for at in range(0, len(first), 256):
            rows = first[at : at + 256]
            x, y = np.nonzero(small[rows] @ small[second].T >= cosine - margin(dim))
            a, b = rows[x], second[y]
            later = ids[a] < ids[b] if i == j else ids[a] != ids[b]
            a, b = a[later], b[later]
            for k in range(0, len(a), 100_000):
                p, q = a[k : k + 100_000], b[k : k + 100_000]
                sure = np.einsum("ij,ij->i", v[p], v[q]) >= cosine
                p, q = p[sure], q[sure]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                root = _hang(root, p, q)
        linked, hung = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        return pa.table({
            "a": np.concatenate([ids[linked], ids[hung]]), "b": pa.array([None] * len(linked) + ids[root[hung]].tolist(), pa.int64()), "n": np.concatenate([links[linked], np.zeros(len(hung), dtype=np.int64)]),
        })

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors."""
    spark, rows = vectors.sparkSession, _valid(vectors)
    members = materialize(rows.select("vec_id", "h1", "h2").distinct(), "members")
    names = materialize(members.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    found = materialize(rows.join(names, same & (F.col("vec_id") == F.col("node"))).dropDuplicates(["h1", "h2", "vec_id"]).select("v", "node", "n"), "vectors")
    parts = []
    for (dim,) in found.select(F.size("v")).distinct().collect():  # usually one length
        tasks = _Cells(found.where(F.size("v") == dim), dim, cosine).tasks()
        parts.append(materialize(tasks.groupBy("task").applyInArrow(_compare(cosine), "a long, b long, n long"), "links"))
    told = parts[0] if parts else spark.createDataFrame([], "a long, b long, n long")
    for p in parts[1:]:
        told = told.unionByName(p)
    counts = told.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    classed = materialize(members.join(names, same).select("vec_id", "node", "n"), "classed")
    # a vec_id given with several vectors joins their classes
    several = classed.groupBy("vec_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("vec_id")
    own = classed.join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("src"), F.col("node").alias("dst"))
    component = connected_components(told.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(own))
    named = names.select("node", "n").join(component, "node", "left").join(counts, F.col("a") == F.col("node"), "left")
    named = materialize(named.select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component")), "named")
    result = classed.select("vec_id", "node").join(named, "node").groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    given = vectors.select("vec_id").join(result.withColumnRenamed("vec_id", "__id"), F.col("vec_id") == F.col("__id"), "left")
    component_id = F.coalesce("component", "vec_id")
    return given.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("vec_id") == component_id).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x), least_ AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON counts.x = vec_id LEFT JOIN least_ ON least_.x = vec_id
"""

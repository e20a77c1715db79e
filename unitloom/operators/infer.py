"""Label inference: standardise, project, find labelled neighbours or a centroid, vote. For tables and for streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.operators.index import centroids, nearest_probed
from unitloom.operators.vectors import majority_vote, nearest, nearest_centroid, projected, standardized


@dataclass
class Preparation:
    """A scaler and a PCA model; either may be left out."""

    scaler: tuple[np.ndarray, np.ndarray] | None = None
    pca: tuple[np.ndarray, np.ndarray] | None = None

    def apply(self, vectors: DataFrame, vec: str) -> DataFrame:
        if self.scaler is not None:
            vectors = standardized(vectors, vec, self.scaler, vec)
        return projected(vectors, vec, self.pca, vec) if self.pca is not None else vectors


def by_neighbours(queries: DataFrame, references: DataFrame, ident: str, vec: str, label: str, k: int = 3, probes: int | None = None) -> DataFrame:
    """(id, label): vote of the k nearest references by cosine; exact, or with ``probes`` among those cells of an index."""
    if probes is None:
        near = nearest(queries, references, ident, vec, k)
    else:
        near = nearest_probed(queries, references, ident, vec, k, centroids(references, ident, vec), probes)
    labelled = near.join(references.select(F.col(ident).alias("other"), F.col(label).alias("label")), "other")
    return majority_vote(labelled.select("id", "rn", "label"), k)


def by_centroid(queries: DataFrame, vec: str, centroids: np.ndarray) -> DataFrame:
    return nearest_centroid(queries, vec, centroids, np.arange(len(centroids)), "label").drop("distance")


def infer(method: str, **options) -> Callable[[DataFrame], DataFrame]:
    """A function from queries to labels for a method's name: "graph_knn", "kmeans++" or "kmeans"."""
    if method == "graph_knn":
        return lambda q: by_neighbours(q, **options)
    if method in ("kmeans", "kmeans++"):
        return lambda q: by_centroid(q, **options)
    raise ValueError(f"no method {method!r}")

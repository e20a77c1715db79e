"""Boundary and token evaluation. Hits are consumed in order, so matching is a pass over sorted arrays, one island at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.functions.scalars import over_segmentation, precision_recall_f1, r_value
from unitloom.operators.intervals import islands, overlap_join
from unitloom.storage import materialize

#: Fixed value: ticks (0.05 s).
TOLERANCE = 5
#: Ticks of a bin in which cuts and islands meet.
BIN = 64


def speech_islands(gold: DataFrame) -> DataFrame:
    """(utt, island, onset, offset, ends): unbroken stretches of non-empty text; gold: (utt, idx, start, end, text)."""
    inside = islands(gold, "utt", ["start", "idx"], F.col("text") != "")
    ends = F.transform(F.sort_array(F.collect_list(F.struct("start", "idx", "end"))), lambda x: x["end"])
    return inside.groupBy("utt", "island").agg(F.min("start").alias("onset"), F.max_by("end", F.struct("start", "idx")).alias("offset"), ends.alias("ends"))


def matched_islands(gold: DataFrame, cuts: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Islands with ``found``: the cuts well inside each, in order, and its own end. cuts: (utt, at)."""
    known = materialize(speech_islands(gold), "islands")
    inner = known.select("utt", "island", (F.col("onset") + tolerance + 1).alias("r_start"), (F.col("offset") - tolerance).alias("r_end")).where("r_start < r_end")
    near = overlap_join(cuts.select("utt", F.col("at").alias("start"), (F.col("at") + 1).alias("end")), inner, "utt", BIN)
    found = near.groupBy("utt", "island").agg(F.sort_array(F.collect_list("start")).alias("inner"))
    joined = known.join(found, ["utt", "island"], "left")
    return joined.withColumn("found", F.concat(F.coalesce("inner", F.array().cast("array<long>")), F.array(F.col("offset").cast("long")))).drop("inner")


def greedy_hits(outer: np.ndarray, inner: np.ndarray, tolerance: int) -> int:
    """How many rows of outer, in order, take a first free row of inner that is near in every column.

    Where both ascend in every column, what is too small for one row is so for all later ones: one pass over both.
    """
    ascend = all((np.diff(x, axis=0) >= 0).all() for x in (outer, inner))
    low, high, rows = (outer - tolerance).tolist(), (outer + tolerance).tolist(), inner.tolist()
    if not ascend:
        free, hits = list(range(len(rows))), 0
        for a, b in zip(low, high, strict=True):
            at = next((k for k in free if all(x <= v <= y for x, v, y in zip(a, rows[k], b, strict=True))), None)
            if at is not None:
                free.remove(at)
                hits += 1
        return hits
    at = hits = 0
    for a, b in zip(low, high, strict=True):
        while at < len(rows) and any(v < x for x, v in zip(a, rows[at], strict=True)):
            at += 1
        if at < len(rows) and all(v <= y for v, y in zip(rows[at], b, strict=True)):
            hits += 1
            at += 1
    return hits


def _counted(matched: DataFrame, count: Callable[[np.ndarray, np.ndarray], tuple[int, int, int]]) -> DataFrame:
    """One row (n_seg, n_ref, n_hit): the sums of ``count`` of each island's found and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [count(*(np.array(c[k].as_py(), dtype=np.int64) for c in b.columns)) for k in range(b.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["n_seg", "n_ref", "n_hit"])

    rows = matched.select("found", "ends").mapInArrow(run, "n_seg long, n_ref long, n_hit long")
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def boundary_counts(matched: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """One row (n_seg, n_ref, n_hit): the last boundary of an island is on both sides and is left out."""
    return _counted(matched, lambda found, ends: (len(found) - 1, len(ends) - 1, greedy_hits(ends[:-1, None], found[:-1, None], tolerance)))


def token_counts(matched: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """One row of counts for whole tokens; an island's first token begins at 0, as in the definition."""

    def tokens(ends: np.ndarray) -> np.ndarray:
        return np.column_stack([np.concatenate([[0], ends[:-1]]), ends])

    return _counted(matched, lambda found, ends: (len(found), len(ends), greedy_hits(tokens(found), tokens(ends), tolerance)))


def _scores(counts: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return counts.select(precision_recall_f1(zero("n_seg"), zero("n_ref"), zero("n_hit")).alias("s")).select("s.*")


def boundary_metrics(gold: DataFrame, cuts: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    matched = materialize(matched_islands(gold, cuts, tolerance), "matched")
    b = _scores(boundary_counts(matched, tolerance))
    t = _scores(token_counts(matched, tolerance)).select(*[F.col(c).alias(f"token_{c}") for c in ("precision", "recall", "f1")])
    full = b.withColumn("os", over_segmentation(F.col("precision"), F.col("recall"))).withColumn("r_value", r_value(F.col("precision"), F.col("recall"))).join(t)
    return full.select(*[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "os", "r_value", "token_precision", "token_recall", "token_f1")])

"""Scalar column functions of the domain. Times are integer ticks (0.01 s), so no rounding differs between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: frames a second.
FRAME_RATE = 50
#: Tokens that stand for silence or noise, compared in lower case.
SILENCES = ("sil", "spn", "sp", "<unk>", "")


def cleaned(tokens: Column) -> Column:
    """Tokens without silences; then (so that "1" stays, as an empty token) without digits of any script."""
    return F.transform(F.filter(tokens, lambda t: ~F.lower(t).isin(*SILENCES)), lambda t: F.regexp_replace(t, r"\p{Nd}", ""))


def overlaps(gold_start: Column, gold_end: Column, start: Column, end: Column) -> Column:
    """Whether a gold interval counts for a segment: it holds the segment, or shares three ticks of six or more, or half of fewer."""
    gold = gold_end - gold_start
    shared = F.least(gold_end, end) - F.greatest(gold_start, start)
    return ((gold_start <= start) & (gold_end >= end)) | ((shared > 0) & (((gold >= 6) & (shared >= 3)) | ((gold > 0) & (gold < 6) & (2 * shared >= gold))))


def frame_to_seconds(frame: Column, rate: int = FRAME_RATE) -> Column:
    return frame / F.lit(float(rate))


def frame_to_sample(frame: Column, sample_rate: int = 16_000, rate: int = FRAME_RATE) -> Column:
    return F.floor(frame * sample_rate / rate).cast("long")


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 only where the sum is exactly 0 (negative accuracies are not clamped)."""
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def precision_recall_f1(found: Column, known: Column, hits: Column) -> Column:
    """struct(precision, recall, f1): (0, 0, -inf) without any boundary, zeros without a hit."""
    none = (found == 0) & (known == 0)
    p = F.when(hits == 0, 0.0).otherwise(hits / found)
    r = F.when(hits == 0, 0.0).otherwise(hits / known)
    f = F.when(none, F.lit(float("-inf"))).when(hits == 0, 0.0).otherwise(2 * p * r / (p + r))
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))


def over_segmentation(precision: Column, recall: Column) -> Column:
    return F.when(precision == 0, F.lit(float("-inf"))).otherwise(recall / precision - 1)


def r_value(precision: Column, recall: Column) -> Column:
    over = over_segmentation(precision, recall)
    a = F.sqrt((1 - recall) ** 2 + over**2)
    b = (-over + recall - 1) / F.sqrt(F.lit(2.0))
    return 1 - (F.abs(a) + F.abs(b)) / 2


def normalized_distance(a: Column, b: Column) -> Column:
    """Edit distance of two encoded sequences (a character a token) by the longer one; 0 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)


# The names and colours of methods; the two look for parts of a name in different orders.
def method_label(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("kmeans"), "K-means").when(n.contains("full"), "Full Graph").when(n.contains("knn"), "kNN Graph").otherwise("Induced clusters")


def method_color(name: Column) -> Column:
    return F.when(name.contains("full"), "tab:blue").when(name.contains("kmeans"), "tab:gray").when(name.contains("knn"), "tab:orange").otherwise("tab:green")


def l2_normalized(vec: Column) -> Column:
    """Unit length in double precision; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / norm))


def rms_normalized(samples: Column, target: float = 0.1, least: float = 1e-8) -> Column:
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x) / F.size(samples))
    return F.when(rms > least, F.transform(samples, lambda x: x * (F.lit(target) / rms))).otherwise(samples)

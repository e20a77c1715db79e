"""TextGrid annotations as (utt, tier, idx, start_time, end_time, text); long and short text forms, empty intervals kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from unitloom.sources.arrays import files

_VALUE = re.compile(r'"((?:[^"]|"")*)"|(?<![\w.])(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.\]])')


def parse(text: str) -> Iterator[tuple[str, int, float, float, str]]:
    """(tier, idx, start, end, text) of every interval. Values come in the same order in both forms; names are skipped."""
    body = re.sub(r"\[\d*\]|<exists>", " ", text)
    values = [m.group(1).replace('""', '"') if m.group(1) is not None else float(m.group(2)) for m in _VALUE.finditer(body)]
    at = 2 if values[:2] and isinstance(values[0], str) and isinstance(values[1], str) else 0  # file type and object class
    at += 2  # the whole span
    tiers = int(values[at])
    at += 1
    for _ in range(tiers):
        kind, name, n = values[at], values[at + 1], int(values[at + 4])
        at += 5
        width = 3 if kind == "IntervalTier" else 2
        for i in range(n):
            if width == 3:
                yield name, i, values[at], values[at + 1], values[at + 2]
            at += width


def intervals(spark: SparkSession, root: str, tier: str | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for utt, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
                rows = [(utt, *r) for r in parse(text) if tier is None or r[0] == tier]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["utt", "tier", "idx", "start_time", "end_time", "text"])

    return files(spark, root, ".TextGrid").select("utt", "content").mapInArrow(run, "utt string, tier string, idx int, start_time double, end_time double, text string")

"""Token sequences as strings of one character a token, so that the native `levenshtein` works on tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First characters and numbers of the ranges for private use: as many tokens can have one.
PRIVATE = ((0xE000, 6_400), (0xF0000, 65_534), (0x100000, 65_534))
MOST = sum(n for _, n in PRIVATE)
#: Vocabularies of at most so many tokens are a literal map, which is looked through; larger ones a table for Arrow batches.
LITERAL = 64


def letter(i: int) -> str:
    """The character of token number i."""
    for first, n in PRIVATE:
        if i < n:
            return chr(first + i)
        i -= n
    raise ValueError("no character is left")


def encoded(sequences: DataFrame, column: str, to: str) -> DataFrame:
    """sequences with column ``to``: the array of tokens in ``column`` as a string. The vocabulary must have at most ``MOST`` tokens
    (137,468, the characters for private use); for others there is `array_distance`."""
    tokens = sequences.select(F.explode(column).alias("t")).distinct().orderBy("t").limit(MOST + 1)
    vocabulary = [r.t for r in tokens.collect()]  # bounded by the limit
    if len(vocabulary) > MOST:
        raise ValueError(f"over {MOST} distinct tokens; compare the arrays with `array_distance`")
    if not vocabulary:
        return sequences.withColumn(to, F.lit(""))
    known = {t: letter(i) for i, t in enumerate(vocabulary)}
    if len(known) > LITERAL:
        return sequences.withColumn(to, F.pandas_udf(lambda rows: rows.map(lambda r: None if r is None else "".join(known[t] for t in r)), "string")(column))
    letters = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return sequences.withColumn(to, F.array_join(F.transform(column, lambda t: F.element_at(letters, t)), ""))


def distance(a, b) -> int:
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row = row, np.empty_like(row)
        row[0] = i
        step = np.minimum(before[1:] + 1, before[:-1] + np.fromiter((x != y for y in b), dtype=int, count=len(b)))
        for j in range(len(b)):
            row[j + 1] = min(step[j], row[j] + 1)
    return int(row[-1])


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def array_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays of any vocabulary."""
    return F.pandas_udf(_distances, "int")(a, b)

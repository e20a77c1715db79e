"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells of source, language and topic. Cell weights are raked to the target shares of each of
the three, in turn, until they fit; each document is then kept with a probability proportional to its cell's weight,
scaled so that ``BUDGET`` of all tokens is expected. Where a cell would need more than it has (probability above one), it
is kept whole, and the rest is raked and scaled again around it. A document's draw is a hash of its id and
the seed, so it is the same wherever and however often it is computed.

A document's tokens are counted exactly, by the vocabulary of `token_counts`. Its topic is what the caller gives as a column;
documents that come without one are told apart by the form of their text: shouted, symbols, table, list, short or prose.
Targets are share ** power of the table itself, made to sum to one, unless given. Every source and language has cells of its
own. Up to as many cells as ``MAX_SOURCES`` sources and ``MAX_LANGS`` languages with one more of each can make are raked on the
driver and broadcast; more of them stay in a table, which is raked with sums by margin and joins, each step written, by the same
rule. What raking leaves of a margin's target after ``ROUNDS`` rounds at most is logged. Texts are read once for tokens and
cells, which are written without them; `sample` reads them a second time, as what it returns.

Defined results: null and empty texts, and all others, count one token at least; texts of any length are counted whole; null
sources, languages and topics are values of their own; a draw is of doc_id and text, so rows that share both draw alike
(a null doc_id is one id); documents that tie in probability are drawn apart; other columns are ignored by `mixed` and
kept by `sample`; an empty table gives no rows.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitloom.llm.token_counts import VOCABULARY, Encoder, encoder
from unitloom.storage import materialize, release

MAX_SOURCES, MAX_LANGS, BUDGET, SEED, ROUNDS, CLOSE = 256, 64, 0.7, 42, 200, 1e-10
#: Target share = own share ** power, for source, language and topic.
POWERS = (0.7, 0.8, 0.9)
_NULL = "(null)"
_AXES = ("__source", "__lang", "__topic")


#: Pieces that may be longer are counted by prefix tables, in linear time.
_UNBROKEN = re.compile(r"\S{1000}|\s{1000}")


class Counter:
    """The counts of `token_counts`, by a compiled encoder over the same merges."""

    def __init__(self, known: Encoder):
        merged = {(a + b).encode("latin-1"): 256 + i for (a, b), i in known.ranks.items()}
        self.known, self.encoding = known, tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)} | merged, special_tokens={})

    def count(self, text: str) -> int:
        if _UNBROKEN.search(text) or self.known.special and self.known.special.search(text):
            return self.known.count(text)
        return len(self.encoding.encode_ordinary(text))


@cache
def counter(path: str) -> Counter:
    return Counter(encoder(path))


def form(text: Column) -> Column:
    """The topic of documents that come without one."""
    n = F.octet_length(text)
    share = lambda signs: F.regexp_count(text, F.lit(f"[{signs}]")) / n
    count = lambda sign: n - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))
    return (
        F.when(n.isNull() | (n < 200), "short")
        .when(count("|") / n > 0.02, "table")
        .when(share("#$%&*") > 0.1, "symbols")
        .when(share("A-Z") > 0.3, "shouted")
        .when(count("\n") / n > 0.03, "list")
        .otherwise("prose")
    )


def rake(sums: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, budget: float = BUDGET) -> np.ndarray:
    """Keeping probability of each cell of a three-way table of token sums, for target shares of its three margins."""
    at = np.nonzero(sums > 0)
    kept = np.zeros_like(sums)
    kept[at] = rake_cells(sums[at], at, targets, rounds, budget)
    return kept


def rake_cells(sums: np.ndarray, at: tuple[np.ndarray, ...], targets: list[np.ndarray], rounds: int = ROUNDS, budget: float = BUDGET) -> np.ndarray:
    """The same for the cells that have tokens only: their sums, and their places on each of the three margins."""
    margin = lambda k, x: np.bincount(at[k], weights=x, minlength=len(targets[k]))
    kept = np.zeros(len(sums))
    full = np.zeros(len(sums), dtype=bool)  # cells that are kept whole
    total = sums.sum()
    while (open_ := ~full).any():
        goals = [np.maximum(t * budget * total - margin(k, np.where(full, sums, 0.0)), 0) for k, t in enumerate(targets)]
        fitted = np.where(open_, sums, 0.0)
        for _ in range(rounds):
            before = fitted
            for k, goal in enumerate(goals):
                now = margin(k, fitted)
                fitted = fitted * np.divide(goal, now, out=np.zeros_like(now), where=now > 0)[at[k]]
            if np.abs(fitted - before).max() <= CLOSE * total:
                break
        _told(max(np.abs(margin(k, fitted) - goal).max(initial=0) for k, goal in enumerate(goals)), total)
        wanted = budget * total - sums[full].sum()
        if wanted <= 0 or fitted.sum() <= 0:
            kept = np.where(full, 1.0, 0.0)
            break
        kept = np.where(full, 1.0, fitted * (wanted / fitted.sum()) / sums)
        if not (kept[open_] > 1).any():
            break
        full |= kept >= 1
    return np.clip(kept, 0.0, 1.0)


def _told(miss: float, total: float) -> None:
    if miss > 1e-6 * total:  # targets that no weights can fit, or too few rounds
        logging.getLogger(__name__).warning("raking leaves a margin off its target by %.3g of all tokens", miss / total)


def _shares(cells: DataFrame, axis: str, power: float, total: float, given: dict[str, float] | None) -> DataFrame:
    """(axis, share): the target share of each value of a margin."""
    own = cells.groupBy(axis).agg(F.sum("n").alias("share"))
    if given:
        wanted = cells.sparkSession.createDataFrame([(v, float(x)) for v, x in given.items()], f"`{axis}` string, given double")
        own = own.join(wanted, axis, "left").select(axis, F.coalesce("given", F.lit(0.0)).alias("share"))
    else:
        own = own.select(axis, F.pow(F.col("share") / total, F.lit(power)).alias("share"))
    own = materialize(own, "shares")
    whole = own.agg(F.sum("share")).first()[0]
    return own.withColumn("share", F.col("share") / whole) if whole else own


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """``rake_cells`` without the driver: cells (three axes, n) with __keep; each step of a round is a written table."""
    total = float(cells.agg(F.sum("n")).first()[0])
    shares = [_shares(cells, a, p, total, (targets or {}).get(a.strip("_"))) for a, p in zip(_AXES, POWERS, strict=True)]
    now = cells.select(*_AXES, "n", F.lit(False).alias("full"))
    while True:
        whole = F.when(F.col("full"), F.col("n")).otherwise(0)
        goals = [
            materialize(now.groupBy(a).agg(F.sum(whole).alias("kept")).join(s, a).select(a, F.greatest(F.col("share") * budget * total - F.col("kept"), F.lit(0.0)).alias("goal")), "goals")
            for a, s in zip(_AXES, shares, strict=True)
        ]
        wanted = budget * total - now.agg(F.sum(whole)).first()[0]
        open_ = F.when(F.col("full"), 0.0).otherwise(F.col("n").cast("double"))
        fitted = materialize(now.withColumn("w", open_).withColumn("before", F.col("w")), "cells")
        for _ in range(rounds):
            fitted = _replace(fitted, fitted.withColumn("before", F.col("w")))
            for a, goal in zip(_AXES, goals, strict=True):
                factor = fitted.groupBy(a).agg(F.sum("w").alias("sum")).join(goal, a).select(a, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor"))
                fitted = _replace(fitted, fitted.join(factor, a).withColumn("w", F.col("w") * F.col("factor")).select(*fitted.columns))
            if fitted.agg(F.max(F.abs(F.col("w") - F.col("before")))).first()[0] <= CLOSE * total:
                break
        _told(max(fitted.groupBy(a).agg(F.sum("w").alias("sum")).join(goal, a).agg(F.max(F.abs(F.col("sum") - F.col("goal")))).first()[0] or 0 for a, goal in zip(_AXES, goals, strict=True)), total)
        mass = fitted.agg(F.sum("w")).first()[0]
        if wanted <= 0 or mass <= 0:
            return fitted.select(*_AXES, F.col("full").cast("double").alias("__keep"))
        kept = materialize(fitted.select(*_AXES, "n", "full", F.when(F.col("full"), 1.0).otherwise(F.col("w") * (wanted / mass) / F.col("n")).alias("__keep")), "kept")
        release(fitted)
        over, left = kept.agg(F.coalesce(F.bool_or(~F.col("full") & (F.col("__keep") > 1)), F.lit(False)), F.bool_or(F.col("__keep") < 1)).first()
        if not over or not left:
            return kept.select(*_AXES, F.least("__keep", F.lit(1.0)).alias("__keep"))
        now = kept.select(*_AXES, "n", (F.col("full") | (F.col("__keep") >= 1)).alias("full"))


def _replace(old: DataFrame, new: DataFrame) -> DataFrame:
    written = materialize(new, "cells")
    release(old)
    return written


def _raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float) -> DataFrame:
    """cells with __keep, raked on the driver."""
    rows = cells.collect()
    values = [sorted({r[a] for r in rows}) for a in _AXES]
    places = [{v: i for i, v in enumerate(vs)} for vs in values]
    sums = np.array([r.n for r in rows], dtype=np.float64)
    at = tuple(np.array([places[k][r[a]] for r in rows], dtype=np.int64) for k, a in enumerate(_AXES))
    goals = []
    for k, a in enumerate(_AXES):
        own = np.bincount(at[k], weights=sums, minlength=len(values[k]))
        given = (targets or {}).get(a.strip("_"))
        goal = np.array([given.get(v, 0.0) for v in values[k]]) if given else np.power(own / max(own.sum(), 1), POWERS[k])
        goals.append(goal / goal.sum() if goal.sum() else goal)
    keep = rake_cells(sums, at, goals, budget=budget)
    table = [(*(r[a] for a in _AXES), float(p)) for r, p in zip(rows, keep, strict=True)]
    return cells.sparkSession.createDataFrame(table, "`__source` string, `__lang` string, `__topic` string, `__keep` double")


def draw(seed: int = SEED) -> Column:
    """Uniform in [0, 1) by document."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def _celled(docs: DataFrame, topic: Column | None) -> dict[str, Column]:
    named = lambda c: F.coalesce(c.cast("string"), F.lit(_NULL))
    return {"__source": named(F.col("source")), "__lang": named(F.col("lang")), "__topic": named(form(F.col("text")) if topic is None else topic)}


def measured(docs: DataFrame, topic: Column | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, __source, __lang, __topic, __draw, __tokens), written: one scan of the texts."""
    path = path or public_tokenizers.path(VOCABULARY)
    own = ["doc_id", "source", "lang", *_AXES, "__draw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for b in batches:
            counts = [max(1, known.count(t.as_py() or "")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(counts, pa.int64())], [*own, "__tokens"])

    rows = docs.withColumns({**_celled(docs, topic), "__draw": draw()}).select(*own, "text")
    schema = "doc_id long, source string, lang string, __source string, __lang string, __topic string, __draw double, __tokens long"
    return materialize(rows.mapInArrow(run, schema), "measured")


def chances(known: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """(__s, __l, __t, __keep): the probability of each cell of a measured table."""
    cells = materialize(known.groupBy(*_AXES).agg(F.sum("__tokens").alias("n")), "mixing")
    few = cells.count() <= (MAX_SOURCES + 1) * (MAX_LANGS + 1) * 6
    found = F.broadcast(_raked(cells, targets, budget)) if few else rake_table(cells, targets, budget=budget)
    return found.withColumnsRenamed({"__source": "__s", "__lang": "__l", "__topic": "__t"})


def _same() -> Column:
    return (F.col("__s") == F.col("__source")) & (F.col("__l") == F.col("__lang")) & (F.col("__t") == F.col("__topic"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept), one row for each row of docs; topic: a column of docs, instead of the form."""
    known = measured(docs, topic)
    rows = known.join(chances(known, targets, budget), _same())
    return rows.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__keep").alias("probability"), (F.col("__draw") < F.col("__keep")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, topic: Column | None = None) -> DataFrame:
    """The rows of docs that are drawn, with their own columns. Nothing is shuffled but the cells' sums, as far as the driver rakes them."""
    found = chances(measured(docs, topic), targets, budget)
    return docs.withColumns(_celled(docs, topic)).join(found, _same()).where(draw() < F.col("__keep")).select(*docs.columns)

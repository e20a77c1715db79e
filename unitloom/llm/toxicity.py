"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: compatibility normalisation, lower case, letters that look like Latin ones to those, digits and signs that stand for
letters to those, invisible characters away, every other ASCII sign to a space. The lexicon holds words and word
beginnings (`` word `` and `` begin`` with the spaces as part of the pattern), so inflected forms count. Exception phrases
are patterns too: a term inside one does not count. For each word the largest weight counts; the sum over distinct words
is divided by the logarithm of the text's length, and a logistic curve over sum, count and largest weight gives the score.

Learning uses labelled documents that are not held out (crc32 of the id's text mod 4 is not 2), at most ``MAX_TRAINING`` of
them (those of smallest hash), and nothing but their text and label. Term weights are smoothed log ratios of document
shares; exception phrases are two-word contexts of terms that clean documents have and toxic ones seldom do. The lexicon is a
model of bounded size: the ``MAX_TERMS`` terms of largest weight, of those with ``LEAST_WEIGHT`` that ``LEAST_DOCS`` toxic documents
and a share of ``LEAST_SHARE`` of them have, and the ``MAX_EXCEPTIONS`` commonest phrases. These bounds are on what is
learned; every document is scored whole against all of it.

Defined results: null and empty texts score as texts without a term; texts of any length are scored whole; without any label
every score is 0; a document that is labelled more than once is toxic if one label says so; of several texts under one labelled id
the smallest is learned from; terms that tie in weight, and phrases that tie in number, go by their letters; null labels
and labels without a document are ignored; repeated rows give repeated result rows, an empty table none; other columns are
ignored, and kept by `without_toxic`.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.storage import materialize

MAX_TRAINING, MAX_TERMS, MAX_EXCEPTIONS, THRESHOLD = 20_000, 4_000, 500, 0.3
LEAST_DOCS, LEAST_SHARE, LEAST_WEIGHT, PREFIXES = 6, 0.005, 2.5, range(4, 11)
#: A term of less weight is a candidate too if so many toxic documents have it: clean ones may have it in a harmless phrase.
COMMON_WEIGHT, COMMON_SHARE = 1.0, 0.05
# Letters that look like Latin ones (Cyrillic, Greek, dotless and small capitals).
LOOKALIKES = str.maketrans(
    "абвгдеёзикмнорстухчьѕіїјһԁԛԝօοαβεικνρτυχѵӏıɑɡʏ" + "​‌‍⁠­﻿",
    "abbrdeeзukmhopctyx4bsiijhdqwooabeikvptuxvliagy" + "\0" * 6,
)
_LOOK = re.compile("[­ıɐ-ʯͰ-ԯօ​-‍⁠﻿]")
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "l"}
_ASCII = bytes(b if b >= 128 or 97 <= b <= 122 else ord(SUBSTITUTES.get(chr(b), " ")) for b in range(256))


def fold(text: str) -> str:
    """The folded text, its words each between spaces."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower()
        if _LOOK.search(text):
            text = text.translate(LOOKALIKES).replace("\0", "")
    else:
        text = text.lower()
    return " " + text.encode().translate(_ASCII).decode() + " "


def terms(word: str) -> Iterator[str]:
    """The patterns that match a folded word: itself, and its beginnings."""
    yield f" {word} "
    for n in PREFIXES:
        if n <= len(word):
            yield f" {word[:n]}"


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = ()

    def __getstate__(self):
        return self.weights, self.exceptions, self.coefficients

    def __setstate__(self, state):
        self.weights, self.exceptions, self.coefficients = state

    @cached_property
    def _matcher(self):
        found = ahocorasick.Automaton()
        for t, w in self.weights.items():
            found.add_word(t, (len(t), w))
        for t in self.exceptions:
            found.add_word(t, (len(t), None))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, folded: str) -> dict[int, float]:
        """Place of each word that counts, with its weight."""
        best, spared = self._found(folded)
        return {k: w for k, w in best.items() if not any(a <= k < b for a, b in spared)} if spared else best

    def masked(self, folded: str) -> str:
        """The text without its exception phrases."""
        for a, b in reversed(self._found(folded)[1]):
            folded = folded[: a + 1] + folded[b:] if a + 1 < b else folded
        return folded

    def _found(self, folded: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(self._matcher):
            for end, (n, w) in self._matcher.iter(folded):
                at = end - n + 1
                if w is None:
                    spared.append((at, end))
                elif w > best.get(at, 0):
                    best[at] = w
        return best, spared

    def features(self, text: str) -> tuple[float, float, float]:
        folded = fold(text)
        best = self.hits(folded)
        if not best:
            return 0.0, 0.0, 0.0
        distinct = {folded[at + 1 : folded.find(" ", at + 1)]: w for at, w in best.items()}  # a repeated word counts once
        length = 1 + folded.count(" ")
        return sum(distinct.values()) / np.log(np.e + length), float(np.log1p(len(distinct))), max(distinct.values())

    def score(self, text: str) -> float:
        if not self.coefficients:
            return 0.0
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.features(text), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _training(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled documents that are not held out; of equal texts one, lest copies make terms."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most this many ids: small enough to broadcast
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    known = texts.join(F.broadcast(chosen), F.col("__id") == F.col("doc_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialize(known.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "toxic"), "labelled")


def _counted(texts: DataFrame, count) -> DataFrame:
    """(term, n): in how many texts ``count`` finds each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                found.update(count(fold(text.as_py())))
                if len(found) > 500_000:  # bounded memory, whatever a batch holds: part counts are summed later
                    yield _counts(found)
                    found = Counter()
        yield _counts(found)

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])


def _all_terms(folded: str) -> set[str]:
    return {t for w in set(folded.split()) for t in terms(w)}


def _contexts(lexicon: Lexicon):
    def count(folded: str) -> set[str]:
        found = set()
        for at in lexicon.hits(folded):
            end = folded.find(" ", at + 1)
            before = folded[:at].rsplit(" ", 1)[-1]
            after = folded[end + 1 :].split(" ", 1)[0] if end >= 0 else ""
            word = folded[at : end + 1]
            if before:
                found.add(f" {before}{word}")
            if after:
                found.add(f"{word}{after} ")
        return found

    return count


def _weights(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, common: bool = False) -> dict[str, float]:
    found = {t: float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((clean.get(t, 0) + 0.5) / (n_clean + 1))) for t, a in toxic.items()}
    enough = lambda t, w: w >= LEAST_WEIGHT or common and w >= COMMON_WEIGHT and toxic[t] >= COMMON_SHARE * n_toxic
    found = dict(sorted(((t, w) for t, w in found.items() if enough(t, w)), key=lambda x: (-x[1], x[0]))[:MAX_TERMS])
    shorter = lambda t: (t[:n] for n in range(PREFIXES[0] + 1, len(t)))
    # a beginning that stands for one longer term is that term; a term adds nothing to a beginning that weighs about as much
    found = {t: found[t] for t in found.keys() - {s for t in found for s in shorter(t) if s in found and toxic[t] >= 0.9 * toxic[s]}}
    return {t: w for t, w in found.items() if not any(found.get(s, -9) > w - 0.7 for s in shorter(t))}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> Lexicon:
    """A lexicon from the labelled documents. Counts are summed on the executors; what the driver gets is bounded by ``most``."""
    known = _training(docs, labels, most)
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic + n_clean:
        return Lexicon()
    least = max(LEAST_DOCS, int(LEAST_SHARE * n_toxic))
    toxic = {r.term: r.n for r in _counted(known.where("toxic = 1"), _all_terms).where(F.col("n") >= least).collect()}
    wanted = frozenset(toxic)
    clean = {r.term: r.n for r in _counted(known.where("toxic = 0"), lambda folded: _all_terms(folded) & wanted).collect()}
    candidates = Lexicon(_weights(toxic, clean, n_toxic, n_clean, common=True))
    context = _contexts(candidates)
    usual = _counted(known.where("toxic = 0"), context).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "term").limit(MAX_EXCEPTIONS)
    spared = {r.term: r.n for r in usual.collect()}
    if spared:
        theirs = {r.term: r.n for r in _counted(known.where("toxic = 1"), lambda folded: context(folded) & spared.keys()).collect()}
        spared = {t: n for t, n in spared.items() if theirs.get(t, 0) * 4 < n}
    if spared:  # the terms are weighed again, without what stands in the phrases
        masks = Lexicon({}, tuple(sorted(spared)))
        again = lambda folded: _all_terms(masks.masked(folded)) & wanted
        toxic, clean = ({r.term: r.n for r in _counted(known.where(f"toxic = {k}"), again).collect()} for k in (1, 0))
        toxic = {t: n for t, n in toxic.items() if n >= least}
    weights = _weights(toxic, clean, n_toxic, n_clean)
    lexicon = Lexicon(weights, tuple(t for t in sorted(spared) if any(w in t for w in weights)))
    model = lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [model.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(3)] + [b.column(1)], ["a", "b", "c", "y"])

    seen = known.select("text", "toxic").mapInArrow(run, "a double, b double, c double, y int").groupBy("a", "b", "c", "y").count().collect()  # one row a document at most
    rows = np.array([tuple(r) for r in seen], dtype=float)
    rows = np.repeat(rows[:, :4], rows[:, 4].astype(int), axis=0)
    return Lexicon(lexicon.weights, lexicon.exceptions, _logistic(rows[:, :3], rows[:, 3]))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = [model.score(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is not predicted toxic. Rows are judged where they are read, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py() or "") < THRESHOLD for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

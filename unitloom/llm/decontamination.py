"""Benchmark decontamination by suffix arrays over the training text.

The training documents are cut into shards of about ``SHARD_WORDS`` words, whole documents each. A shard's words are
numbered by the benchmark's vocabulary (all others end a run) and its suffixes are sorted. Every suffix of the benchmark's
items that has a window's length (13 words; a shorter item is one suffix) is binary-searched to that depth: the interval
found holds all places where it stands. Suffixes that begin alike are searched once, those with a word that the
shard lacks not at all, and runs shorter than the shortest window are left out of the array, since no window can
start there. Each place found is then lengthened: its text is searched among the sorted suffixes of the benchmark that
begin with the same window, and the better neighbour gives its longest verbatim match, and where that stands in which item.
A shard is built and searched in one task, so nothing is shuffled. `matches` gives the maximal matches with their
locations, `contamination` one row a document, `decontaminate` the documents that are left.

The benchmark goes to the tasks in chunks of at most ``CHUNK_WORDS`` words (or one item): two million are one pass. Beyond that
size, documents are searched chunk by chunk and hits are merged for each text, with the same result.

Defined results: null and empty texts have no words, no hits, and the digest of the empty string; texts of any length are
searched whole; repeated rows give repeated result rows, an empty table none; items without words have no window; items
that share an id count as one; a null item_id marks words as hit but is in no list; an empty benchmark hits nothing; of
matches that tie in length the first in the document counts, and of items the smallest by id and text. Other columns
are ignored, and kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.llm.words import raw, words
from unitloom.storage import materialize

WINDOW, SHARD_WORDS, CHUNK_WORDS, _BLOCK, _STEP = 13, 1_000_000, 2_000_000, 20_000, 16
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long"


def _ranks(text: np.ndarray, total: int, depth: int) -> np.ndarray:
    """Ranks of the first ``total`` suffixes of a text by their first ``depth`` words at least; zeros end what is compared."""
    rank, h = text[:total].astype(np.int64), 1
    while h < depth and total:
        ahead = np.zeros(total, dtype=np.int64)
        ahead[: max(0, total - h)] = rank[h:] + 1
        rank = np.unique(rank * (total + int(rank.max()) + 2) + ahead, return_inverse=True)[1]
        h *= 2
        if len(rank) and rank.max() == total - 1:  # all differ
            break
    return rank


class TestItems:
    """The words of some benchmark items, one after the other with a zero after each, their sorted suffixes and their windows.

    Windows that are equal have one number: ``start`` and ``size`` of it, the items it is from, and the part
    of the sorted suffixes that begin with it.
    """

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        items = sorted(items, key=lambda x: (x[0] is None, str(x[0]), x[1]))
        parts = [np.array([*map(number, words(text)), 0], dtype=np.int32) for _, text in items]
        count = np.array([len(p) for p in parts], dtype=np.int64)
        self.names = [None if i is None else str(i) for i, _ in items]
        self.first = np.cumsum(count) - count
        total, longest = int(count.sum()), int(count.max(initial=1))
        self.text = np.concatenate([*parts, np.zeros(max(window, _STEP) + 1, dtype=np.int32)])
        self.order = np.argsort(_ranks(self.text, total, longest), kind="stable").astype(np.int32)
        at = np.arange(total) - np.repeat(self.first, count)
        left = np.repeat(count - 1, count) - at  # words of the item from here on
        full = np.repeat(count - 1, count) >= window
        starts = np.flatnonzero(np.where(full, left >= window, (at == 0) & (left > 0)))
        sizes = np.minimum(left[starts], window)
        place = np.empty(total, dtype=np.int64)
        place[self.order] = np.arange(total)
        owner = np.searchsorted(self.first, starts, side="right") - 1
        found_start, found_size, pairs, low, high = [], [], [], [], []
        self.by_length: dict[int, slice] = {}
        for size in sorted(set(sizes.tolist())):
            own = np.flatnonzero(sizes == size)
            _, head, of = np.unique(self.text[starts[own][:, None] + np.arange(size)], axis=0, return_index=True, return_inverse=True)
            n, base = len(head), sum(map(len, found_start))
            self.by_length[size] = slice(base, base + n)
            found_start.append(starts[own][head])
            found_size.append(np.full(n, size))
            named = np.array([self.names[i] is not None for i in owner[own].tolist()], dtype=bool)
            pairs.append(np.unique(np.column_stack([of.ravel() + base, owner[own]])[named], axis=0))
            a, b = np.full(n, total, dtype=np.int64), np.zeros(n, dtype=np.int64)
            np.minimum.at(a, of.ravel(), place[starts[own]])
            np.maximum.at(b, of.ravel(), place[starts[own]] + 1)
            low.append(a)
            high.append(b)
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        self.start, self.size, self.low, self.high, self.window = joined(found_start), joined(found_size), joined(low), joined(high), window
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)
        self.owner_bounds, self.owners = np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1)), pairs[:, 1]

    def owned(self, numbers: np.ndarray) -> set[str]:
        """The ids of the items that have any of the windows."""
        return {self.names[i] for k in numbers.tolist() for i in self.owners[self.owner_bounds[k] : self.owner_bounds[k + 1]].tolist()}

    def lengthen(self, text: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of a window in a text (zeros at its end): words of the longest match from there with an item
        that has the window there, and where that begins in this text."""
        low, high = self.low[which].copy(), self.high[which].copy()
        end = high.copy()
        first = low.copy()
        whole = self.size[which] < self.window  # the item ends there
        low[whole] = high[whole]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            _, below = self._against(text, at[open_], self.order[mid].astype(np.int64))
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        best, origin = self.size[which].copy(), self.start[which].copy()
        for side in (low, low - 1):  # the later neighbour counts only if it is better
            ok = np.flatnonzero(~whole & (side >= first) & (side < end))
            there = self.order[side[ok]].astype(np.int64)
            n, _ = self._against(text, at[ok], there)
            better = n >= best[ok]
            best[ok[better]], origin[ok[better]] = n[better], there[better]
        return best, origin

    def _against(self, text: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that suffixes of a text and of this one have in common, and whether those of this one come before."""
        n, below = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
        live, step = np.arange(len(at)), np.arange(_STEP)
        while live.size:
            x = text[np.minimum(at[live] + n[live], len(text) - _STEP)[:, None] + step]
            y = self.text[np.minimum(there[live] + n[live], len(self.text) - _STEP)[:, None] + step]
            differ = (x != y) | (x == 0)
            k, odd = differ.argmax(axis=1), differ.any(axis=1)
            row = np.arange(len(live))
            n[live] += np.where(odd, k, _STEP)
            below[live[odd]] = (y[row, k] < x[row, k])[odd]
            live = live[~odd]
        return n, below


class SuffixArray:
    """Suffixes of the runs of known words in a shard, sorted by their first ``depth`` words."""

    def __init__(self, ids: np.ndarray, least: int, depth: int):
        known = ids > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= least
        start, size = start[long], (stop - start)[long]
        total = int((size + 1).sum())
        first = np.cumsum(size + 1) - (size + 1)
        self.text = np.zeros(total + max(depth, _STEP) + 1, dtype=np.int32)
        self.place = np.full(total, -1, dtype=np.int64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        to, origin = np.repeat(first, size) + at, np.repeat(start, size) + at
        self.text[to], self.place[to] = ids[origin], origin
        self.order = np.argsort(_ranks(self.text, total, depth), kind="stable")

    def intervals(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word numbers, the part of the order whose suffixes begin with it."""
        return self._bound(patterns, False), self._bound(patterns, True)

    def _bound(self, patterns: np.ndarray, after_equal: bool) -> np.ndarray:
        n, size = patterns.shape
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(self.order), dtype=np.int64)
        row, step = np.arange(n), np.arange(size)
        while (open_ := low < high).any():
            mid = np.minimum((low + high) >> 1, len(self.order) - 1)
            seen = self.text[self.order[mid][:, None] + step]
            differ = seen != patterns
            k = differ.argmax(axis=1)
            below = np.where(differ[row, k], seen[row, k] < patterns[row, k], after_equal)
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        return low


@dataclass
class Hits:
    """What is found in a shard, by place: the place, its window, words of the longest match from there, and where that begins in the items."""

    at: np.ndarray
    which: np.ndarray
    length: np.ndarray
    origin: np.ndarray

    def slice(self, a: int, b: int) -> Hits:
        return Hits(self.at[a:b], self.which[a:b], self.length[a:b], self.origin[a:b])


def locate(ids: np.ndarray, test: TestItems) -> Hits:
    """Every occurrence of a window in a shard's word numbers, with its longest match."""
    sizes = list(test.by_length)
    none = np.zeros(0, dtype=np.int64)
    if not sizes:
        return Hits(none, none, none, none)
    array = SuffixArray(ids, sizes[0], sizes[-1])
    inside, which = [none], [none]
    if len(array.order):
        there = np.zeros(len(test.vocabulary) + 1, dtype=bool)
        there[array.text] = True
        lacks = np.concatenate([[0], np.cumsum(~there[test.text])])
        for size, numbers in test.by_length.items():
            numbers = np.arange(numbers.start, numbers.stop)
            start = test.start[numbers]
            numbers = numbers[lacks[start + size] == lacks[start]]
            for i in range(0, len(numbers), _BLOCK):
                some = numbers[i : i + _BLOCK]
                low, high = array.intervals(test.text[test.start[some][:, None] + np.arange(size)])
                n = high - low
                spread = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                inside.append(array.order[np.repeat(low, n) + spread])
                which.append(np.repeat(some, n))
    inside, which = np.concatenate(inside), np.concatenate(which)
    length, origin = test.lengthen(array.text, inside, which)
    at = array.place[inside]
    order = np.lexsort((which, at))
    return Hits(at[order], which[order], length[order], origin[order])


@dataclass
class Found:
    """A document's words, the places of those hit, its items, its longest match and where it begins (-1 without one), and all its hits (by word)."""

    words: int
    places: np.ndarray
    items: set[str]
    longest: int
    longest_at: int
    hits: Hits

    @property
    def contaminated(self) -> bool:
        return len(self.places) > 0 and 20 * len(self.places) >= self.words

    def row(self) -> tuple:
        digest = hashlib.sha256(",".join(sorted(self.items)).encode()).hexdigest()
        return self.words, len(self.places), len(self.items), digest, self.contaminated, self.longest, self.longest_at


def _search(counts: list[int], ids: np.ndarray, test: TestItems) -> Iterator[Found]:
    """What is found in each document of a shard. A zero ends each document."""
    starts = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
    hits = locate(ids, test)
    cover = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(cover, hits.at, 1)
    np.add.at(cover, hits.at + test.size[hits.which], -1)
    hit = np.cumsum(cover) > 0
    bounds = np.searchsorted(hits.at, starts)
    for d, n in enumerate(counts):
        a, b = bounds[d], bounds[d + 1]
        own = hits.slice(a, b)
        own.at = own.at - starts[d]
        best = int(own.length.argmax()) if b > a else None  # the first of the longest
        yield Found(
            n, np.flatnonzero(hit[starts[d] : starts[d + 1]]) if b > a else np.zeros(0, dtype=np.int64), test.owned(np.unique(own.which)),
            0 if best is None else int(own.length[best]), -1 if best is None else int(own.at[best]), own,
        )


def _shards(batches: Iterator[pa.RecordBatch], test: TestItems, keyed: bool = False) -> Iterator[tuple[object, bytes, Found]]:
    """(doc_id, digest of the text, what is found) of every document, shard by shard."""
    known = test.vocabulary.get
    held: list[tuple[object, bytes]] = []
    parts: list[np.ndarray] = []
    counts: list[int] = []

    def flush():
        if held:
            for (doc_id, key), found in zip(held, _search(counts, np.concatenate(parts), test), strict=True):
                yield doc_id, key, found
        held.clear(), parts.clear(), counts.clear()

    total = 0
    for b in batches:
        for doc_id, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ws = words(text := raw(value))
            parts.append(np.array([*[known(w, 0) for w in ws], 0], dtype=np.int32))
            held.append((doc_id, hashlib.sha256(text).digest() if keyed else b""))
            counts.append(len(ws))
            total += len(ws) + 1
            if total >= SHARD_WORDS:
                yield from flush()
                total = 0
    yield from flush()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _rows(held, schema)
            held = []
    if held:
        yield _rows(held, schema)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()), ("longest_at", pa.int64())])
_PART = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("at", pa.int64())])
_MATCH = pa.schema([("doc_id", pa.int64()), ("doc_word", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64()), ("n_words", pa.int64())])


def _chunks(benchmark: DataFrame, chunk_words: int) -> list[DataFrame]:
    """The benchmark in parts of about chunk_words words; one part if it is that small."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    n = int(items.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0) // chunk_words + 1  # a word and its gap take two bytes at least
    if n == 1:
        return [items]
    items = materialize(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "benchmark")
    return [items.where(F.col("part") == k).drop("part") for k in range(n)]


def _shared(chunk: DataFrame):
    return chunk.sparkSession.sparkContext.broadcast(TestItems([(r.item_id, bytes(r.text or b"")) for r in chunk.toLocalIterator()]))


def contamination(docs: DataFrame, benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row for each document, as in ``REPORT``; longest_match: words of its longest verbatim match of a window's length or more, longest_at: its first word there, -1 without one."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    chunks = _chunks(benchmark, chunk_words)
    if len(chunks) == 1:
        shared = _shared(chunks[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batched(((doc_id, *found.row()) for doc_id, _, found in _shards(batches, shared.value)), _OUT)

        return texts.mapInArrow(run, REPORT)
    told = _merged(texts, chunks)
    keyed = texts.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit(b"")), 256)).alias("key"))
    return keyed.join(told, "key").drop("key")


def matches(docs: DataFrame, benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, doc_word, item_id, item_word, n_words): the verbatim matches of a window's length or more that are not within
    a longer one, with the first word of each in the document and in an item; of several items the one that sorts first."""
    texts, every = docs.select("doc_id", F.col("text").cast("binary").alias("text")), None
    for chunk in _chunks(benchmark, chunk_words):
        found = texts.mapInArrow(_located(_shared(chunk)), "doc_id long, doc_word long, item_id string, item_word long, n_words long")
        every = found if every is None else every.unionByName(found)
    return every


def _located(shared):
    def rows(doc_id: object, hits: Hits, test: TestItems) -> Iterator[tuple]:
        end = 0  # matches within one that began before end where it does, or sooner
        for at, n, g in zip(hits.at.tolist(), hits.length.tolist(), hits.origin.tolist(), strict=True):
            if at + n > end:
                end, item = at + n, int(np.searchsorted(test.first, g, side="right")) - 1
                yield doc_id, at, test.names[item], g - int(test.first[item]), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        yield from _batched((r for doc_id, _, found in _shards(batches, test) for r in rows(doc_id, found.hits, test)), _MATCH)

    return run


def _merged(texts: DataFrame, chunks: list[DataFrame]) -> DataFrame:
    """The report of each distinct text (key: its SHA-256), searched chunk by chunk."""
    parts = [
        materialize(texts.mapInArrow(_partial(_shared(chunk)), "key binary, n_words long, places array<long>, items array<string>, longest long, at long"), "hits")
        for chunk in chunks
    ]
    every = parts[0].dropDuplicates(["key"])
    for p in parts[1:]:  # one row of a text from each chunk
        every = every.unionByName(p.dropDuplicates(["key"]))
    merged = every.groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max(F.struct("longest", (-F.col("at")).alias("at"))).alias("best"),
    )
    n_hit = F.size("places").cast("long")
    told = merged.select(
        "key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.col("best.longest").alias("longest_match"), (-F.col("best.at")).alias("longest_at"),
    )
    return materialize(told, "contamination")


def _partial(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _shards(batches, shared.value, keyed=True)
        yield from _batched(((key, f.words, f.places.tolist(), sorted(f.items), f.longest, f.longest_at) for _, key, f in told), _PART, 256)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The rows of docs whose text is not contaminated. With one chunk, rows are judged where they are read; with more, by text."""
    chunks = _chunks(benchmark, chunk_words)
    if len(chunks) > 1:
        key = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
        texts = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", key.alias("key")).dropDuplicates(["key"])
        bad = _merged(texts.select("doc_id", F.col("text").cast("binary").alias("text")), chunks).where("contaminated").select(F.lower(F.hex("key")).alias("__bad"))
        return docs.join(bad, key == F.col("__bad"), "left_anti")
    shared = _shared(chunks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column("text").cast(pa.binary())], ["doc_id", "text"])
            keep = [not found.contaminated for _, _, found in _shards(iter([numbered]), shared.value)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

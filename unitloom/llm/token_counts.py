"""Exact token counts by prefix dynamic programming over byte-level BPE.

A text is cut at added special tokens and then into pieces by the vocabulary's splitting pattern; pieces are encoded alone.
Within a piece the last token of every prefix is found from left to right: it is the one vocabulary entry that ends the
prefix and may follow the last token of the prefix before it, where a pair of tokens may stand together exactly if their
joined bytes encode to that pair. So one pass stores the exact token count of every prefix of the piece, and the
counts at piece ends are summed. `PrefixCounts` answers "how many tokens has text[:p]" and "how much fits n tokens"
from these tables. A prefix of a piece is a piece itself, so its count is read from the piece's table; white space before the
cut is a piece of its own, with a table of its own. Contractions and special tokens that are cut are a few
signs, whose table is made with what they join. A table is made once, when first asked for, and nothing is encoded again.

Defined results: null and empty texts have no bytes and no tokens; added special tokens in a text count as one token,
as is the library's default; nothing is added, truncated or padded; texts of any length, and one piece of any length, are
counted whole in linear time; repeated rows give repeated result rows, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import bisect
import copy
import json
from collections.abc import Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY, LIMIT, _MOST_CACHED, _LONG = "byte_bpe_50k.json", 512, 800_000, 256
#: Outside these, Unicode versions differ in what is a letter, so the tokenizer's own splitter is asked.
_OTHER = regex.compile("[^\x00-ԯ -⁯]")


# The white space of Unicode, and the contractions that the splitting pattern takes first.
_SPACES = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")
_CONTRACTION = regex.compile("'(?:s|t|re|ve|m|ll|d)")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: itself if it prints, else the next one from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Counts(dict):
    """Token counts of pieces, computed when first asked for; bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        n = self.encoder.prefix_counts(piece)[-1]
        if len(piece) <= _LONG:
            if len(self) >= _MOST_CACHED:
                self.clear()
            self[piece] = n
        return n


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: "".join(chr(letters[c]) for c in s)  # noqa: E731  a letter of U+0000 to U+00FF for each byte
        tokens = list(map(raw, spec["model"]["vocab"]))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.halves = {a + b: (a, b) for a, b in self.ranks}
        if len(self.halves) < len(self.ranks) or not self.halves.keys() <= set(tokens):
            raise ValueError("each merge must make a token of its own")
        self.longest = max(map(len, tokens))
        self.used = [t for t in tokens if len(t) == 1 or t in self.halves]  # an entry that no merge makes is never used
        special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.path, self._splitter = path, None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.counts = _Counts(self)

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """Made when a piece is first looked through."""
        found = ahocorasick.Automaton()
        for t in self.used:
            found.add_word(t, t)
        found.make_automaton()
        return found

    def may_follow(self, a: str, b: str) -> bool:
        """Whether a and b stay two tokens when their bytes are encoded together.

        Seen from the seam, both sides are taken apart, the later merge first. They stay apart unless two parts that
        meet at the seam would have merged before: earlier than the merge just undone, or as early but further left.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= _MOST_CACHED:
                self.pairs.clear()
            known = self.pairs[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        ranks, halves, before = self.ranks, self.halves, len(self.ranks)
        while True:
            if ranks.get((a, b), before) < before:
                return False
            left, right = ranks.get(halves.get(a), -1), ranks.get(halves.get(b), -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                a, before = halves[a][1], left
            else:
                b, before = halves[b][0], right + 1

    def prefix_counts(self, piece: str) -> list[int]:
        """The token count of every byte prefix of a piece, from the empty one on."""
        data = piece.encode().decode("latin-1")
        counts, last, follow = [0] * (len(data) + 1), [""] * (len(data) + 1), self.may_follow
        for end, token in self.matcher.iter(data):  # every entry that ends at each byte, the longest first
            end += 1
            if not last[end]:
                start = end - len(token)
                if not start or follow(last[start], token):
                    counts[end] = counts[start] + 1
                    last[end] = token
        return counts

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if not text.isascii() and _OTHER.search(text):
            if self._splitter is None:
                from tokenizers import Tokenizer

                self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text in order, and whether each is a special token."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def plain(self) -> Encoder:
        """The same without special tokens."""
        other = copy.copy(self)
        other.special = None
        return other

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            return sum(1 if special else sum(map(self.counts.__getitem__, self.pieces(part))) for part, special in self.parts(text))
        return sum(map(self.counts.__getitem__, self.pieces(text)))


class PrefixCounts:
    """Token counts at every prefix of one text (prefixes are counted in characters)."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        self.starts, self.before, self.special = [], [], []
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        at = total = 0
        for part, special in encoder.parts(text):
            for piece in [part] if special else encoder.pieces(part):
                self.starts.append(at)
                self.before.append(total)
                self.special.append(special)
                at += len(piece)
                total += 1 if special else encoder.counts[piece]
        self.total = total

    def _end(self, j: int) -> int:
        return self.starts[j + 1] if j + 1 < len(self.starts) else len(self.text)

    def _table(self, start: int, end: int) -> np.ndarray:
        """Token counts of text[start:p], which is one piece, for each p from start to end."""
        known = self.tables.get((start, end))
        if known is None:
            part = self.text[start:end]
            counts = np.array(self.encoder.prefix_counts(part), dtype=np.int64)
            if part.isascii():
                known = counts
            else:
                known = counts[np.concatenate([[0], np.cumsum([len(c.encode()) for c in part])])]
            self.tables[start, end] = known
        return known

    def _piece(self, j: int) -> tuple[int, np.ndarray]:
        """Where piece j's own signs begin (after a space before them), and the counts of text[:p] for p from its start to its end."""
        start, end = self.starts[j], self._end(j)
        piece = self.text[start:end]
        blank = _SPACES.match(piece).end()
        found = np.empty(end - start + 1, dtype=np.int64)
        found[0] = self.before[j]
        if blank:  # white space up to the cut is one piece, with what stands before it
            k = j
            while k and not self.special[k - 1] and _SPACES.fullmatch(self.text, self.starts[k - 1], self._end(k - 1)):
                k -= 1
            run = self._table(self.starts[k], start + blank)
            found[: blank + 1] = self.before[k] + run[start - self.starts[k] :]
        if blank < len(piece):
            if _CONTRACTION.fullmatch(piece):  # cut, it is no contraction
                found[1:] = [self.before[j] + sum(self.encoder.prefix_counts(t)[-1] for t in self.encoder.pieces(piece[:n])) for n in range(1, len(piece) + 1)]
            else:
                found[blank + 1 :] = self.before[j] + self._table(start, end)[blank + 1 :]
        return found

    def _cut_special(self, j: int) -> np.ndarray:
        """The counts of text[:p] for p from special token j's start to its end; cut, it is plain text that may join what stands before."""
        k = j
        while k and not self.special[k - 1] and (k == j or _SPACES.fullmatch(self.text, self.starts[k], self._end(k))):
            k -= 1
        start, end = self.starts[j], self._end(j)
        tail = PrefixCounts(self.encoder.plain(), self.text[self.starts[k] : end - 1])
        inside = [tail.at(p - self.starts[k]) for p in range(start, end)]
        return np.array([*(self.before[k] + x for x in inside), self.before[j] + 1], dtype=np.int64)

    def _counts(self, j: int) -> np.ndarray:
        known = self.tables.get((j, -1))
        if known is None:
            known = self.tables[j, -1] = self._cut_special(j) if self.special[j] else self._piece(j)
        return known

    def at(self, p: int) -> int:
        """Tokens of text[:p]."""
        if p >= len(self.text):
            return self.total
        if p <= 0:
            return 0
        j = bisect.bisect_right(self.starts, p - 1) - 1
        return int(self._counts(j)[p - self.starts[j]])

    def fit(self, n: int) -> int:
        """Characters of the longest prefix with at most n tokens, among those up to the end of the first piece beyond n."""
        if self.total <= n:
            return len(self.text)
        j = bisect.bisect_right(self.before, n) - 1
        return self.starts[j] + int(np.flatnonzero(self._counts(j) <= n)[-1])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars); fit_chars: characters that fit the limit."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            sizes, counts, fits = [], [], []
            for value in b.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(n := e.count(text))
                fits.append(len(text) if n <= limit else _fit(e, text, limit))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def _fit(e: Encoder, text: str, limit: int) -> int:
    """`PrefixCounts.fit` from a beginning of the text that goes safely beyond the limit."""
    size = 4 * limit
    while True:
        known = PrefixCounts(e, text[:size])
        if size >= len(text) or len(known.before) > 4 and known.before[-4] > limit:
            return known.fit(limit)
        size *= 2

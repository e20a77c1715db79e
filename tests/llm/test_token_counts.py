import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from unitloom.llm.token_counts import VOCABULARY, PrefixCounts, _fit, encoder, token_counts

PATH = public_tokenizers.path(VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
PIECES = [*"aeiou", "thing", "THE", "'s", "'ll", "''re", " ", "  ", "\n", "\n\n\t", "<|endoftext|>", "<|end", "é", "文字", "1234", "!!??", "=" * 9, "a" * 40, "кот", "\U0001f600", " ", "​", "ஃ", "\U0003fc2c", "԰"]


def known(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_every_prefix_has_the_librarys_count(text):
    e, table = encoder(PATH), None
    table = PrefixCounts(e, text)
    assert e.count(text) == known(text)
    assert [table.at(p) for p in range(len(text) + 1)] == [known(text[:p]) for p in range(len(text) + 1)]


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder(PATH).count(text) == known(text)


def test_prefix_counts_of_one_piece():
    e = encoder(PATH)
    assert e.prefix_counts("tokenization") == [known("tokenization"[:i]) for i in range(13)]


@pytest.mark.parametrize("n", [1, 7, 60])
def test_fit(n):
    rng, e = random.Random(n), encoder(PATH)
    for _ in range(40):
        text = "".join(rng.choice(PIECES) + " " for _ in range(50))
        p = _fit(e, text, n)
        assert known(text[:p]) <= n
        assert p == PrefixCounts(e, text).fit(n)


def test_table(spark, documents, edges):
    found = sorted(map(tuple, token_counts(documents(edges, clash=True)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    assert found == sorted(((i, len((t or "").encode()), known(t or ""), known(t or "") > 512) for i, t in edges), key=str)
    assert token_counts(documents([])).count() == 0


def test_one_long_piece_fits_in_linear_time():
    e, rng = encoder(PATH), random.Random(0)
    for text in ("".join(rng.choices("abcdefghijklmnop", k=1_000_000)), " " * 300_000, "=" * 300_000 + "<|endoftext|>", "x<|endoftext|" * 20_000):
        began = time.perf_counter()
        p = _fit(e, text, 512)
        assert time.perf_counter() - began < 30
        assert known(text[:p]) <= 512
    text = "".join(rng.choices("abcdefghij", k=3_000))
    assert [PrefixCounts(e, text).at(p) for p in (1, 500, 2_999)] == [known(text[:p]) for p in (1, 500, 2_999)]
    assert max(p for p in range(3_001) if known(text[:p]) <= 512) == _fit(e, text, 512)


def test_white_space_before_the_cut():
    e = encoder(PATH)
    for text in ("a \u2003 \x1c b", "  \n\n  x", "\x85\xa0 \u3000y", "one   two's  \t'll", "<|endoftext|>  <|endoftext|>\n <|end", "!!<|endoftext|>!!", " 's' d'dd"):
        table = PrefixCounts(e, text)
        assert [table.at(p) for p in range(len(text) + 1)] == [known(text[:p]) for p in range(len(text) + 1)], text

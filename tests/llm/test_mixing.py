import random

import numpy as np
import public_tokenizers
import pytest

from unitloom.llm import mixing
from unitloom.llm.mixing import mixed, rake, sample
from unitloom.llm.token_counts import VOCABULARY, encoder


def corpus(n=4000):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        source = "big" if rng.random() < 0.4 else f"s{rng.randrange(5)}"
        kind = rng.random()
        text = "| a | b |\n" * 40 if kind < 0.2 else "WORD " * 60 if kind < 0.3 else "some words of prose " * rng.randint(1, 40)
        rows.append((i, text, rng.choice(["en", "en", "de", "fr", None]), source, len(text)))
    return rows


def brute_rake(sums, targets, rounds=500):
    """Raking by loops, without caps."""
    w = sums.copy()
    for _ in range(rounds):
        for k, t in enumerate(targets):
            axes = tuple(i for i in range(3) if i != k)
            factor = t * sums.sum() / w.sum(axis=axes)
            w *= factor.reshape([-1 if i == k else 1 for i in range(3)])
    return w


def test_raking_agrees_with_loops_and_fits_the_margins():
    rng = np.random.default_rng(0)
    sums = rng.uniform(50, 150, (3, 2, 4))
    targets = [np.array([0.3, 0.3, 0.4]), np.array([0.45, 0.55]), np.full(4, 0.25)]
    keep = rake(sums, targets, budget=0.3)
    expected = 0.3 * brute_rake(sums, targets)
    assert np.allclose(keep * sums, expected, rtol=1e-6)
    for k, t in enumerate(targets):
        axes = tuple(i for i in range(3) if i != k)
        assert np.allclose((keep * sums).sum(axis=axes), t * 0.3 * sums.sum(), rtol=1e-6)


def test_short_cells_are_kept_whole_and_the_budget_holds():
    sums = np.array([[[1000.0], [10.0]], [[500.0], [5.0]]])
    keep = rake(sums, [np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.array([1.0])], budget=0.5)
    assert keep.max() <= 1 and keep[:, 1].min() == 1
    assert (keep * sums).sum() == pytest.approx(0.5 * sums.sum(), rel=1e-6)


@pytest.mark.parametrize("shape", [(0, 0, 0), (1, 1, 1)])
def test_raking_of_little(shape):
    keep = rake(np.ones(shape), [np.ones(s) for s in shape])
    assert keep.shape == shape and (keep <= 1).all()


def test_sample_follows_the_probabilities(documents):
    docs = documents(corpus(), clash=True)
    found = mixed(docs).toPandas()
    assert len(found) == 4000 and found.probability.between(0, 1).all()
    kept = found[found.kept]
    total = found.n_tokens.sum()
    assert kept.n_tokens.sum() / total == pytest.approx(mixing.BUDGET, abs=0.03)
    expected = (found.n_tokens * found.probability).groupby(found.source).sum()
    own = found.groupby("source").n_tokens.sum() / total
    goal = own**mixing.POWERS[0] / (own**mixing.POWERS[0]).sum()
    assert np.abs(expected / expected.sum() - goal).max() < 0.02
    assert np.abs(kept.groupby("source").n_tokens.sum() / kept.n_tokens.sum() - goal).max() < 0.04
    assert {r.doc_id for r in sample(docs).collect()} == set(kept.doc_id)
    assert sample(docs).columns == docs.columns


def test_given_targets(documents):
    docs = documents(corpus())
    found = mixed(docs, {"source": {"big": 0.1, **{f"s{i}": 0.18 for i in range(5)}}}, budget=0.3).toPandas()
    mass = (found.n_tokens * found.probability).groupby(found.source).sum()
    assert np.allclose(mass / mass.sum(), [0.1, *[0.18] * 5], atol=1e-6)


def test_pooled_sources_are_not_dropped(documents, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    found = mixed(documents(corpus(500))).toPandas()
    assert len(found) == 500 and found.source.nunique() == 6 and found.probability.min() > 0


def test_edges(documents, edges):
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", 1) for k, (i, t) in enumerate(edges)]
    found = mixed(documents(rows, clash=True), budget=1.0).collect()
    assert len(found) == len(edges) and all(r.kept for r in found)
    assert {r.n_tokens for r in found if r.doc_id == 1} == {1}
    assert mixed(documents([])).count() == 0 and sample(documents([])).count() == 0
    assert len({r.kept for r in mixed(documents(rows)).collect() if r.doc_id == 4}) == 1


def many_sources(n=300):
    """One large source and n small ones, which have a document in each of two languages."""
    rows = [(i, "some words of prose " * 40, "en", "big", 1) for i in range(400)]
    return rows + [(1000 + 2 * i + k, "some words of prose " * 12, lang, f"s{i}", 1) for i in range(n) for k, lang in enumerate(("en", "de"))]


def test_each_of_many_sources_gets_its_own_target(documents):
    found = mixed(documents(many_sources()), budget=0.2).toPandas()
    mass = (found.n_tokens * found.probability).groupby(found.source).sum()
    own = found.groupby("source").n_tokens.sum() / found.n_tokens.sum()
    goal = own ** mixing.POWERS[0] / (own ** mixing.POWERS[0]).sum()
    assert np.allclose(mass / mass.sum(), goal, rtol=1e-6)


def test_a_given_target_counts_for_any_source(documents):
    found = mixed(documents(many_sources()), {"source": {"s99": 0.001, "big": 0.999}, "lang": {"en": 1.0}}, budget=0.1).toPandas()
    mass = (found.n_tokens * found.probability).groupby(found.source).sum()
    assert mass["s99"] / mass.sum() == pytest.approx(0.001, rel=1e-6)


@pytest.mark.parametrize(("targets", "budget"), [(None, 0.2), ({"source": {"big": 0.2, "s1": 0.5, "s2": 0.3}}, 0.1)])
def test_cells_in_a_table_are_raked_alike(documents, monkeypatch, targets, budget):
    docs = documents(corpus(80))
    expected = {r.doc_id: r.probability for r in mixed(docs, targets, budget).collect()}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 0)
    monkeypatch.setattr(mixing, "MAX_LANGS", 0)
    found = {r.doc_id: r.probability for r in mixed(docs, targets, budget).collect()}
    assert found.keys() == expected.keys() and all(found[i] == pytest.approx(expected[i], rel=1e-6) for i in found)


def test_tokens_are_those_of_the_vocabulary(documents):
    e = encoder(public_tokenizers.path(VOCABULARY))
    rng = random.Random(1)
    texts = ["", None, "x" * 5_000, " " * 3_000, "a<|endoftext|>b", *("".join(rng.choices(["é", "word ", "  ", "1234", "'ll", "\u6587\u5b57", "!!", "\n", "<|end"], k=60)) for _ in range(200))]
    found = {r.doc_id: r.n_tokens for r in mixed(documents(list(enumerate(texts)))).collect()}
    assert found == {i: max(1, e.count(t or "")) for i, t in enumerate(texts)}


def test_a_topic_that_is_given(documents):
    from pyspark.sql import functions as F

    docs = documents(corpus(600)).withColumn("subject", F.when(F.col("doc_id") % 3 == 0, "law").when(F.col("doc_id") % 3 == 1, "news"))
    found = mixed(docs, {"topic": {"law": 0.7, "news": 0.2, "(null)": 0.1}}, budget=0.2, topic=F.col("subject")).toPandas()
    mass = (found.n_tokens * found.probability).groupby(found.topic).sum()
    assert mass["law"] / mass.sum() == pytest.approx(0.7, rel=1e-6)
    assert sample(docs, budget=0.5, topic=F.col("subject")).columns == docs.columns


def test_rows_without_ids_are_drawn_apart_and_raking_says_what_it_misses(documents, caplog):
    rows = [(None, f"some words of prose {i} " * 20) for i in range(400)]
    kept = [r.kept for r in mixed(documents(rows), budget=0.5).collect()]
    assert 120 < sum(kept) < 280
    rake(np.array([[[1.0], [0.0]], [[0.0], [1.0]]]), [np.array([0.3, 0.7]), np.array([0.6, 0.4]), np.array([1.0])], rounds=3, budget=0.1)
    assert "off its target" in caplog.text

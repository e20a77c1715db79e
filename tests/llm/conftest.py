import pytest


@pytest.fixture
def documents(spark):
    """Makes a documents table; rows are (doc_id, text) or whole rows, and columns with clashing names are added if asked."""

    def make(rows, clash=False):
        full = [(*r, "en", "s", len(r[1] or "")) if len(r) == 2 else r for r in rows]
        found = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            from pyspark.sql import functions as F

            names = "key node fp id n size shard slot score predicted n_words n_hit component component_id fingerprint kept part rank term gone line words n_tokens topic place low high probability".split()
            found = found.withColumns({c: F.lit("x") for c in names})
        return found

    return make


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (4, "Word"), (5, "é 文字 \U0001f600"), (None, "no id"), (6, "the cat sat on the mat " * 20_000)]


@pytest.fixture
def edges():
    """Null, empty and blank texts, a repeated row, signs of other scripts, no id, a very long text."""
    return EDGES

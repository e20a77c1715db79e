import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from unitloom.llm import simhash_dedup as op
from unitloom.llm.golay import GENERATOR, codeword_index, nearby_indices


def brute_fingerprint(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs: (doc_id, fingerprint)"""
    root = {i: i for i, _ in pairs}
    for _ in root:
        before = dict(root)
        for a, x in pairs:
            for b, y in pairs:
                if (x ^ y).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return root
    return root


def test_codewords_keep_their_index_under_three_errors():
    rng = np.random.default_rng(0)
    codes = []  # multiples of the generator
    for index in rng.integers(0, 1 << 12, 500).tolist():
        code = 0
        for b in range(12):
            if index >> b & 1:
                code ^= GENERATOR << b
        codes.append(code)
    for code in codes:
        bits = rng.choice(23, 3, replace=False)
        words = np.array([code, code ^ (1 << int(bits[0])), code ^ (1 << int(bits[0])) ^ (1 << int(bits[1])), code ^ sum(1 << int(b) for b in bits)])
        assert set(codeword_index(words).tolist()) == {code >> 11}


def test_two_errors_share_an_index():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    errors = (1 << rng.integers(0, 23, 4000)) | (1 << rng.integers(0, 23, 4000))
    a, b = nearby_indices(words), nearby_indices(words ^ errors)
    for x, fx, y, fy in zip(*a, *b, strict=True):
        assert set(x[fx]) & set(y[fy])
        assert len(x[fx]) in (1, 6)


def test_fingerprints(documents, edges):
    rng = random.Random(0)
    rows = [*edges, *((100 + i, " ".join(rng.choices(["a", "B", "é", "x\ty", " ", "\v", "."], k=rng.randint(0, 30)))) for i in range(100))]
    found = {(r.doc_id, r.fingerprint) for r in op.near_duplicates(documents(rows, clash=True)).collect()}
    assert found == {(i, f"{brute_fingerprint(t):016x}") for i, t in rows}


def linked(spark, pairs, monkeypatch):
    made = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in pairs], "doc_id long, fp long")
    monkeypatch.setattr(op, "fingerprints", lambda docs: docs)
    return {r.doc_id: r.component_id for r in op.near_duplicates(made).collect()}


@pytest.mark.parametrize("small", [48, 0, 5])
def test_links_agree_with_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(op, "SMALL_BUCKET", small)
    rng = random.Random(small)
    pairs = []
    for g in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                x ^= 1 << b
            pairs.append((len(pairs) * 7 % 1000 + 1000 * g, x))
    pairs += [(9, 0), (8, (1 << 63) | 1), (7, 1)]
    assert linked(spark, pairs, monkeypatch) == brute_components(pairs)


def test_groups_keep_one(documents):
    text = " ".join(f"w{i % 37}" for i in range(400))
    rows = [(5, text), (3, text), (9, text.replace("w1 ", "W1 ", 1)), (4, "something else"), (4, "something else"), (None, text), (1, None), (2, "")]
    stay = op.keep_one(documents(rows, clash=True))
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3, 4]  # the row without an id is a copy of them
    found = {r.doc_id: r.component_id for r in op.near_duplicates(documents(rows)).where(F.col("doc_id").isNotNull()).collect()}
    assert found == {5: 3, 3: 3, 9: 3, 4: 4, 1: 1, 2: 1}
    assert op.near_duplicates(documents([])).count() == 0


def test_one_id_with_two_texts_is_one_document(documents):
    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    found = op.near_duplicates(documents([(1, a), (2, a), (2, b), (3, b)])).collect()
    assert {r.component_id for r in found} == {1}


def test_rows_without_ids_link_and_one_of_them_stays(documents, spark, monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(400))
    rows = [(None, text), (None, text.replace("w1 ", "W1 ", 1)), (None, "other words")]
    assert op.keep_one(documents(rows)).count() == 2
    # a fingerprint that only rows without an id have joins two groups
    found = linked(spark, [(7, 0b0000), (None, 0b0011), (9, 0b1111)], monkeypatch)
    assert found == {7: 7, None: 7, 9: 7}


def test_the_survivor_of_a_repeated_id_does_not_depend_on_the_order(documents):
    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, a), (1, b), (1, a), (2, b), (3, b + " more")]
    kept = {tuple((r.doc_id, r.text) for r in op.keep_one(documents(order).repartition(n)).collect()) for order, n in ((rows, 1), (rows[::-1], 3), (rows[2:] + rows[:2], 2))}
    assert len(kept) == 1 and len(next(iter(kept))) <= 2 and next(iter(kept))[0][0] == 1

import hashlib
import random
import re
import time

import numpy as np
import pytest

from unitloom.llm import decontamination
from unitloom.llm.decontamination import SuffixArray, TestItems, contamination, decontaminate, locate, matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        ws = split(text)
        n = min(13, len(ws))
        for k in range(len(ws) - n + 1 if ws else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add(i)
    out = []
    for d, text in docs:
        ws, hit, found = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(ws[k : k + n])]
        found = sorted(str(i) for i in found if i is not None)
        longest, at = 0, -1
        for _, item in items:
            other = split(item)
            least = min(13, len(other))
            for i in range(len(ws)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(ws) and j + n < len(other) and ws[i + n] == other[j + n]:
                        n += 1
                    if n >= least and (least == 13 or j == 0) and (n, -i) > (longest, -at):
                        longest, at = n, i
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws), longest, at))
    return out


def tables(spark, documents, docs, items):
    return documents(docs, clash=True), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS part")


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "the"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(25)] + [(90, None), (None, "w1 w2 w3 w4 É"), (3, "w0 w0 w0 w0")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary + ["z1", "z2"], k=rng.randint(0, 60)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), (items[rng.randrange(25)][1] or "").upper().replace("É", "É"))
        docs.append((i, " , ".join(parts)))
    return docs, items


@pytest.mark.parametrize(("seed", "chunk", "shard"), [(1, 10**6, 10**6), (2, 60, 10**6), (3, 10**6, 50)])
def test_agrees_with_brute_force(spark, documents, edges, monkeypatch, seed, chunk, shard):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    docs, items = random_case(seed)
    docs += edges[:-1]
    made, bench = tables(spark, documents, docs, items)
    found = contamination(made, bench, chunk)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_removal(spark, documents):
    item = " ".join(f"q{i}" for i in range(30))
    clean = " ".join(f"c{i}" for i in range(300))
    docs = [(1, f"{clean} {item}"), (2, clean), (3, " ".join(item.split()[:12])), (4, f"{clean} " * 3 + " ".join(item.split()[2:15])), (5, None), (None, item)]
    made, bench = tables(spark, documents, docs, [(7, item)])
    assert sorted((r.doc_id for r in decontaminate(made, bench).collect()), key=str) == [2, 3, 4, 5]
    assert decontaminate(made, bench).columns == made.columns
    assert sorted((r.doc_id for r in decontaminate(made, bench, 5).collect()), key=str) == [2, 3, 4, 5]
    assert contamination(made, bench).where("doc_id = 1").first()[6:] == (30, 300)


def test_empty_tables(spark, documents, edges):
    made, bench = tables(spark, documents, [], [(1, "a b c")])
    assert contamination(made, bench).count() == 0
    _, nothing = tables(spark, documents, [], [])
    assert {r.n_hit for r in contamination(documents(edges), nothing).collect()} == {0}


def test_suffixes_are_sorted():
    ids = np.array([1, 2, 1, 2, 1, 0, 2, 1, 2, 0, 3, 0], dtype=np.int32)
    array = SuffixArray(ids, 2, 8)
    kept = [tuple(array.text[i : i + 8]) for i in array.order]
    assert kept == sorted(kept)
    low, high = array.intervals(np.array([[2, 1], [1, 2], [3, 3]], dtype=np.int32))
    assert (high - low).tolist() == [3, 3, 0]


def test_matches_are_maximal_and_located(spark, documents):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(20)]
    # a stretch of one item that goes on in another is two matches, not a longer one
    docs = [(1, " ".join(["x", *a[5:30], "y", *b, *a[:13]])), (2, " ".join(a[:12])), (3, " ".join(b[3:17] + a[38:])), (None, None)]
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(b[7:] + a[:3]))]
    made, bench = tables(spark, documents, docs, items)
    for chunk in (10**6, 30):
        found = {tuple(r) for r in matches(made, bench, chunk).collect()}
        assert {(1, 1, "1", 5, 25), (1, 27, "2", 0, 20), (1, 34, "3", 0, 16), (1, 47, "1", 0, 13), (3, 0, "2", 3, 14)} <= found
        assert {r[0] for r in found} == {1, 3}
    assert {r.doc_id: (r.longest_match, r.longest_at) for r in contamination(made, bench).collect()} == {1: (25, 1), 2: (0, -1), 3: (14, 0), None: (0, -1)}


def test_two_million_benchmark_words_are_one_pass():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 500) % 50_000).encode()) for i in range(4_000)]
    began = time.perf_counter()
    test = TestItems(items)
    ids = rng.integers(1, 2_000, 200_000).astype(np.int32)
    ids[1_000:1_400] = test.text[test.first[7] + 50 : test.first[7] + 450]
    found = locate(ids, test)
    assert time.perf_counter() - began < 120
    assert found.at.min() == 1_000 and found.length[found.at == 1_000].max() >= 400

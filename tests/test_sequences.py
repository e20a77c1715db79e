import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitloom.functions import encoding, scalars
from unitloom.operators import agreement, boundaries, intervals
from unitloom.plans import timeline

SF = "/root/testdata/sf0.001"


def labels(spark, rows):
    made = spark.createDataFrame([(c, list(s)) for c, s in rows], "cluster long, phones array<string>")
    return encoding.encoded(made, "phones", "code")


def score(spark, rows, metric):
    return getattr(agreement, metric)(agreement.counted(labels(spark, rows))).first()[0]


def naive_lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def naive(rows):
    """The four scores by loops over all pairs."""

    def groups(key, value):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(value(r))
        return out

    def modal(group):
        counts = {s: group.count(s) for s in group}
        modes = [s for s in counts if counts[s] == max(counts.values())]
        longest = max(map(len, modes))
        return min(sum(naive_lev(s, m) for s in group) / len(m) for m in modes if len(m) == longest)

    def pairwise(group):
        pairs = [naive_lev(a, b) / max(len(a), len(b)) for a, b in itertools.combinations(group, 2)]
        return sum(pairs) / len(pairs) if pairs else 0.0

    by_cluster, by_type = groups(lambda r: r[0], lambda r: tuple(r[1])), groups(lambda r: tuple(r[1]), lambda r: (r[0],))
    types = [g for g in by_type.values() if len(g) > 1]
    n, m = len(rows), sum(map(len, types))
    return {
        "pacc": 1 - sum(map(modal, by_cluster.values())) / n,
        "ipacc": 1 - (sum(map(modal, types)) / m if m else 0.0),
        "wnes": 1 - sum(pairwise(g) * len(g) for g in by_cluster.values()) / n,
        "iwnes": 1 - (sum(pairwise(g) * len(g) for g in types) / m if m else 0.0),
    }


@pytest.mark.parametrize("seed", range(3))
def test_scores_agree_with_loops_over_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 4), rng.choices("abc", k=rng.randint(1, 4))) for _ in range(40)]
    for metric, expected in naive(rows).items():
        assert score(spark, rows, metric) == pytest.approx(expected, abs=1e-12)


def test_planted_perfect_agreement(spark):
    rows = [(1, "ab"), (1, "ab"), (2, "c"), (2, "c")]
    assert [score(spark, rows, m) for m in ("pacc", "ipacc", "wnes", "iwnes")] == [1.0, 1.0, 1.0, 1.0]


def test_single_segments_count_forward_only(spark):
    assert score(spark, [(1, "ab"), (2, "c")], "pacc") == 1.0
    assert score(spark, [(1, "ab"), (2, "c")], "ipacc") == 1.0


def test_accuracy_is_not_clamped(spark):
    assert score(spark, [(1, "a"), (1, "a"), (1, "bcdefgh")], "pacc") == pytest.approx(1 - 7 / 3)


def test_clean_drops_silences_before_digits(spark):
    row = spark.createDataFrame([(["1", "SIL", "sp1", "AH٣", "<UNK>", "", "K2"],)], "t array<string>")
    assert row.select(scalars.cleaned(F.col("t"))).first()[0] == ["", "sp", "AH", "K"]


@pytest.mark.parametrize(("gold", "segment", "counts"), [((0, 20), (5, 10), True), ((5, 5), (0, 10), False), ((8, 14), (0, 10), False), ((7, 13), (0, 10), True), ((8, 12), (0, 10), True), ((9, 12), (0, 10), False), ((10, 12), (0, 10), False)])
def test_overlap_rule(spark, gold, segment, counts):
    row = spark.createDataFrame([(*gold, *segment)], "a int, b int, c int, d int")
    assert row.select(scalars.overlaps(*map(F.col, "abcd"))).first()[0] is counts


def test_published_fixture_counts(spark):
    """FIXTURES.md counts intervals without length that stand inside a segment as matches; the rule itself does not."""
    pairs = timeline.overlapping(spark, SF)
    assert (timeline.gold(spark, SF).count(), timeline.segments(spark, SF).count(), pairs.count()) == (985, 1058, 1918)
    inside = pairs.where("r_start = r_end").count()
    assert timeline.matching(spark, SF).count() + inside == 1662


def test_overlap_join_is_the_same_for_any_bin(spark):
    a = spark.createDataFrame([(1, 0, 1000), (1, 10, 20), (2, 5, 6)], "k long, start long, end long")
    b = spark.createDataFrame([(1, 15, 15), (1, 19, 700), (1, 1000, 1001), (2, 0, 5), (2, 4, 9)], "k long, r_start long, r_end long")
    found = [sorted(map(tuple, intervals.overlap_join(a, b, "k", w).collect())) for w in (1, 7, 64, 5000)]
    assert found[0] == [(1, 0, 1000, 15, 15), (1, 0, 1000, 19, 700), (1, 10, 20, 15, 15), (1, 10, 20, 19, 700), (2, 5, 6, 4, 9)]
    assert all(f == found[0] for f in found)


def test_array_distance_for_large_vocabularies(spark):
    row = spark.createDataFrame([(["x", "y"], ["y", "z", "x"])], "a array<string>, b array<string>")
    assert row.select(encoding.array_distance(F.col("a"), F.col("b"))).first()[0] == naive_lev("xy", "yzx")


def test_encoded_refuses_too_many_tokens(spark, monkeypatch):
    monkeypatch.setattr(encoding, "MOST", 2)
    with pytest.raises(ValueError):
        labels(spark, [(1, "abc")])


def loop_boundaries(islands, tol):
    n_seg = n_ref = hits = t_seg = t_ref = t_hits = 0
    for found, ends in islands:
        seg, ref = found[:-1], ends[:-1]
        n_seg, n_ref, free = n_seg + len(seg), n_ref + len(ref), list(seg)
        for r in ref:
            i = next((i for i, s in enumerate(free) if abs(s - r) <= tol), None)
            if i is not None:
                free.pop(i)
                hits += 1
        pairs, free = list(itertools.pairwise([0, *found])), list(itertools.pairwise([0, *ends]))
        t_seg, t_ref = t_seg + len(pairs), t_ref + len(free)
        for a, b in pairs:
            i = next((i for i, (c, d) in enumerate(free) if max(0, c - tol) <= a <= c + tol and d - tol <= b <= d + tol), None)
            if i is not None:
                free.pop(i)
                t_hits += 1
    return (n_seg, n_ref, hits), (t_seg, t_ref, t_hits)


def test_boundary_hits_are_taken_in_order(spark):
    rng = random.Random(3)
    rows = [(u, list(map(int, sorted(rng.sample(range(1, 80), rng.randint(0, 9))))) + [100], sorted(rng.sample(range(1, 80), rng.randint(0, 9))) + [100]) for u in range(30)]
    matched = spark.createDataFrame(rows, "utt long, found array<long>, ends array<long>")
    b, t = loop_boundaries([r[1:] for r in rows], 5)
    assert tuple(boundaries.boundary_counts(matched).first()) == b
    assert tuple(boundaries.token_counts(matched).first()) == t


def test_islands_end_with_their_own_end(spark):
    gold = spark.createDataFrame([(1, 0, 0, 10, "a"), (1, 1, 10, 40, "b"), (1, 2, 40, 50, ""), (1, 3, 50, 70, "c")], "utt long, idx long, start long, end long, text string")
    cuts = spark.createDataFrame([(1, 3), (1, 20), (1, 38), (1, 60)], "utt long, at long")
    found = {r.island: (r.ends, r.found) for r in boundaries.matched_islands(gold, cuts).collect()}
    assert found == {1: ([10, 40], [20, 40]), 2: ([70], [60, 70])}


def test_rows_are_numbered_by_path_components(spark):
    rows = spark.createDataFrame([("a-b/x", 0), ("a/x", 0), ("a/x", 1)], "file string, at long")
    assert {(r.file, r.at): r.row_id for r in intervals.with_row_ids(rows, "file", "at").collect()} == {("a/x", 0): 0, ("a/x", 1): 1, ("a-b/x", 0): 2}


def test_strict_pairs_need_both_sides(spark):
    a, b = spark.createDataFrame([(1, 2)], "k long, x long"), spark.createDataFrame([(2, 2)], "k long, y long")
    with pytest.raises(Exception, match="no counterpart"):
        intervals.paired_strictly(a, b, "k").collect()


def naive_hits(outer, inner, tolerance):
    free, hits = list(range(len(inner))), 0
    for o in outer:
        for k in free:
            if all(abs(a - b) <= tolerance for a, b in zip(o, inner[k], strict=True)):
                free.remove(k)
                hits += 1
                break
    return hits


def test_one_pass_takes_the_same_hits():
    rng = random.Random(8)
    for k in range(400):
        ends = lambda: sorted(rng.choices(range(60), k=rng.randint(0, 14)))  # noqa: B023, E731
        a, b = ends(), ends()
        if k % 5 == 0:
            rng.shuffle(a)
        for x, y in (([[v] for v in a], [[v] for v in b]), ([list(p) for p in zip([0, *a], a, strict=False)], [list(p) for p in zip([0, *b], b, strict=False)])):
            d = len((x or y or [[0]])[0])
            assert boundaries.greedy_hits(np.array(x).reshape(-1, d), np.array(y).reshape(-1, d), 5) == naive_hits(x, y, 5)


def test_a_long_island_is_quick(spark):
    n = 20_000
    matched = spark.createDataFrame([(list(range(0, 10 * n, 5)), list(range(0, 10 * n, 10)))], "found array<long>, ends array<long>")
    began = time.perf_counter()
    assert boundaries.boundary_counts(matched).first()[2] == n - 1
    assert boundaries.token_counts(matched).first()[2] > 0
    assert time.perf_counter() - began < 60


def test_pairs_of_a_large_cluster_are_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, "".join(rng.choices("abc", k=rng.randint(1, 6))), rng.randint(1, 4)) for c in range(3) for _ in range(30)]
    counts = spark.createDataFrame(list({r[:2]: r for r in rows}.values()), "cluster long, code string, n long")
    expected = agreement.wnes(counts).first()[0]
    monkeypatch.setattr(agreement, "BLOCK", 4)
    assert agreement.wnes(counts).first()[0] == pytest.approx(expected, abs=1e-12)


def test_large_vocabularies_are_encoded(spark):
    assert len({encoding.letter(i) for i in range(0, encoding.MOST, 7)}) == len(range(0, encoding.MOST, 7))
    rows = spark.createDataFrame([(i, [f"t{i}", f"t{i + 1}", f"t{i}"]) for i in range(9_000)], "id long, phones array<string>")
    made = encoding.encoded(rows, "phones", "code")
    a = made.where("id = 5").select("code").withColumnRenamed("code", "a").join(made.where("id in (6, 8999)").select("id", "code"))
    assert {(r.id, r.d, r.n) for r in a.select("id", F.levenshtein("a", "code").alias("d"), F.length("code").alias("n")).collect()} == {(6, naive_lev("aba", "bcb"), 3), (8999, 3, 3)}

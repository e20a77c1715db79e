import random
import re

from unitloom.llm.license_scan import BASE, COVERED, LEAST_MATCH, MOST_GAP, SHORT, TEMPLATES, Automaton, scan_licenses
from unitloom.llm.words import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    ws = brute_words(text)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def texts(n=300):
    rng = random.Random(5)
    parts = rng.sample([t for _, t in TEMPLATES], 60) + list(BASE) + ["cc by cc by", "CC-BY", "General Public", "all rights", "reserved.", "the", "x é", "license", "Éa cc by"]
    return ["".join(rng.choice(parts) + rng.choice([" ", "\n", ", ", "é "]) for _ in range(rng.randint(0, 8))) for _ in range(n)]


def test_words_agree_with_the_pattern():
    for t in [*texts(50), "".join(map(chr, range(300)))]:
        assert [w.decode() for w in words(t.encode())] == brute_words(t)


def test_matching_statistics_agree_with_brute_force():
    corpus = (("a", "p q r s p q t"), ("b", "q r s x p q r s y"))
    made = Automaton(corpus, {"p q": "pq"})
    sequences = [words(t.encode()) for t in ("p q r s p q t", "q r s x p q r s y", "p q")]
    rng = random.Random(1)
    for _ in range(50):
        run = [rng.choice(b"pqrstxy").to_bytes() for _ in range(12)]
        got = [n for _, n in made.statistics([made.vocabulary[w] for w in run])]
        inside = lambda s: any(s == q[i : i + len(s)] for q in sequences for i in range(len(q)))
        assert got == [max((n for n in range(1, i + 2) if inside(run[i + 1 - n : i + 1])), default=0) for i in range(12)]


def test_base_places_agree_with_brute_force(documents, edges):
    rows = [*edges, *((100 + i, t) for i, t in enumerate(texts()))]
    found = scan_licenses(documents(rows, clash=True)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_template_spans(documents):
    notice = next(t for label, t in TEMPLATES if label == "bsd")
    broken = notice.replace("binary forms", "binary object forms")
    rows = [(1, f"before {notice} after"), (2, broken), (3, " ".join(notice.split()[:4])), (4, "Released under the MIT License."), (5, "use in source and then nothing else of it")]
    found = {r.doc_id: (r.labels, r.spans) for r in scan_licenses(documents(rows)).collect()}
    assert found[1][0] == "bsd" and (found[1][1][0].first, found[1][1][0].end) == (1, 1 + len(words(notice.encode())))
    assert found[2][0] == "bsd" and found[4][0] == "mit"
    assert found[3][0] == found[5][0] == ""
    assert scan_licenses(documents([])).count() == 0


def brute_score(ws, templates, base):
    """Labels and score: every chain of maximal stretches is tried."""
    sequences = [(label, brute_words(t)) for label, t in templates] + [(label, p.split()) for p, label in base.items()]
    places = lambda part: [(k, i) for k, (_, q) in enumerate(sequences) for i in range(len(q) - len(part) + 1) if q[i : i + len(part)] == part]
    size = [next((n for n in range(i + 1, 0, -1) if places(ws[i + 1 - n : i + 1])), 0) for i in range(len(ws))]
    ends = [i for i in range(len(ws)) if size[i] >= LEAST_MATCH and (i + 1 == len(ws) or size[i + 1] != size[i] + 1)]
    labels, score = set(), 0.0
    for k, (label, q) in enumerate(sequences):
        parts = [(i + 1 - size[i], i + 1, t) for i in ends for kk, t in places(ws[i + 1 - size[i] : i + 1]) if kk == k]

        def best(a, b, t, parts=parts):
            most = 0
            for x, y, u in parts:
                if (x, y, u) > (a, b, t):
                    shared = max(0, b - x, t + (b - a) - u)
                    if shared < y - x and x + shared - b <= MOST_GAP and u + shared - (t + b - a) <= MOST_GAP:
                        most = max(most, y - x - shared + best(x, y, u))
            return most

        covered = max((b - a + best(a, b, t) for a, b, t in parts), default=0)
        if covered and covered >= (len(q) if len(q) < SHORT else COVERED * len(q)):
            labels.add(label)
            score = max(score, covered / len(q))
        if label in base.values() and places(q) and any(ws[i : i + len(q)] == q for i in range(len(ws))):
            labels.add(label)
            score = 1.0
    return ",".join(sorted(labels)), score


def test_labels_and_score_agree_with_brute_force(documents):
    rng = random.Random(3)
    letters = "abcdefgh"
    templates = tuple((f"t{k % 5}", " ".join(rng.choices(letters, k=rng.choice([5, 9, 20, 30])))) for k in range(9))
    base = {"a b": "ab", "c d e": "cde"}
    rows = []
    for i in range(150):
        ws = []
        for _ in range(rng.randint(1, 4)):
            part = templates[rng.randrange(9)][1].split()
            for _ in range(rng.randint(0, 3)):  # broken at a few places
                part[rng.randrange(len(part)) :][:1] = rng.choices(letters + "xyz", k=rng.randint(0, 2))
                at = rng.randrange(len(part))
                part[at:at] = rng.choices("xyz", k=rng.choice([0, 1, 9]))
            ws += part
        rows.append((i, " ".join(ws)))
    found = {r.doc_id: r for r in scan_licenses(documents(rows), templates, base).collect()}
    for i, t in rows:
        labels, score = brute_score(t.split(), templates, base)
        assert (found[i].labels, round(found[i].score, 9)) == (labels, round(score, 9)), t


def test_names_and_identifiers(documents):
    said = {
        "licensed under the BSD 3-Clause License": "bsd-3-clause", "// SPDX-License-Identifier: MIT": "mit", "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
        "This file is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0", "released under the Apache License 2.0": "apache-2.0", "the BSD 3-Clause line": "",
    }
    found = {r.doc_id: r.labels for r in scan_licenses(documents(list(enumerate(said)))).collect()}
    assert found == dict(enumerate(said.values()))

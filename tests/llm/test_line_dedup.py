import random

from unitloom.llm.line_dedup import dedup_lines, fingerprints


def brute(rows, least):
    """Lines in a window (shortest run of non-blank lines with ``least`` words from a line on, or back) that occurred before."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, windows = {}, []
    for doc in docs:
        lines = [(k, s.strip(" ")) for k, s in enumerate(doc[1].split("\n")) if s.strip(" ")]
        for i in range(len(lines)):
            for step in (1, -1):
                run, n, j = [], 0, i
                while 0 <= j < len(lines) and n < least:
                    run.append(lines[j])
                    n += lines[j][1].count(" ") + 1
                    j += step
                if n >= least:
                    run.sort()
                    windows.append((doc, run[0][0], [k for k, _ in run], tuple(s for _, s in run)))
    for doc, first, _, text in windows:
        seen.setdefault(text, set()).add((doc, first))
    order = {d: i for i, d in enumerate(docs)}
    origin = {t: min(places, key=lambda p: (order[p[0]], p[1])) for t, places in seen.items()}
    gone = {}
    for doc, first, nos, text in windows:
        if (doc, first) != origin[text]:
            gone.setdefault(doc, set()).update(nos)
    out = []
    for d, t in rows:
        cut = gone.get((d, t), set())
        out.append((d, 0 if t is None else len(t.split("\n")), len(cut), t if not cut else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in cut)))
    return out


def test_agrees_with_brute_force(documents):
    rng = random.Random(4)
    pool = [" ".join(rng.choices("abcde", k=rng.randint(1, 7))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), rows[3], rows[3]]
    found = [tuple(r) for r in dedup_lines(documents(rows, clash=True), 12).collect()]
    assert sorted(found, key=str) == sorted(brute(rows, 12), key=str)


def test_passage_is_found_wherever_it_stands(documents):
    passage = "\n".join(" ".join(f"w{i}x{k}" for k in range(11)) for i in range(5))
    footer = "a short footer that many have"
    rows = [(1, f"one\n{passage}\ntwo\n{footer}"), (2, f"{footer}\nthree\nfour\n{passage}"), (3, f"{passage}\n{footer}"), (4, f"five\n{footer}")]
    found = {r.doc_id: r.text for r in dedup_lines(documents(rows)).collect()}
    assert found == {1: rows[0][1], 2: f"{footer}\nthree\nfour", 3: footer, 4: f"five\n{footer}"}


def test_edges(documents, edges):
    found = dedup_lines(documents(edges)).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(edges, key=str)
    assert dedup_lines(documents([])).count() == 0


def test_one_document_that_repeats_itself(documents):
    line = " ".join(f"w{i}" for i in range(60))
    found = dedup_lines(documents([(1, "\n".join([line] * 2_000)), (None, "x")])).collect()
    assert {(r.doc_id, r.n_removed, r.text) for r in found} == {(1, 1999, line), (None, 0, "x")}


def test_fingerprints_are_fewer_than_lines_and_in_every_shared_run(documents):
    rng = random.Random(7)
    line = lambda: " ".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    passages = [[line() for _ in range(14)] for _ in range(20)]  # 28 words at least
    rows = []
    for i in range(80):
        body = []
        for p in rng.sample(passages, 2):
            body += [line() for _ in range(rng.randint(1, 15))] + p
        rows.append((i, "\n".join(body)))
    found = fingerprints(documents(rows), 20).collect()
    assert len(found) < sum(len(t.split("\n")) for _, t in rows) / 2
    # every planted repeat goes, whatever stands around it
    texts = {r.doc_id: r.text.split("\n") for r in dedup_lines(documents(rows), 20).collect()}
    holds = lambda lines, p: any(lines[k : k + len(p)] == p for k in range(len(lines)))
    for p in passages:
        first = next((i for i, t in rows if holds(t.split("\n"), p)), None)
        later = [i for i, t in rows if i != first and holds(t.split("\n"), p)]
        assert not any(holds(texts[i], p) for i in later)
        assert first is None or holds(texts[first], p)

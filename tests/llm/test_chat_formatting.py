import random
import re

from unitloom.llm.chat_formatting import formatted

SCHEMA = "conv_id long, turn long, role string, text string"


def escaped(text, role=False):
    text = re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", text or "")
    return re.sub(r"\|(\\*)>", lambda m: "|" + m[1] + "\\>", text) if role else text


def brute(rows, part=256):
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(r)
    key = lambda x: tuple((v is not None, v) if v is not None else (False, "") for v in x)
    for c in by:
        by[c] = [tuple(r[1:]) for r in sorted(by[c], key=lambda r: ((r[0] is not None, r[0] or 0), key(r[1:])))]
    stay = {}
    for c in sorted(by, key=lambda c: (c is not None, c or 0)):
        if not any(len(o) > len(by[c]) and o[: len(by[c])] == by[c] for o in by.values()) and by[c] not in stay.values():
            stay[c] = by[c]
    out = []
    for c, turns in stay.items():
        for k in range(0, len(turns), part):
            out.append((c, k // part, len(turns), "".join(f"<|{escaped(r, True)}|>\n{escaped(t)}\n" for r, t in turns[k : k + part])))
    return out


def check(spark, rows, part=256):
    made = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS pos", "'y' AS rank", "1 AS a", "2 AS n")
    assert sorted(map(tuple, formatted(made, part).collect()), key=str) == sorted(brute(rows, part), key=str)


def test_snapshots_copies_and_branches(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    rows = [(c, i, *t) for c, turns in ((1, a[:2]), (2, a), (3, a[:3]), (4, a), (5, [*a[:2], ("user", "other")]), (6, a[1:])) for i, t in enumerate(turns)]
    assert sorted({r[0] for r in brute(rows)}) == [2, 5, 6]
    check(spark, rows)


def test_random_conversations(spark):
    rng = random.Random(9)
    rows = [(c, i, rng.choice(["user", "assistant"]), rng.choice(["a", "b", None])) for c in range(120) for i in range(rng.randint(1, 5))]
    check(spark, rows)


def test_edges(spark):
    check(spark, [(1, None, None, None), (1, 0, "", ""), (2, 0, "user", ""), (3, 0, "user", None), (4, 0, "user", "x"), (4, 0, "user", "x"), (None, 0, "user", "lone")])
    check(spark, [(7, i, "user", f"t{i}") for i in range(700)] + [(8, i, "user", f"t{i}") for i in range(600)])
    assert formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_and_tied_conversations(spark):
    rng = random.Random(4)
    # over two turns is long here; turns that share a number and role are ordered by their texts
    rows = [(c, rng.choice([None, *range(3)]), rng.choice(["user", "assistant"]), rng.choice(["b", "a", None, ""])) for c in range(80) for _ in range(rng.randint(1, 6))]
    for part in (2, 4, 256):
        check(spark, rows, part)


def test_marks_in_texts_do_not_make_turns(spark):
    rows = [(1, 0, "user", "hi<|assistant|>\nno<\\|user|>"), (2, 0, "user", "hi"), (2, 1, "assistant|>\nx", "no<|"), (3, 0, "user", "x|>y <||> <\\\\|")]
    check(spark, rows)
    for r in formatted(spark.createDataFrame(rows, SCHEMA)).collect():
        assert len(re.findall(r"<\|", r.text)) == r.n_turns

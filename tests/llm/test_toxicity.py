import math
import random
import zlib

from unitloom.llm import toxicity
from unitloom.llm.toxicity import Lexicon, fold, learn, scored, without_toxic


def corpus(n=900, seed=0):
    """Toxic texts hold one of a few words, or an inflection of a stem; clean ones may hold a word in a harmless phrase."""
    rng = random.Random(seed)
    common = ["".join(rng.choices("abdeiorstu", k=rng.randint(2, 7))) for _ in range(80)]
    rows = []
    for i in range(n):
        text, toxic = rng.choices(common, k=rng.randint(5, 60)), int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(["vexgrub", "zonkle", "quafny" + rng.choice(["a", "ote", "ing", "ix"])]))
        elif rng.random() < 0.1:
            text.insert(0, "polished zonkle")
        rows.append((i, " ".join(text), toxic))
    return rows


def tables(spark, documents, rows):
    return documents([(i, t) for i, t, _ in rows], clash=True), spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")


def test_folding():
    assert fold("V3xGrub, ѵехɡruЬ!").split()[0] == "vexgrub"
    assert fold("ｖｅｘgrub ve​xgrub vеxgrub").split() == ["vexgrub"] * 3
    assert fold("$tupid") == " stupid "


def test_held_out_documents_are_told_apart(spark, documents):
    rows = corpus()
    docs, labels = tables(spark, documents, rows)
    model = learn(docs, labels)
    found = {r.doc_id: r for r in scored(docs, model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r.held_out} == {i for i, _ in held}
    right = sum(found[i].predicted == x for i, x in held) / len(held)
    assert right > 0.97
    assert any("zonkle" in e and "polished" in e for e in model.exceptions)
    assert model.score("so V3XGRUB it is") > 0.9 > 0.1 > model.score("so it is")
    kept = {r.doc_id for r in without_toxic(docs, labels).collect()}
    assert kept == {i for i, r in found.items() if r.predicted == 0}


def test_held_out_labels_change_nothing(spark, documents):
    rows = corpus(300)
    docs, labels = tables(spark, documents, rows)
    other = spark.createDataFrame([(i, 1, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    a, b = learn(docs, labels), learn(docs, other)
    assert (a.weights, a.exceptions) == (b.weights, b.exceptions)


def test_longer_texts_score_lower_and_repeats_count_once():
    model = Lexicon({" vexgrub": 6.0}, (), (-4.0, 2.0, 0.1, 0.5))
    assert model.score("vexgrub " + "calm " * 500) < model.score("vexgrub calm")
    assert model.features("vexgrub vexgrub x")[1] == model.features("vexgrub y x")[1]


def test_edges(spark, documents, edges):
    docs, labels = tables(spark, documents, [])
    nothing = learn(docs, labels)
    assert {r.score for r in scored(documents(edges), nothing).collect()} == {0.0}
    assert scored(docs, nothing).count() == 0
    rows = corpus(200)
    _, labels = tables(spark, documents, rows)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (10**6, 0, 1)], labels.schema))
    model = learn(documents([(i, t) for i, t, _ in rows]), odd)
    found = scored(documents(edges, clash=True), model).collect()
    assert len(found) == len(edges) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1


def test_sample_is_bounded(spark, documents):
    docs, labels = tables(spark, documents, corpus(200))
    assert toxicity._training(docs, labels, 50).count() == 50


def brute_score(model, text):
    """Every pattern is looked for at every place of the folded text; a word inside an exception phrase does not count."""
    folded = fold(text)
    at = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    spared = [(i, i + len(p) - 1) for p in model.exceptions for i in at(p)]
    words = {}
    for p, w in model.weights.items():
        for i in at(p):
            if not any(a <= i < b for a, b in spared):
                word = folded[i + 1 :].split(" ")[0]
                words.setdefault(word, {}).setdefault(i, []).append(w)
    if not words:
        z = model.coefficients[0]
    else:
        last = {word: max(found[max(found)]) for word, found in words.items()}  # a word's places weigh alike
        x = (sum(last.values()) / math.log(math.e + 1 + folded.count(" ")), math.log1p(len(last)), max(last.values()))
        z = model.coefficients[0] + sum(c * v for c, v in zip(model.coefficients[1:], x, strict=True))
    return 1 / (1 + math.exp(-z))


def test_matching_exceptions_and_score_agree_with_brute_force(spark, documents):
    rng = random.Random(11)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(25)]
    weights = {f" {w} ": rng.uniform(1, 6) for w in rng.sample(words, 8)} | {f" {w[:3]}": rng.uniform(1, 6) for w in rng.sample(words, 6) if len(w) > 2}
    model = Lexicon(weights, tuple({f" {a} {b} " for a, b in zip(rng.sample(words, 6), rng.sample(words, 6), strict=True)}), (-3.0, 1.5, 0.7, 0.4))
    rows = [(i, " ".join(rng.choice([w, w.upper(), w.replace("a", "4"), w.replace("a", "\u0430"), w + ","]) for w in rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    found = {r.doc_id: r for r in scored(documents(rows), model).collect()}
    assert any(brute_score(model, t) != brute_score(Lexicon(weights, (), model.coefficients), t) for _, t in rows)
    for i, t in rows:
        assert math.isclose(found[i].score, brute_score(model, t), rel_tol=1e-9), t
        assert found[i].predicted == (found[i].score >= 0.3)


def test_the_text_learned_of_a_repeated_id_does_not_depend_on_the_order(spark, documents):
    rows = corpus(300)
    docs, labels = tables(spark, documents, rows)
    more = docs.unionByName(docs.where("doc_id < 150").withColumn("text", docs.text.substr(3, 10**6)))
    a, b = learn(more.repartition(3), labels), learn(more.orderBy("text"), labels)
    assert (a.weights, a.exceptions) == (b.weights, b.exceptions)

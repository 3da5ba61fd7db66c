import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from credograph.llm import language as L
from credograph.llm.spans import groups

WORDS = {"x": "alpha gamma delta omega kappa sigma theta".split(), "y": "zwölf über straße brücke größe möwe fünf".split(), "z": "écrire être garçon façade hôtel noël forêt".split()}


def corpus():
    rnd = random.Random(3)
    text = lambda lang, n: " ".join(rnd.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, text(lang, rnd.randint(3, 40)), lang) for i, lang in enumerate(rnd.choice("xyz") for _ in range(200))]
    return rows, text


def test_held_out_accuracy_and_mixtures(spark):
    rows, text = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = L.train(docs.filter("doc_id < 150"))
    assert model.languages == ["x", "y", "z"]
    found = {r.doc_id: r for r in L.predict(docs.filter("doc_id >= 150"), model).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[150:])
    mixed = spark.createDataFrame([(1, text("x", 150) + " " + text("y", 80))], "doc_id long, text string")
    r = L.predict(mixed, model).first()
    assert r.lang_pred == "x" and r.score < 0.9


def test_edges(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "123 !?", None), (None, "alpha gamma", None), (5, "日本", "x"), (5, "alpha " * 30_000, None)], "doc_id long, text string, lang string")
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = L.predict(docs, model).collect()
    assert [r.lang_pred for r in found[:4]] == ["und", "und", "und", "x"] and found[0].score == 0
    assert found[4].lang_pred != "und" and found[5].lang_pred == "x"
    kept = L.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    nothing = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, nothing).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0
    assert L.accept(docs, model, languages=["y"]).filter(F.col("text").startswith("alpha")).count() == 0


def test_accept_rejects_unlearned_languages(spark):
    rows, text = corpus()
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rnd = random.Random(4)
    junk = " ".join("".join(rnd.choice("bcdfghjkmnpqrvwxz") for _ in range(7)) for _ in range(30))
    strange = ["日本語の文章はとても長いです。" * 5, "это документ на другом языке " * 5, junk]
    clean = [t for _, t, _ in rows] + [text("x", 60) + " " + text("y", 60), "alpha"]
    docs = spark.createDataFrame(list(enumerate(strange + clean)), "doc_id long, text string")
    assert {r.doc_id for r in L.accept(docs, model).collect()} == set(range(len(strange), len(strange + clean)))


def test_sets_of_all_languages():
    rnd = random.Random(6)
    names = [f"l{i}" for i in range(6)]
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(60)]
    make = lambda i, n: " ".join(rnd.choice(words[10 * i : 10 * i + 10]) for _ in range(n))
    group = lambda t: next(groups(pa.array([t]), lower=True))
    counts = np.array([np.bincount(L.grams(group(make(i, 500)), 4, 1 << 13)[0], minlength=1 << 13) for i in range(6)])
    model = L.Model(names, counts, 4)
    even = group(" ".join(make(i, 60 if i else 80) for i in range(6)))
    best, share, known = model.infer(even, 4.0, None)
    assert names[best[0]] == "l0" and share[0] < 0.3 and known[0]
    assert model.infer(even, 4.0, 3)[1][0] > 0.3


def brute(model, text, penalty):
    """The method written out for one text, over every set of the most proportionate languages."""
    raw = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode()
    raw = bytes(c if chr(c).isascii() and chr(c).isalpha() or c >= 128 else 32 for c in raw)
    codes = [int(L.mix(np.array([int.from_bytes(raw[i : i + model.n], "big")], np.uint64))[0]) % model.buckets for i in range(len(raw) - model.n + 1)]
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    if not codes:
        return model.languages[0], 1 / len(model.languages)
    like = model.likelihood[codes].astype(float)

    def fit(weight, rounds):
        for _ in range(rounds):
            part = weight * like
            weight = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        return weight, np.log((weight * like).sum(axis=1)).sum()

    size, n = len(model.languages), len(codes)
    cost = penalty * 0.5 * np.log(n)
    alone = np.log(like).sum(axis=0)
    best, share, value = int(np.argmax(alone)), 1.0, alone.max() - cost
    weight, _ = fit(np.full(size, 1 / size), 8)
    order = np.argsort(-weight, kind="stable")
    for k in range(2, size + 1):
        start = np.where(np.isin(np.arange(size), order[:k]), np.maximum(weight, 1e-3), 0)
        fitted, logs = fit(start / start.sum(), 4)
        if logs - k * cost > value:
            best, share, value = int(np.argmax(fitted)), fitted.max(), logs - k * cost
    return model.languages[best], share


def test_matches_brute_force(spark):
    rows, text = corpus()
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rnd = random.Random(12)
    texts = [" ".join(text(x, rnd.randint(1, 40)) for x in rnd.choices("xyz", k=rnd.randint(1, 4))) for _ in range(120)]
    texts += [None, "", "12", "ab", "Ab", "é", "alpha 1!", "日本語の文章"]
    found = {r.doc_id: r for r in L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model).collect()}
    want = [brute(model, t, 4.0) for t in texts]
    assert [found[i].lang_pred for i in range(len(texts))] == [x for x, _ in want]
    assert all(abs(found[i].score - s) < 1e-3 for i, (_, s) in enumerate(want))
    assert sum(s < 0.95 for _, s in want) > 20


def test_clashing_columns(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame([(*r, "mine", True) for r in rows[:5]], "doc_id long, text string, lang string, lang_found string, LANG_known boolean")
    kept = L.accept(docs, L.train(docs))
    assert kept.columns == docs.columns and {r.lang_found for r in kept.collect()} == {"mine"}

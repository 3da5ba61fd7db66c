import random
import re
from collections import Counter

import numpy as np
import pytest
from credograph.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def test_rules_match_brute_force(spark):
    rnd = random.Random(3)
    pieces = ["a", "bé", "日本", "#$", "|", " ", " ", "\n", "\n", "\t", "a b c", "\x0b", "\x1c", "a b c d\n"]
    docs = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 300)))) for i in range(300)] + [(900, None), (901, ""), (902, "x " * 200)]
    model = Q.Ratio(3, np.zeros(16))
    got = Q.judge(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int"), model)
    found = {r[0]: tuple(r)[1:7] for r in got.collect()}
    assert found == {i: brute(t) for i, t in docs}


def test_ratio_parts_labelled_texts(spark):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["the", "cat", "sat", "on", "mats", "daily"]) + str(rnd.randint(0, 9)) for _ in range(80))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "$$$", "NOW||", "win%%%"]) + str(rnd.randint(0, 9)) for _ in range(80))
    docs = [(i, bad() if i % 4 == 0 else good()) for i in range(200)] + [(500, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(100)] + [(1, 1), (7, None), (None, 1)], "id long, good int")
    model = Q.train(frame, labels)
    got = {r.doc_id: r for r in Q.judge(frame, model).collect()}
    assert all(got[i].kept == (i % 4 != 0 and not got[i].base_failed) for i in range(200))
    assert not got[500].kept
    none = Q.train(frame, labels.limit(0))
    assert none.threshold == float("-inf") and Q.judge(frame.limit(0), none).count() == 0


def test_cut():
    table = np.zeros((Q._CELLS + 1, 2), int)
    assert Q.best_cut(table) == float("-inf")
    table[10, 0] = table[20, 1] = 5
    cut = (Q.best_cut(table) - Q._LOW) / (Q._HIGH - Q._LOW) * Q._CELLS
    assert 10 < round(cut) <= 20


def verdicts(docs, labels, n=3, buckets=1 << 15):
    """The method written out: scores, threshold and verdict of each document."""
    grams = lambda t: Counter(bytes(32 if c in b" \t\n\v\f\r" else 48 if 48 <= c < 58 else c for c in x) for x in (t.encode()[i : i + n] for i in range(len(t.encode()) - n + 1)))
    bucket = lambda x: int(Q.mix(np.array([int.from_bytes(x, "big")], np.uint64))[0]) % buckets
    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = min(good.get(i, 1), q)
    raw, trusted = Counter(), Counter()
    for i, t in docs:
        for x, k in grams(t or "").items():
            raw[bucket(x)] += k
            trusted[bucket(x)] += k * (good.get(i) == 1)
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + buckets)
    weight = {b: np.log(share(trusted, b)) - np.log(share(raw, b)) for b in raw}
    score = {}
    for i, t in docs:
        own = grams(t or "")
        score[i] = sum(k * weight[bucket(x)] for x, k in own.items()) / max(sum(own.values()), 1)
    table = np.zeros((Q._CELLS + 1, 2), int)
    for i, t in docs:
        if i in good and t is not None and not brute(t)[5]:
            table[int(min(max((score[i] + 4) * 1000, 0), 8000)), good[i]] += 1
    shares = [(table[:c, 0].sum() / table[:, 0].sum() - table[:c, 1].sum() / table[:, 1].sum(), c) for c in range(Q._CELLS + 2)]
    best = [c for v, c in shares if v >= max(shares)[0] - 1e-12]
    cut = -4 + best[len(best) // 2] / 1000
    return score, {i: not brute(t)[5] and score[i] >= cut for i, t in docs}, cut


@pytest.mark.parametrize("shard", [7, 1 << 20])
def test_verdicts_match_brute_force(spark, shard):
    rnd = random.Random(6)
    clean, junk = "alpha beta gamma delta epsilon zeta eta theta 12 34".split(), "xx% yy# zz 77 qq|q alpha beta".split()
    docs = []
    for i in range(150):
        mixed = rnd.random()
        docs.append((i, " ".join(rnd.choice(clean if rnd.random() < mixed else junk) + rnd.choice("abcdef") for _ in range(rnd.randint(40, 90)))))
    docs += [(900, None), (901, "")]
    labels = [(i, int(len([w for w in docs[i][1].split() if "%" not in w and "#" not in w]) > 40)) for i in range(0, 150, 2)] + [(0, 0), (3, None), (None, 1), (901, 1), (5000, 1)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, good string").repartition(3)
    model = Q.train(frame, spark.createDataFrame(labels, "id int, good int"), shard=shard)
    score, kept, cut = verdicts(docs, labels)
    got = Q.judge(frame, model).collect()
    assert abs(model.threshold - cut) < 1e-9
    assert all(abs(r.score - score[r.doc_id]) < 1e-9 and r.kept == kept[r.doc_id] for r in got)
    assert 10 < sum(kept.values()) < 140

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from credograph.llm import kneser_ney as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(t):
    return [*WORD.findall((t or "").translate(LOWER)), "\n"]


def brute(train, docs):
    pairs, words = Counter(), Counter()
    for t in train:
        own = tokens(t)
        words.update(own)
        pairs.update(zip(["\n", *own], own))
    n, v = sum(words.values()), len(words)
    follows = Counter(b for _, b in pairs)
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, low = [0, *K._discounts(of(pairs))], [0, *K._discounts(of(follows))]
    kinds = len(pairs)
    spare = sum(low[min(c, 3)] for c in follows.values()) / kinds
    seen = defaultdict(list)
    for (a, _), c in pairs.items():
        seen[a].append(c)

    def p(a, b):
        below = max(follows[b] - low[min(follows[b], 3)], 0) / kinds + spare / (v + 1)
        if a not in seen:
            return below
        c = pairs[a, b]
        left = sum(d[min(x, 3)] for x in seen[a])
        return (max(c - d[min(c, 3)], 0) + left * below) / sum(seen[a])

    out = {}
    for i, t in docs:
        own = tokens(t)
        logs = sum(math.log10(p(a, b)) for a, b in zip(["\n", *own], own))
        base = sum(math.log10((words[b] + 0.5) / (n + 0.5 * (v + 1))) for b in own)
        out[i] = (len(own), sum(words[b] > 0 for b in own), base, logs)
    sums = [sum(p(a, b) for b in words) + p(a, "?new") for a in ["\n", "?new", *list(words)[:5]]]
    return out, n, sums


#: Many shards, spread words, counts sent on early.
SMALL = {"word_shard": 16, "pair_shard": 300, "held": 64}


@pytest.mark.parametrize("how", [{}, SMALL])
def test_matches_brute_force(spark, how):
    rnd = random.Random(4)
    vocabulary = ["The", "of", "ä", *(f"w{i}" for i in range(60))]
    text = lambda: " ".join(rnd.choices(vocabulary, [20, 9, 5, *[1] * 60], k=rnd.randint(0, 50)))
    docs = [(i, text()) for i in range(60)] + [(100, None), (101, " \n "), (102, "unseen words of")]
    train = [t for i, t in docs if i % 3 and i != 102]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    model = K.train(frame.filter("doc_id % 3 != 0 and doc_id != 102").repartition(3), **how)
    want, n, sums = brute(train, docs)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    got = K.score(frame, model).collect()
    assert model.words.tokens == n and len(got) == len(docs)
    for r in got:
        k, known, base, logs = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (k, known)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(logs, abs=1e-9)


def test_packed_numbers():
    for top in (0, 255, 256, 1 << 31, (1 << 32) + 5, (1 << 62) + 1):
        x = np.array([0, 3, top], np.int64)
        assert K.unpacked(K.packed(x)).tolist() == x.tolist()
    assert len(K.packed(np.array([255]))) == 2 and K.unpacked(K.packed(np.zeros(0, np.int64))).tolist() == []


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    r = K.score(frame, K.train(frame.limit(0))).first()
    assert (r.n_tokens, r.n_known, r.score) == (2, 0, 0.0)
    assert K.score(frame.limit(0), K.train(frame)).count() == 0

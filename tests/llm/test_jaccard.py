import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from credograph.llm import jaccard as J
from credograph.llm import signature_tree as S
from credograph.llm.components import components
from credograph.llm.shared import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent):
    sets = [(d, shingles(t, k)) for d, t in docs]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[x] = y
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(a), low[find(i)]) for i, (d, a) in enumerate(sets))


def corpus(rnd, groups=12):
    words = [f"w{i}" for i in range(300)]
    docs = []
    hot = [rnd.choice(words) for _ in range(60)]
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 40, 80, 150]))]
        if rnd.random() < 0.4:
            base += hot
        for _ in range(rnd.choice([1, 1, 2, 9, 30])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            docs.append(" ".join(own) + " " * rnd.randint(0, 2))
    docs += ["", " \n", None, "One", "ONE", "one two", hot and " ".join(hot)]
    rnd.shuffle(docs)
    return [(i * 3 % 1009, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,k,percent,block", [(1, 3, 90, 256), (2, 3, 90, 4), (3, 5, 80, 3), (4, 3, 80, 2), (5, 1, 50, 8)])
def test_matches_brute_force(spark, seed, k, percent, block):
    docs = corpus(random.Random(seed))
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n int").repartition(3)
    got = sorted(tuple(r) for r in J.link_components(frame, "doc_id", "text", k, percent, block).collect())
    assert got == brute(docs, k, percent)
    if (k, percent) == (3, 90):
        documents = pd.DataFrame(docs, columns=["doc_id", "text"])  # noqa: F841
        assert sorted(duckdb.sql(J.SQL).fetchall()) == got
    if seed < 3:
        kept = J.keep_one(frame, shingle=k, percent=percent, block=block)
        want = {c for _, n, c in brute(docs, k, percent)}
        assert {r.doc_id for r in kept.collect()} == want and kept.columns == frame.columns


def test_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in J.link_components(frame).collect()), key=str) == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3)], key=str)
    assert sorted((r.doc_id for r in J.keep_one(frame).collect()), key=str) == sorted([1, 3, None], key=str)
    assert J.link_components(frame.limit(0)).count() == 0


def test_tree_keeps_every_similar_pair():
    rnd = random.Random(7)
    for of in (50, 80, 90):
        least = S.Threshold(of)
        sets = []
        for _ in range(40):
            base = [rnd.getrandbits(64) for _ in range(rnd.choice([1, 3, 50, 70, 400]))]
            sets += [np.unique(np.array(rnd.sample(base, max(1, int(len(base) * rnd.uniform(0.7, 1)))), np.uint64)) for _ in range(3)]
        seen = set()
        root = S.build(list(range(len(sets))), [len(x) for x in sets], [S.bitmap(x) for x in sets])
        S.traverse(root, root, least, lambda i, j: seen.add((min(i, j), max(i, j))), lambda i, j: False)
        for j in range(len(sets)):
            for i in range(j):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= of * (len(sets[i]) + len(sets[j]) - n):
                    assert (i, j) in seen
        assert len(seen) < 0.5 * len(sets) ** 2 / 2


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 70), (70, 90)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), new_path(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 70: 70, 90: 70, 100: 70}


def test_pairs_that_do_not_link_do_not_send_their_sets_again(spark, monkeypatch):
    """A pair below the limit stands in a block of each rare shingle that it shares; after the largest
    ones, finer bitmaps exclude it."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(402)]
    docs = []
    for d in range(12):
        own = list(base)
        for at in rnd.sample(range(0, 400, 5), 6):
            own[at] = f"d{d}_{at}"
        docs.append((d, " ".join(own)))
    sent, links = [], J._Search.links
    monkeypatch.setattr(J._Search, "links", lambda self, some, sets: sent.append(some.count()) or links(self, some, sets))
    got = {r.doc_id: r.component_id for r in J.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d for d, _ in docs}
    assert sent[0] > 0 and sent[1] == 0


def test_members_without_a_partner_by_size_do_not_send_bitmaps(spark, monkeypatch):
    """Documents that share rare shingles but differ too much in size stand in one list; their bitmaps
    aren't sent."""
    shared, frequent = [f"r{i}" for i in range(8)], [f"f{i}" for i in range(700)]
    docs = [(d, " ".join(shared + frequent[:n])) for d, n in enumerate((40, 80, 160, 320))]
    docs += [(10, " ".join(f"x{i}" for i in range(60))), (11, " ".join(f"x{i}" for i in range(61)))]
    docs += [(d, " ".join(frequent)) for d in range(20, 32)]
    sent, possible = [], J._Search.possible
    monkeypatch.setattr(J._Search, "possible", lambda self, members, *a: sent.append({r.node for r in members.collect()}) or possible(self, members, *a))
    got = {r.doc_id: r.component_id for r in J.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 10: 10, 11: 10, **{d: 20 for d in range(20, 32)}}
    assert len(sent[0]) == 2


def test_partners_by_size_and_place():
    """Against all pairs of a list, in batches and parts of any size; lists longer than a block stay whole."""
    rnd = random.Random(5)
    for of, block, at_once in ((90, 6, 1), (80, 6, 9), (50, 3, 4), (90, 100, 1 << 16)):
        least, rows = S.Threshold(of), []
        for key in range(60):
            for node in range(rnd.choice([1, 2, 2, 3, 5, 6, 9, 40])):
                n = rnd.randint(1, 60)
                rows.append((key, 1000 * key + node, n, n - rnd.randrange(least.prefix(n))))
        rows.sort(key=lambda r: (r[0], r[2]))
        want = set()
        for key in range(60):
            own = [r for r in rows if r[0] == key]
            want |= {(key, a[1]) for a in own if len(own) > block or any(a is not b and least.overlap(a[2], b[2]) <= min(a[3], b[3]) for b in own)}
        at, batches = 0, []
        while at < len(rows):
            size = rnd.randint(1, 12)
            batches.append(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + size])], names=["key", "node", "n", "rest"]))
            at += size
        got = [(r["key"], r["node"]) for b in J._partners(least, block, at_once)(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
    assert not list(J._partners(least, block)(iter([])))

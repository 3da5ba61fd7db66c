import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from credograph.llm import hard_negatives as H

KINDS = "vec_id long, embedding array<float>, label int, id string"


def corpus(n=400, dims=6):
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    vector = lambda: [float(np.float32(c + rnd.gauss(0, 0.5))) for c in rnd.choice(centres)]
    rows = [(i, vector(), rnd.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 3) for i in range(150)]  # a vector that many share
    rows += [(20, vector(), 1), (20, rows[20][1], rows[20][2]), (n + 200, [0.0] * dims, 2), (n + 201, [0.5], 3), (n + 202, [], 0)]
    rows += [(None, vector(), 1), (n + 203, None, 1), (n + 204, vector(), None), (n + 205, [float("nan"), *vector()[1:]], 1), (n + 206, [math.inf, *vector()[1:]], 1), (n + 207, [None, *vector()[1:]], 1)]
    return rows


def brute(rows, every, k=5, low=80):
    own = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for j, (a, v, y) in enumerate(own):
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, z) for m, (i, w, z) in enumerate(own) if m != j]
        for s, p, _ in sorted(x for x in scored if x[2] == y)[:k]:
            fits = sorted(x for x in scored if x[2] != y and low * s >= 100 * x[0] >= 100 * s)[:k]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fits)]
    return sorted(out)


def test_matches_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], KINDS).repartition(3)
    got = H.mine(frame, F.col("id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, 20)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    assert H.mine(frame.limit(0), F.col("id") % 20 == 0).count() == 0
    assert H.mine(frame, F.col("id") < 0).count() == 0


@pytest.mark.parametrize("block", [16, 100])
def test_small_blocks_and_pruning(spark, block):
    """Many blocks: the same results, and brackets that hold every score."""
    rows = H.prepared(spark.createDataFrame([(*r, "x") for r in corpus(300)], KINDS), "vec_id", "embedding", "label")
    index = H.build(rows, 4, block)
    assert index.blocks >= 450 // block
    blocks = [index.block(b) for b in range(index.blocks)]
    ids, v, labels, row, d = (np.concatenate([b[x] for b in blocks]) for x in ("ids", "vectors", "labels", "rows", "distances"))
    assert len(row) == rows.count() == len(set(row.tolist()))
    q = np.arange(0, len(v), 9)
    some = H._Search(index, v[q], labels[q], row[q], np.full(len(q), H.LOWEST), np.full(len(q), H.HIGHEST), 5, True)
    low, top = some.bracket(np.arange(len(q)), d, d)
    score = v[q] @ v.T
    assert (low <= score).all() and (score <= top).all()
    some.over(np.arange(index.blocks))
    for i, j in enumerate(q):
        own = sorted((-score[i, m], ids[m]) for m in range(len(v)) if labels[m] == labels[j] and m != j)[:5]
        assert [(-s, x) for s, x in zip(some.scores[i], some.ids[i])] == own
    seen = []
    index_block = H.Index.block
    H.Index.block = lambda self, n: seen.append(n) or index_block(self, n)
    try:
        H._Search(index, v[q[:1]], labels[q[:1]], row[q[:1]], np.array([H.LOWEST]), np.array([H.HIGHEST]), 5, True).over(np.arange(index.blocks))
    finally:
        H.Index.block = index_block
    assert len(seen) < index.blocks


def test_matches_sql(spark):
    rows = [(i * 5, v, y) for i, v, y in corpus(200) if i is not None and (v is None or len(v) == 6)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], KINDS)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = H.mine(frame.withColumn("label", moved), F.col("id") % 100 == 0)
    embeddings = pd.DataFrame([r[:3] for r in rows], columns=["vec_id", "embedding", "label"]).astype({"label": "Int64"})
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r[:3]) for r in rows])
    assert len(embeddings) == len(rows)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(H.SQL).fetchall())


def test_scores_past_53_bits_are_exact_and_past_63_refused(spark):
    big = [(0, [1.5e6, 1.0], 0), (1, [1.5e6, 1.0 / 256], 0), (2, [1.5e6, 2.0 / 256], 1), (3, [1.5e6, 3.0 / 256], 1)]
    frame = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, H.mine(frame, F.col("id") == 0, low=0).collect()))
    base = 384_000_000**2
    assert got == [] or got[0][4] == base + 256
    frame = spark.createDataFrame([*big, (4, [1.5e6, 4.0 / 256], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, H.mine(frame, F.col("id") == 0, low=0).collect()))
    assert got == [(0, 4, 1, 3, base + 1024, base + 768), (0, 4, 2, 2, base + 1024, base + 512)]
    with pytest.raises(ValueError):
        H.mine(spark.createDataFrame([(0, [1e300], 0)], "vec_id long, embedding array<double>, label int"), F.col("id") == 0).count()

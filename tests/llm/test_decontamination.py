import random
import re

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from credograph.llm import decontamination as D
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, w=13):
    out = {}
    own = {}
    for i, t in items:
        x = words(t)
        for k in range(max(len(x) - w + 1, 1)) if x else ():
            own.setdefault(tuple(x[k : k + w]), set()).add(i)
    sizes = {len(x) for x in own}
    for d, t in docs:
        x, hit, names = words(t), set(), set()
        for n in sizes:
            for k in range(len(x) - n + 1):
                if (key := tuple(x[k : k + n])) in own:
                    hit.update(range(k, k + n))
                    names |= own[key]
        out[d] = (len(x), len(hit), len(names - {None}), bool(hit) and 20 * len(hit) >= len(x))
    return out


@pytest.mark.parametrize("short", [1, 2, 5, 13])
@pytest.mark.parametrize("block", [40, 10**6])
def test_matches_brute_force(spark, short, block):
    rnd = random.Random(short)
    vocabulary = ["a", "B", "ç", "dd", "e1"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(short, 18))) for i in range(12)] + [(50, None), (51, " .. "), (None, text(14))]
    docs = [(d, text(rnd.randint(0, 60))) for d in range(40)] + [(90, None), (91, ""), (92, items[0][1]), (93, f"{text(3)}-{items[1][1].upper()}! {text(900)}")]
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == brute(docs, items)
    documents, benchmark = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"})  # noqa: F841
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(D.SQL).fetchall())


def test_clean_and_edges(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " * 2000 + item, 5), (2, item, 6), (3, "ok", 7), (4, None, None)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.clean(docs, items).collect()) == [1, 3, 4]
    cut = D.clean(docs, items, max_span=12)
    assert cut.columns == docs.columns
    assert cut.filter("doc_id = 1").first().text == "x " * 2000
    none = D.report(docs, items.limit(0))
    assert none.count() == 4 and none.filter("n_hit > 0").count() == 0
    assert D.report(docs.limit(0), items).count() == 0
    assert none.filter("doc_id=3").select(F.col("items_sha256")).first()[0].startswith("e3b0c442")


def test_long_items_in_pieces_and_clashing_names(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(["a", "b", "c"]) for _ in range(n))
    items = [(1, text(700)), (2, text(20)), (3, None)]
    items.append((4, items[0][1]))
    docs = [(i, f"x {items[0][1][40 * i : 40 * i + rnd.randint(0, 900)]} y {text(30)}") for i in range(20)]
    frame = spark.createDataFrame([(*d, "mine", [1]) for d in docs], "doc_id long, text string, hit_items string, HIT_SPANS array<long>")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = D.report(frame, benchmark, block_words=50)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == brute(docs, items)
    kept = D.clean(frame, benchmark, max_span=12, limit=0, block_words=50).collect()
    assert all(r.hit_items == "mine" and r.HIT_SPANS == [1] for r in kept)


def test_stage_cuts_long_spans_of_documents_that_stay(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice(["é", "ß", "q", "Z"]) * 2 for _ in range(n))
    items = [(i, text(rnd.randint(5, 40))) for i in range(8)] + [(20, text(400))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, f"{text(rnd.randint(0, 900))}, {items[i % 8][1].upper()}! {text(rnd.randint(0, 900))}") for i in range(30)]
    docs += [(90, f"{text(9000)} ({items[8][1]}) {text(9000)}\n{items[7][1]}"), (91, ""), (92, None), (93, items[8][1])]
    frame = spark.createDataFrame([(*d, None if d[1] is None else -1) for d in docs], "doc_id long, text string, n_chars int")
    shared = brute(docs, items)
    want = {}
    own = {tuple(words(t)[k : k + 13]) for _, t in items for k in range(len(words(t)) - 12)}
    for d, t in docs:
        if shared[d][3]:
            continue
        places, low = [m.span() for m in WORD.finditer(t or "")], words(t)
        hit = {k + j for k in range(len(low) - 12) if tuple(low[k : k + 13]) in own for j in range(13)}
        out, at = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out += t[at : places[k][0]]
            at = places[k][1]
        want[d] = (None if t is None else out + t[at:], None if t is None else len(out + t[at:]) if hit else -1)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.decontamination_stage(spark, frame, str(tmp_path)).collect()}
    assert got == want
    assert 90 in want and items[8][1] not in got[90][0] and 3 < len(want) < len(docs)


def test_spans_are_cut_at_their_words_in_texts_with_capitals(spark):
    """Capitals are letters of words, in the cut as in the search."""
    from credograph.llm import decontamination as D

    item = " ".join(f"Word{i}" for i in range(20))
    before, after = " ".join(f"The Old{i}" for i in range(300)), " ".join(f"AND New{i}" for i in range(300))
    docs = spark.createDataFrame([(1, f"{before} {item.upper()}, {after}", 0), (2, f"{before} ENDS {item}", 0), (3, item, 0), (4, before, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in D.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), max_span=12, length_col="n_chars").collect()}
    want = {1: f"{before} , {after}", 2: f"{before} ENDS ", 4: before}
    assert {k: t for k, (t, _) in got.items()} == want
    assert all(n == (len(t) if k != 4 else 0) for k, (t, n) in got.items())


def test_spans_are_found_and_cut_by_one_worker(spark):
    """A second Python operator in a stage is a second worker for each core of an executor."""
    docs = spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, n_chars int")
    items = spark.createDataFrame([(7, "a b")], "item_id long, text string")
    plan = D.clean(docs, items, max_span=12, length_col="n_chars")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bMapInArrow\b", plan)) == 1

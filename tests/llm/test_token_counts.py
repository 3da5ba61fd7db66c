import pytest
from pyspark.sql import functions as F

from credograph.llm import token_counts as C
from credograph.llm.shared import new_path

SCHEMA = "source string, lang string, version string, change string, tokens long, old_tokens long, documents string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_batches(spark):
    r = C.Rollup(spark, new_path(spark, "rollup-test"))
    assert r.totals().count() == 0
    r.compact()
    batch = lambda *x: spark.createDataFrame([(*row, "x") for row in x], SCHEMA)
    first = batch(("a", "en", "1", "insert", 5, None), ("a", "en", "1", "insert", 5, None), (None, "en", "1", "insert", None, None), ("b", None, "2", "insert", 7, 0))
    assert r.commit("one", first)
    assert not r.commit("one", first)
    assert rows(r.totals()) == sorted([("a", "en", "1", 2, 10), (None, "en", "1", 1, 0), ("b", None, "2", 1, 7)], key=str)
    assert r.commit("two", batch(("a", "en", "1", "delete", None, 5), ("b", None, "2", "revise", 9, 7), (None, "en", "1", "delete", 0, 0)))
    r.compact()
    assert not r.commit("two", first)
    assert not r.commit("one", first)
    assert r.commit("three", batch(("a", "en", "1", "revise", 1, 5)))
    want = sorted([("a", "en", "1", 1, 1), ("b", None, "2", 1, 9)], key=str)
    assert rows(r.totals()) == want
    assert r.commit("none", first.limit(0))
    r.compact()
    r.compact()
    assert rows(C.Rollup(spark, r.folder).totals()) == want
    with pytest.raises(Exception, match="unknown change"):
        r.commit("bad", batch(("a", "en", "1", "drop", 1, 5)))
    assert rows(r.totals()) == want


def test_counts_and_revisions(spark):
    docs = spark.createDataFrame([(1, "a b\nc\na b", "x"), (2, None, "x"), (3, "", "x"), (4, "a-1\nb", "x")], "id long, text string, tokens string")
    found = {(r.id, r.version): (r.tokens, r.revised) for r in C.counts_and_revisions(docs, "text").collect()}
    want = {1: ((5, 3), (5, 3)), 2: ((0, 0), (0, 0)), 3: ((0, 0), (0, 0)), 4: ((2, 2), (3, 3))}
    assert found == {(i, v): pair for i, pairs in want.items() for v, pair in zip(C.VERSIONS, pairs)}


def test_query_equals_sql(spark):
    import duckdb

    from credograph.llm import queries as q

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(q.OP8_SQL)
    got = q.op8_token_counts(spark, folder).select(*want.columns)
    assert rows(got) == sorted(want.fetchall(), key=str)


def test_commits_during_a_compaction_and_attempts_side_by_side(spark, monkeypatch):
    folder = new_path(spark, "rollup-test")
    r, other = C.Rollup(spark, folder), C.Rollup(spark, folder)
    batch = lambda n: spark.createDataFrame([("a", "en", "1", "insert", n, None, "x")], SCHEMA)
    assert r.commit("one", batch(1))
    sums = C.Rollup._sums

    def late(self, merged, fresh):
        if self is r and not late.done:
            late.done = True
            assert other.commit("two", batch(10))
        return sums(self, merged, fresh)

    late.done = False
    monkeypatch.setattr(C.Rollup, "_sums", late)
    assert r.compact() and rows(r.totals()) == [("a", "en", "1", 2, 11)]
    assert not r.commit("two", batch(10)) and not r.commit("one", batch(1))
    # both writers saw no attempt before they wrote
    seen = C.Rollup._attempt
    answers = iter([None, None])
    monkeypatch.setattr(C.Rollup, "_attempt", lambda self, name: next(answers, seen(self, name)))
    first = r.commit("three", batch(100))
    monkeypatch.setattr(C.Rollup, "_attempt", seen)
    assert not first  # the second answer was foreseen too
    batch(100).groupBy("source", "lang", "version").agg(F.lit(1).cast("long").alias("documents"), F.lit(100).cast("long").alias("tokens")).write.parquet(f"{folder}/batches/{C.hashlib.sha256(b'three').hexdigest()}/again")
    assert rows(r.totals()) == [("a", "en", "1", 3, 111)]
    assert r.compact() and rows(r.totals()) == [("a", "en", "1", 3, 111)] and not r.compact()
    assert not r.commit("three", batch(100))


def test_late_readers_and_commits_outlive_compactions(spark, monkeypatch):
    r = C.Rollup(spark, new_path(spark, "rollup-test"))
    batch = lambda n: spark.createDataFrame([("a", "en", "1", "insert", n, None, "x")], SCHEMA)
    r.commit("b0", batch(1))
    r.compact()
    r.commit("b1", batch(10))
    lazy = r.totals()  # reads the first compaction and batch b1
    for k in range(2, C.KEPT + 1):
        assert r.compact()
        r.commit(f"b{k}", batch(10**k))
    assert rows(lazy) == [("a", "en", "1", 2, 11)]
    # a commit that has read an old marker, whose tables then go
    old = r._compactions()[0]
    for k in range(C.KEPT + 1, 2 * C.KEPT + 2):
        r.compact()
        r.commit(f"b{k}", batch(10**k))
    seen, stale = C.Rollup._compaction, iter([old])
    monkeypatch.setattr(C.Rollup, "_compaction", lambda self: next(stale, None) or seen(self))
    assert not r.commit("b0", batch(1))
    monkeypatch.setattr(C.Rollup, "_compaction", seen)
    assert rows(r.totals()) == [("a", "en", "1", 2 * C.KEPT + 2, int("1" * (2 * C.KEPT + 2)))]
    assert len(r._list("tables")) <= C.KEPT + 1

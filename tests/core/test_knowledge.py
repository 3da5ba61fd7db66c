import re

from credograph.operators import citations, coarsen, synthesis


def test_markers_equal_a_plain_scan(spark):
    texts = ["@a", "a@b.c", r"\@a [\@b] \[@c]", "[see @x.1; @y, p. 3] @z.", "[@k@l] x [no] [@m", None, "", "(@p:q.) [[@in]] @", "@a-b- [@r]@s"]
    want = []
    for i, t in enumerate(texts):
        spans = []
        for n, g in enumerate(re.finditer(citations.GROUP, t or "")):
            spans.append(g.span())
            want += [(i, n, k) for k in re.findall(rf"(?<!\\)@({citations.KEY})", g[1])]
        want += [(i, None, m[1]) for m in re.finditer(citations.BARE, t or "") if not any(a <= m.start() < b for a, b in spans)]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    assert sorted(map(str, map(tuple, citations.markers(frame, "n", "body").collect()))) == sorted(map(str, want))


def test_coarse_graph_with_a_cycle_and_nulls(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "x"), ("x", "d"), ("d", "x"), ("d", "y"), (None, "y"), ("e", None)], "child string, parent string")
    exports = spark.createDataFrame([("x",), ("y",), ("z",)], "node string")
    got = {tuple(r) for r in coarsen.coarse(edges.filter("child is not null and parent is not null"), exports).collect()}
    assert got == {("a", "x"), ("x", "y")}
    assert coarsen.coarse(edges.limit(0), exports).count() == 0


def test_risks_and_grounds_without_rows_and_with_nulls(spark):
    items = spark.createDataFrame([("s", None, None), ("t", ["p", "p"], "c")], "target_id string, premises array<string>, conclusion string")
    findings = spark.createDataFrame([("f", "prior_hole", "info", ["p", "c"]), ("g", "x", None, ["pp"])], "finding string, kind string, severity string, target_ids array<string>")
    deltas = spark.createDataFrame([("c", -0.06)], "claim string, delta double")
    assert sorted(map(tuple, synthesis.risks(items, findings, deltas).collect())) == [("s", 0, 0, None, "low"), ("t", 1, 2, -0.06, "medium")]
    assert {r.risk for r in synthesis.risks(items, findings.limit(0), deltas.limit(0)).collect()} == {"low"}
    rows = spark.createDataFrame([(1, 1, None, ["a"]), (1, 2, "x Y", ["z", "y w"]), (1, 3, "x", ["z"]), (1, 4, "x", None)], "trace_id int, seq int, reason string, inputs array<string>")
    assert sorted(map(tuple, synthesis.ungrounded(rows).collect())) == [(1, 1, "no_reason"), (1, 3, "no_shared_word")]

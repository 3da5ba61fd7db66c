import hashlib

import pytest

from credograph.operators import formalize, junction_tree, lowering_graph as L
from pyspark.sql import functions as F

CLAIMS = "id string, label string, helper boolean, prior double"
OPERATORS = "operator_id string, operator string, variables array<string>, conclusion string, pos int, action_label string, connective boolean"
STRATEGIES = f"strategy_id string, type string, premises array<string>, conclusion string, cpt array<double>, p_a_given_b double, p_b_given_a double, sub_strategies array<string>, formal {formalize.FORMAL}, base_rate double, prior double, pos int, action_label string"


def strategy(i, kind, premises, conclusion, **more):
    names = [x.split()[0] for x in ("strategy_id", "type", "premises", "conclusion", "cpt", "p_a_given_b", "p_b_given_a", "sub_strategies", "formal", "base_rate", "prior", "pos", "action_label")]
    own = {"strategy_id": f"s{i}", "type": kind, "premises": premises, "conclusion": conclusion, "pos": i} | more
    return tuple(own.get(n) for n in names)


def lowered(spark, claims, operators, strategies, priors=(), reviews=None, **how):
    make = spark.createDataFrame
    reviewed = None if reviews is None else make(reviews, "target_id string, status string, round int, pos int")
    v, f = L.lower(make(claims, CLAIMS), make(operators, OPERATORS), make(strategies, STRATEGIES), make(list(priors), "id string, prior double"), reviewed, **how)
    return {r.variable: (r.prior, r.hard) for r in v.collect()}, {r.factor: r for r in f.collect()}, v, f


def test_claims_operators_and_gate(spark):
    claims = [("a", "a", False, 0.3), ("b", "b", False, None), ("h", "__h", False, 0.9), ("r", "r", False, 0.2), ("e", "e", True, 0.7), ("t", "t", False, 0.6)]
    operators = [("o1", "contradiction", ["a", "b"], "r", 1, None, False), ("o2", "contradiction", ["b", "a"], "r", 2, None, False), ("o3", "conjunction", ["a", "b"], "h", 3, None, False), ("o4", "equivalence", ["a", "e"], "t", 4, None, True), ("o5", "disjunction", ["a", "b"], "e", 5, "act", False)]
    v, f, _, _ = lowered(spark, claims, operators, [], [("a", 0.4), ("h", 0.8)])
    assert v == {"a": (0.4, None), "b": (None, None), "h": (0.9, None), "r": (None, 1), "e": (None, None), "t": (0.6, None)}
    assert set(f) == {"op:o1", "op:o3", "op:o4", "op:o5"}
    assert [r.operator_id for r in L.dropped(spark.createDataFrame(operators, OPERATORS)).collect()] == ["o2"]
    gated = lowered(spark, claims, operators, [], reviews=[("o5", "accepted", 1, 1), ("o5", "rejected", 2, 2)])[1]
    assert set(gated) == {"op:o1", "op:o3", "op:o4"}
    with pytest.raises(Exception, match="two conclusions"):
        lowered(spark, claims, [*operators, ("o6", "disjunction", ["b", "a"], "h", 6, None, False)], [])


def test_strategies(spark):
    claims = [(x, x, False, p) for x, p in (("a", 0.3), ("b", 0.8), ("c", None), ("d", 0.5), ("k", None), ("x", None), ("y", 0.25))]
    strategies = [
        strategy(1, "infer", ["a"], "c", cpt=[0.2, 0.9]), strategy(2, "infer", ["a", "b"], "d"), strategy(3, "noisy_and", ["a", "b"], "c", cpt=[0.7]), strategy(4, "noisy_and", ["a"], "d"),
        strategy(5, "deduction", ["a", "b"], "y"), strategy(6, "deduction", ["a"], "d", base_rate=0.1), strategy(7, "support", ["b"], "c", prior=0.6), strategy(8, "associate", ["a", "b"], "k", p_a_given_b=0.3, p_b_given_a=0.8),
        strategy(9, "composite", ["a"], "c", sub_strategies=["s1", "s7"]), strategy(10, "analogy", ["a", "b"], "x"),
    ]
    v, f, variables, factors = lowered(spark, claims, [], strategies, [("y", 0.4)])
    row = lambda k: (f[k].kind, f[k].inputs, f[k].conclusion)
    assert row("infer:s1") == ("conditional", ["a"], "c") and f["infer:s1"].weights == [0.2, 0.9] and f["infer:s2"].weights == [0.5] * 4
    assert row("_m_na_s3:and") == ("conjunction", ["a", "b"], "_m_na_s3") and row("_m_na_s3:then") == ("soft_entailment", ["_m_na_s3"], "c")
    assert (f["_m_na_s3:then"].p1, f["_m_na_s3:then"].p2) == (0.7, 0.999) and row("_m_na_s4:then") == ("soft_entailment", ["a"], "d")
    helper = "local:package::__conjunction_result_" + hashlib.sha256(b"local|deduction|['a', 'b']|y|conjunction_result|0").hexdigest()[:8]
    assert row("formal:s5:0") == ("conjunction", ["a", "b"], helper) and row("formal:s5:1") == ("conditional", [helper], "y")
    assert f["formal:s5:1"].weights == [0.4, 0.999] and f["formal:s6:0"].weights == [0.1, 0.999]
    assert f["formal:s7:0"].p1 == pytest.approx(0.6 * 0.999 + 0.4 * 0.5) and f["formal:s7:0"].p2 == 0.5
    assert "k" not in v and f["assoc:s8"].weights == pytest.approx([1.0] * 4)
    implied = f["formal:s10:1"]
    assert implied.kind == "implication" and v[implied.conclusion] == (0.999, None) and v[helper] == (None, None)
    assert not any("s9" in k for k in f) and v["y"] == (0.4, None) and v["_m_na_s3"] == (None, None)
    assert junction_tree.marginals(variables, factors).filter("belief between 0 and 1").count() == len(v)
    degraded = lowered(spark, claims, [], strategies[:2], degraded=True)[1]
    assert (degraded["_m_infer_s1:then"].p1, degraded["_m_infer_s1:then"].p2) == (0.9, 0.8) and degraded["_m_infer_s2:and"].kind == "conjunction"
    with pytest.raises(Exception, match="missing strategy"):
        lowered(spark, claims, [], [strategy(1, "composite", ["a"], "c", sub_strategies=["none"])])


def test_templates(spark):
    rows = [(k, p, "z") for k, p in (("elimination", ["e", "c1", "v1", "c2", "v2"]), ("case_analysis", ["e", "c1", "v1", "c2", "v2"]), ("abduction", ["o"]), ("abduction", ["o", "q"]), ("compare", ["p", "q", "o"]), ("support", ["a", "b"]), ("mathematical_induction", ["a", "b"]))]
    frame = spark.createDataFrame(rows, "type string, premises array<string>, conclusion string")
    got = [[(o.operator, o.variables, o.conclusion) for o in r.f] for r in frame.select(formalize.formal(F.col("type"), F.col("premises"), F.col("conclusion"), "n:p").alias("f")).collect()]

    def helper(kind, premises, role, index=0):
        return f"n:p::__{role}_" + hashlib.sha256(f"local|{kind}|{premises}|z|{role}|{index}".encode()).hexdigest()[:8]

    e, p = "elimination", rows[0][1]
    h = lambda role, i=0: helper(e, p, f"{role}_result", i)
    assert got[0] == [("disjunction", ["c1", "c2", "z"], h("disjunction")), ("equivalence", [h("disjunction"), "e"], h("equivalence")), ("contradiction", ["c1", "v1"], h("contradiction")), ("contradiction", ["c2", "v2"], h("contradiction", 1)), ("conjunction", ["e", "v1", h("contradiction"), "v2", h("contradiction", 1)], h("conjunction")), ("implication", [h("conjunction"), "z"], h("implication"))]
    e = "case_analysis"
    assert got[1] == [("disjunction", ["c1", "c2"], h("disjunction")), ("equivalence", [h("disjunction"), "e"], h("equivalence")), *(x for i in (0, 1) for x in (("conjunction", [f"c{i + 1}", f"v{i + 1}"], h("conjunction", i)), ("implication", [h("conjunction", i), "z"], h("implication", i))))]
    alternative = helper("abduction", "o", "alternative_explanation")
    union = helper("abduction", ["o", alternative], "disjunction_result")
    assert got[2] == [("disjunction", ["z", alternative], union), ("equivalence", [union, "o"], helper("abduction", ["o", alternative], "equivalence_result"))]
    assert got[3][0][1] == ["z", "q"] and [x[0] for x in got[4]] == ["equivalence", "equivalence", "implication"] and got[4][2][2] == "z"
    assert [x[0] for x in got[5]] == [x[0] for x in got[6]] == ["conjunction", "implication"]
    why = spark.createDataFrame([("compare", ["a"]), ("elimination", ["a", "b"]), ("reductio", ["a"]), ("support", ["a"])], "k string, p array<string>").select(formalize.problem(F.col("k"), F.col("p")).alias("w"))
    assert [r.w for r in why.collect()] == ["premises", "premises", "no template", None]


def test_an_association_without_its_customers_prior_has_no_bounds(spark):
    from credograph.plans import beliefs

    sf = "/root/testdata/sf0.01"
    customers = beliefs.T.table(spark, sf, "customer").filter("c_nationkey >= 20").select(F.col("c_custkey").cast("string").alias("strategy_id"))
    told = beliefs.reasoning(spark, sf)["strategies"].filter("type = 'associate'").join(customers, "strategy_id").join(beliefs.T.table(spark, sf, "supplier"), F.col("strategy_id") == F.col("s_suppkey").cast("string"))
    rows = told.select("s_acctbal", "p_a_given_b", "p_b_given_a").collect()
    assert rows
    for r in rows:
        assert r.p_a_given_b == 0.9 and abs(r.p_b_given_a - 0.9 * (1 - (float(r.s_acctbal) + 1000) / 11000)) < 1e-12


def test_composites_after_a_gap_in_the_keys(spark, tmp_path):
    from credograph.plans import beliefs

    sf = "/root/testdata/sf0.001"
    for name in ("supplier", "customer", "nation"):
        rows = beliefs.T.table(spark, sf, name)
        (rows.unionByName(rows.withColumn("s_suppkey", F.col("s_suppkey") + 13)) if name == "supplier" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    strategies = beliefs.reasoning(spark, str(tmp_path))["strategies"]
    # 13 is a composite, but there is no 12
    assert strategies.filter("strategy_id = '13' and type = 'composite' and sub_strategies is null").count() == 1
    leaves = {r.strategy_id for r in L.expand(strategies).collect()}
    assert leaves == {str(k) for k in (*range(10), *range(13, 23)) if k % 7 != 6 or k == 13}

"""Queries on factor graphs made from whole tables, each with DuckDB's SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from credograph.functions.cumulative import cumulative, predicate_prior
from credograph.operators import exact, junction_tree, logic, lowering_graph, message_passing
from credograph.operators.formalize import FORMAL
from credograph.sources import tables as T

Graph = tuple[DataFrame, DataFrame]
#: Kinds with their numbers of inputs and parameters, as the gallery uses them.
GALLERY = {
    "implication": (2, None, None, None), "conjunction": (3, None, None, None), "disjunction": (2, None, None, None), "negation": (1, None, None, None),
    "equivalence": (2, None, None, None), "contradiction": (2, None, None, None), "complement": (2, None, None, None), "soft_entailment": (1, 0.9, 0.7, None),
    "conditional": (2, None, None, [0.1, 0.6, 0.3, 0.95]), "pairwise": (1, None, None, [1.2, 0.4, 0.3, 2.0]),
}
ROUNDS, DAMPING = 4, 0.5
EVENT = ("or", "r0", ("not", "r1"))


def _even(p):
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999)))


def gallery(spark: SparkSession, sf_dir: str) -> Graph:
    """For each supplier one factor of every kind, over variables of its own. (The balance is divided
    by 11003, so that no belief lies between two rounded ones.)"""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n"), F.lit(p1).cast("double").alias("p1"), F.lit(p2).cast("double").alias("p2"), F.lit(w).cast("array<double>").alias("weights")) for k, (n, p1, p2, w) in GALLERY.items()])
    rows = T.table(spark, sf_dir, "supplier").select("*", F.explode(kinds).alias("k"))
    name = lambda i: F.concat_ws("-", "s_suppkey", "k.kind", i)
    factors = rows.select(F.concat_ws("-", "s_suppkey", "k.kind").alias("factor"), "k.kind", F.transform(F.sequence(F.lit(0), F.col("k.n") - 1), name).alias("inputs"), name(F.col("k.n")).alias("conclusion"), "k.p1", "k.p2", "k.weights")
    slots = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k.n"))).alias("i"))
    last, key = F.col("i") == F.col("k.n"), F.col("s_suppkey")
    hard = F.when(last & (F.col("s_nationkey") == 3), 1)
    prior = F.when(last, F.when(key % 2 == 0, 0.7)).when(F.col("i") == 0, _even((F.col("s_acctbal") + 1000) / 11003)).when(F.col("i") == 1, F.when(key % 3 != 0, (key % 9 + 1) / 10)).otherwise(0.4)
    return slots.select(name(F.col("i")).alias("variable"), F.when(hard.isNull(), prior).cast("double").alias("prior"), hard.cast("int").alias("hard")), factors


def _gallery_sql(low: float, high: float) -> str:
    kinds = ", ".join(f"('{k}', {n})" for k, (n, *_) in GALLERY.items())
    cells = lambda k: "[" + ", ".join(f"{w}::double" for w in GALLERY[k][3]) + "]"
    a, b = "(x & 1) = 1", "((x >> 1) & 1) = 1"
    return f"""WITH kinds(kind, n) AS (VALUES {kinds}),
x AS (SELECT s_suppkey, kind, n, unnest(range((1 << (n + 1))::bigint)) AS x FROM supplier, kinds),
bits AS (SELECT s.s_suppkey, s_nationkey, s_acctbal, kind, n, x, x & ((1 << n) - 1) AS inputs, (x >> n) & 1 AS c, (1 << n) - 1 AS every FROM x JOIN supplier s USING (s_suppkey)),
truth AS (SELECT *, CASE kind WHEN 'implication' THEN NOT ({a}) OR ({b}) WHEN 'conjunction' THEN inputs = every WHEN 'disjunction' THEN inputs != 0 WHEN 'negation' THEN NOT ({a})
  WHEN 'equivalence' THEN ({a}) = ({b}) WHEN 'contradiction' THEN inputs != every WHEN 'complement' THEN ({a}) != ({b}) END AS t FROM bits),
weights AS (SELECT s_suppkey, kind, n, x,
  CASE kind WHEN 'soft_entailment' THEN CASE WHEN {a} THEN CASE WHEN c = 1 THEN 0.9 ELSE 0.1 END ELSE CASE WHEN c = 1 THEN 0.3 ELSE 0.7 END END
    WHEN 'conditional' THEN CASE WHEN c = 1 THEN {cells("conditional")}[inputs + 1] ELSE 1 - {cells("conditional")}[inputs + 1] END WHEN 'pairwise' THEN {cells("pairwise")}[x + 1]
    ELSE CASE WHEN (c = 1) = t THEN {high} ELSE {low} END END::double
  * CASE WHEN {a} THEN p0 ELSE 1 - p0 END
  * CASE WHEN n < 2 OR s_suppkey % 3 = 0 THEN 1 WHEN {b} THEN (s_suppkey % 9 + 1) / 10 ELSE 1 - (s_suppkey % 9 + 1) / 10 END
  * CASE WHEN n < 3 THEN 1 WHEN ((x >> 2) & 1) = 1 THEN 0.4 ELSE 0.6 END
  * CASE WHEN s_nationkey = 3 THEN CASE WHEN c = 1 THEN 0.999 ELSE 0.001 END WHEN s_suppkey % 2 = 0 THEN CASE WHEN c = 1 THEN 0.7 ELSE 0.3 END ELSE 1 END AS w
  FROM (SELECT *, least(greatest((s_acctbal + 1000) / 11003, 0.001), 0.999) AS p0 FROM truth)),
slots AS (SELECT s_suppkey, kind, n, unnest(range((n + 1)::bigint)) AS i FROM supplier, kinds)
SELECT s_suppkey || '-' || kind || '-' || i AS variable, round(sum(CASE WHEN ((x >> i::int) & 1) = 1 THEN w ELSE 0 END) / sum(w), 6) AS belief FROM slots JOIN weights USING (s_suppkey, kind, n) GROUP BY s_suppkey, kind, i"""


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select("variable", F.round("belief", digits).alias("belief"))


def every_kind_exact(spark, sf_dir):
    return _rounded(exact.marginals(*gallery(spark, sf_dir)), 6)


def every_kind_junction_tree(spark, sf_dir):
    return _rounded(junction_tree.marginals(*gallery(spark, sf_dir)), 6)


def every_kind_loopy(spark, sf_dir):
    """Trees, on which undamped propagation ends with strict potentials' exact beliefs."""
    return _rounded(message_passing.loopy(*gallery(spark, sf_dir), damping=1.0), 6)


def regions(spark: SparkSession, sf_dir: str) -> Graph:
    """Every nation supports its region; its prior is the mean balance of its suppliers."""
    n, s = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "supplier")
    rows = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_nationkey", "n_regionkey").agg(((F.coalesce(F.avg("s_acctbal"), F.lit(0.0)) + 1000) / 11000).alias("p"))
    name, region = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    none = F.lit(None).cast("int")
    variables = rows.select(name.alias("variable"), F.col("p").alias("prior"), none.alias("hard")).unionByName(rows.select(region.alias("variable"), F.lit(None).cast("double").alias("prior"), none.alias("hard")).distinct())
    weights = F.lit(None).cast("array<double>").alias("weights")
    return variables, rows.select(name.alias("factor"), F.lit("soft_entailment").alias("kind"), F.array(name).alias("inputs"), region.alias("conclusion"), F.lit(0.9).alias("p1"), F.lit(0.6).alias("p2"), weights)


_REGIONS = """WITH v AS (SELECT 'n' || n_nationkey AS n, 'r' || n_regionkey AS r, least(greatest((coalesce(avg(s_acctbal), 0) + 1000) / 11000, 0.001), 0.999) AS p FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey),
m AS (SELECT *, p * 0.9 + (1 - p) * 0.4 AS m1, p * 0.1 + (1 - p) * 0.6 AS m0 FROM v),
w AS (SELECT r, 1 / (1 + exp(sum(ln(m0)) - sum(ln(m1)))) AS q FROM m GROUP BY r)
"""


def exact_posterior(spark, sf_dir):
    return _rounded(exact.marginals(*regions(spark, sf_dir)))


def exact_joint(spark, sf_dir):
    found = exact.joint(*regions(spark, sf_dir), ["r0", "r1"])
    bit = lambda i: F.shiftright("assignment", i).bitwiseAND(1).cast("int").alias(f"r{i}")
    return found.select(bit(0), bit(1), F.round("p", 6).alias("p"))


def event_probability(spark, sf_dir):
    return logic.event_probability(exact_joint(spark, sf_dir), EVENT).withColumn("p", F.round("p", 4))


def rings(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations of a region in a ring, each with its region, and all suppliers below their nations:
    loops of width 2 and wide hubs. Balances are the suppliers' priors."""
    n, s = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "supplier")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    own = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))  # a region's nations
    ring = own.select(F.posexplode("k").alias("i", "a"), "k").select("a", F.get("k", (F.col("i") + 1) % F.size("k")).alias("b")).filter("a != b")
    none, table = F.lit(None).cast("double"), lambda w: F.lit(w).cast("array<double>").alias("weights")
    soft = lambda df, a, b, p1, p2: df.select(F.concat(a, F.lit(">"), b).alias("factor"), F.lit("soft_entailment").alias("kind"), F.array(a).alias("inputs"), b.alias("conclusion"), F.lit(p1).alias("p1"), F.lit(p2).alias("p2"), table(None))
    pairs = ring.select(F.concat_ws("~", "a", "b").alias("factor"), F.lit("pairwise").alias("kind"), F.array(key("n", "a")).alias("inputs"), key("n", "b").alias("conclusion"), none.alias("p1"), none.alias("p2"), table([1.2, 0.8, 0.8, 1.2]))
    factors = soft(n, key("n", "n_nationkey"), key("r", "n_regionkey"), 0.9, 0.6).unionByName(soft(s, key("s", "s_suppkey"), key("n", "s_nationkey"), 0.6, 0.55)).unionByName(pairs)
    hard = F.lit(None).cast("int").alias("hard")
    names = n.select(key("n", "n_nationkey").alias("variable")).unionByName(n.select(key("r", "n_regionkey").alias("variable")).distinct())
    return names.select("variable", none.alias("prior"), hard).unionByName(s.select(key("s", "s_suppkey").alias("variable"), ((F.col("s_acctbal") + 1000) / 11000).cast("double").alias("prior"), hard)), factors


def junction_tree_rings(spark, sf_dir):
    return _rounded(junction_tree.marginals(*rings(spark, sf_dir)), 4)


#: A region's 2^(nations + 1) states; suppliers are summed out of each nation first.
_RINGS = """WITH s AS (SELECT s_suppkey, s_nationkey AS k, least(greatest((s_acctbal + 1000) / 11000, 0.001), 0.999) AS p FROM supplier),
n AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
told AS (SELECT n.k, coalesce(sum(ln(p * 0.6 + (1 - p) * 0.45)), 0) AS l1, coalesce(sum(ln(p * 0.4 + (1 - p) * 0.55)), 0) AS l0 FROM n LEFT JOIN s USING (k) GROUP BY n.k),
x AS (SELECT r, n, unnest(range((1 << (n + 1)::int)::bigint)) AS x FROM (SELECT DISTINCT r, n FROM n)),
terms AS (SELECT x.r, x, ((x >> i::int) & 1) AS a, ((x >> ((i + 1) % n.n)::int) & 1) AS b, ((x >> n.n::int) & 1) AS c, l0, l1, n.n FROM x JOIN n USING (r) JOIN told ON told.k = n.k),
logs AS (SELECT r, x, sum(CASE WHEN a = 1 THEN l1 ELSE l0 END + ln(CASE WHEN a = 1 THEN CASE WHEN c = 1 THEN 0.9 ELSE 0.1 END ELSE CASE WHEN c = 1 THEN 0.4 ELSE 0.6 END END) + CASE WHEN n > 1 THEN ln(CASE WHEN a = b THEN 1.2 ELSE 0.8 END) ELSE 0 END) AS l FROM terms GROUP BY r, x),
w AS (SELECT r, x, exp(l - max(l) OVER (PARTITION BY r)) AS w FROM logs),
nation_p AS (SELECT n.k, sum(CASE WHEN ((x >> i::int) & 1) = 1 THEN w ELSE 0 END) / sum(w) AS q FROM w JOIN n USING (r) GROUP BY n.k)
SELECT 'n' || k AS variable, round(q, 4) AS belief FROM nation_p
UNION ALL SELECT 'r' || w.r, round(sum(CASE WHEN ((x >> n::int) & 1) = 1 THEN w ELSE 0 END) / sum(w), 4) FROM w JOIN (SELECT DISTINCT r, n FROM n) z ON z.r = w.r GROUP BY w.r
UNION ALL SELECT 's' || s_suppkey, round(q * p * 0.6 / (p * 0.6 + (1 - p) * 0.45) + (1 - q) * p * 0.4 / (p * 0.4 + (1 - p) * 0.55), 4) FROM s JOIN nation_p USING (k)"""


def belief_propagation(spark, sf_dir):
    """A few damped rounds on the whole tree of regions, nations, suppliers and customers."""
    edges = T.strategy_edges(spark, sf_dir)
    none = F.lit(None)
    factors = edges.select(F.concat_ws(">", "child", "parent").alias("factor"), F.lit("soft_entailment").alias("kind"), F.array("child").alias("inputs"), F.col("parent").alias("conclusion"), F.lit(0.55).alias("p1"), F.lit(0.6).alias("p2"), none.cast("array<double>").alias("weights"))
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("variable")).distinct()
    variables = nodes.select("variable", (0.2 + F.length("variable") / 10).alias("prior"), none.cast("int").alias("hard"))
    return _rounded(message_passing.loopy(variables, factors, damping=DAMPING, most_rounds=ROUNDS, threshold=0.0), 6)


def _bp_sql() -> str:
    from credograph.plans.shared import EDGES

    odds = lambda p: f"(ln({p}) - ln(1 - {p}))"
    out = f"""WITH e AS {EDGES}, nodes AS (SELECT DISTINCT variable FROM (SELECT child AS variable FROM e UNION ALL SELECT parent FROM e)),
base AS (SELECT variable, ln(p) - ln(1 - p) AS base FROM (SELECT variable, least(greatest(0.2 + length(variable) / 10.0::double, 0.001), 0.999) AS p FROM nodes)),
m0 AS (SELECT child, parent, 0.5::double AS up, 0.5::double AS down FROM e)"""
    total = lambda k: f"t{k} AS (SELECT variable, base + coalesce(m, 0) AS total FROM base LEFT JOIN (SELECT variable, sum(m) AS m FROM (SELECT parent AS variable, {odds('up')} AS m FROM m{k} UNION ALL SELECT child, {odds('down')} FROM m{k}) GROUP BY variable) USING (variable))"
    for k in range(ROUNDS):
        out += f""",
{total(k)},
m{k + 1} AS (SELECT child, parent, {DAMPING}::double * (q * 0.55 + (1 - q) * 0.4) + {1 - DAMPING}::double * up AS up, {DAMPING}::double * d1 / (d1 + d0) + {1 - DAMPING}::double * down AS down
  FROM (SELECT *, r * 0.55 + (1 - r) * 0.45 AS d1, r * 0.4 + (1 - r) * 0.6 AS d0 FROM (SELECT child, parent, up, down, 1 / (1 + exp(-(a.total - {odds('down')}))) AS q, 1 / (1 + exp(-(b.total - {odds('up')}))) AS r FROM m{k} JOIN t{k} a ON a.variable = child JOIN t{k} b ON b.variable = parent)))"""
    return out + f",\n{total(ROUNDS)}\nSELECT variable, round(1 / (1 + exp(-total)), 6) AS belief FROM t{ROUNDS}"


#: Type of a supplier's strategy by its key, modulo 7.
TYPES = ("infer", "noisy_and", "deduction", "support", "associate", "analogy", "composite")


def reasoning(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A strategy of one of seven types for each supplier: from it and the customer of the same key
    to a claim about both. A composite stands for the strategy of the supplier before it; an
    association whose chances would come too near 0 or 1 is an infer. Each nation denies that two of its suppliers are right, said
    twice, and has a helper claim. Some told priors are repeated; the last counts."""
    s, c = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "customer")
    key, k = F.col("s_suppkey"), F.col("s_suppkey") % 7
    name = lambda kind, x: F.concat(F.lit(kind), x.cast("string"))
    label, no = (lambda x: x.alias("label")), F.lit(False).alias("helper")
    claim = lambda df, x, p: df.select(x.alias("id"), label(x), no, p.cast("double").alias("prior"))
    claims = claim(s, name("s", key), (F.col("s_acctbal") + 1000) / 11000).unionByName(claim(c, name("c", F.col("c_custkey")), F.when(F.col("c_nationkey") < 20, (F.col("c_acctbal") + 1000) / 11000))).unionByName(claim(s, name("t", key), F.lit(None)))
    nation = T.table(spark, sf_dir, "nation")
    claims = claims.unionByName(nation.select(name("helper", F.col("n_nationkey")).alias("id"), F.lit("__made").alias("label"), F.lit(True).alias("helper"), F.lit(0.7).alias("prior")))
    pairs = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b")).filter("a != b")
    claims = claims.unionByName(claim(pairs, name("not_both_", F.col("s_nationkey")), F.lit(0.3)))
    twice = pairs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("time"))
    ends = [name("s", F.col("a")), name("s", F.col("b"))]
    operators = twice.select(F.concat_ws("-", "s_nationkey", "time").alias("operator_id"), F.lit("contradiction").alias("operator"), F.when(F.col("time") == 1, F.array(*ends)).otherwise(F.array(*ends[::-1])).alias("variables"), name("not_both_", F.col("s_nationkey")).alias("conclusion"), "time", F.lit(None).cast("string").alias("action_label"), F.lit(False).alias("connective"))
    operators = operators.withColumnRenamed("time", "pos")
    p = (F.col("s_acctbal") + 1000) / 11000
    # the chances of an association fit the two claims' priors: what both hold lies half way between its bounds
    b = F.when(F.col("c_nationkey") < 20, (F.col("c_acctbal") + 1000) / 11000)
    s = s.join(c.select(F.col("c_custkey").alias("s_suppkey"), "c_nationkey", "c_acctbal"), "s_suppkey", "left")
    inside = lambda x: x.between(0.05, 0.95)
    # greatest and least pass over nulls: without the customer's prior there are no bounds
    meet = F.when(b.isNotNull(), (F.greatest(p + b - 1, F.lit(0.0)) + F.least(p, b)) / 2)
    chance = {"p_a_given_b": F.coalesce(meet / b, F.lit(0.9)), "p_b_given_a": F.coalesce(meet / p, 0.9 * (1 - p))}
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (k + 1).cast("int"))
    kind = F.when((kind == "associate") & ~(inside(p) & (b.isNull() | inside(b))), "infer").otherwise(kind)
    # a composite whose supplier before it is in no table has no parts, so it stands for nothing
    s = s.join(s.select((key + 1).alias("s_suppkey"), F.lit(True).alias("after")), "s_suppkey", "left")
    one = F.array(name("s", key))
    both = F.array(name("s", key), name("c", key))
    strategies = s.select(
        key.cast("string").alias("strategy_id"), kind.alias("type"), F.when(kind.isin("support", "composite"), one).otherwise(both).alias("premises"), name("t", key).alias("conclusion"),
        F.when(kind == "infer", F.array(p / 2, p / 3, p / 4, F.greatest(p, F.lit(0.0)))).when(kind == "noisy_and", F.array(p)).alias("cpt"),
        *[F.when(kind == "associate", v).alias(c) for c, v in chance.items()],
        F.when((kind == "composite") & F.col("after"), F.array((key - 1).cast("string"))).alias("sub_strategies"), F.lit(None).cast(FORMAL).alias("formal"),
        F.when(F.col("s_nationkey") % 2 == 0, 0.2).alias("base_rate"), F.when(kind == "support", p).alias("prior"), key.alias("pos"), F.when(F.col("s_nationkey") == 5, "act").alias("action_label"),
    )
    said = lambda rows, x, q, at: rows.select(x.alias("id"), q.cast("double").alias("prior"), F.lit(at).alias("pos"))
    even = s.filter("s_suppkey % 2 = 0")
    told = said(even.filter("s_suppkey % 3 = 0"), name("t", key), F.lit(0.11), 1).unionByName(said(even, name("t", key), p / 2, 2)).unionByName(said(nation, name("helper", F.col("n_nationkey")), F.lit(0.2), 1))
    reviews = s.select(key.cast("string").alias("target_id"), F.explode(F.array(F.struct(F.lit("accepted").alias("status"), F.lit(1).alias("round")), F.struct(F.when(key % 3 == 0, "rejected").otherwise("accepted").alias("status"), F.lit(2).alias("round")))).alias("x")).select("target_id", "x.status", "x.round", F.col("x.round").alias("pos"))
    return {"claims": claims, "operators": operators, "strategies": strategies, "priors": told, "reviews": reviews}


def lowered_factors(spark, sf_dir):
    _, factors = lowering_graph.lower(**reasoning(spark, sf_dir))
    cell = lambda i: F.round(F.get("weights", F.lit(i)), 6).alias(f"w{i}")
    # helper ids are hashes: told by their role
    plain = lambda x: F.regexp_replace(x, "^local:package::__(.*)_[0-9a-f]{8}$", "$1")
    return factors.select("factor", "kind", F.array_join(F.transform("inputs", plain), ",").alias("inputs"), plain(F.col("conclusion")).alias("conclusion"), F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"), F.size(F.coalesce("weights", F.array().cast("array<double>"))).alias("n_weights"), cell(0), cell(1), cell(3))


def lowered_claims(spark, sf_dir):
    made = reasoning(spark, sf_dir)
    variables, _ = lowering_graph.lower(**made)
    return variables.join(made["claims"].select(F.col("id").alias("variable")), "variable", "left_semi").select("variable", F.round("prior", 6).alias("prior"), "hard")


def lowered_beliefs(spark, sf_dir):
    """Beliefs of the whole reasoning graph by junction tree; tested in parts."""
    return _rounded(junction_tree.marginals(*lowering_graph.lower(**reasoning(spark, sf_dir))), 6)


def repeated_operators(spark, sf_dir):
    return lowering_graph.dropped(reasoning(spark, sf_dir)["operators"])


_S = "(SELECT *, s_suppkey % 7 AS k, (s_acctbal + 1000) / 11000 AS p, s_nationkey != 5 OR s_suppkey % 3 != 0 AS pass, 's' || s_suppkey AS s, 'c' || s_suppkey AS c, 't' || s_suppkey AS t, CASE WHEN s_suppkey % 2 = 0 THEN (s_acctbal + 1000) / 22000 END AS told FROM supplier)"
#: A supplier's strategy with its customer's prior b; an association that doesn't fit is an infer (0).
_S = f"(SELECT * REPLACE (CASE WHEN k = 4 AND NOT (p BETWEEN 0.05 AND 0.95 AND coalesce(b, 0.5) BETWEEN 0.05 AND 0.95) THEN 0 ELSE k END AS k) FROM (SELECT x.*, CASE WHEN c_nationkey < 20 THEN (c_acctbal + 1000) / 11000 END AS b FROM {_S} x LEFT JOIN customer ON c_custkey = s_suppkey))"
_LOWERED = f"""WITH s AS {_S}, f AS (
SELECT 'infer:' || s_suppkey AS factor, 'conditional' AS kind, s || ',' || c AS inputs, t AS conclusion, NULL::double AS p1, NULL::double AS p2, 4 AS n_weights, p / 2 AS w0, p / 3 AS w1, greatest(p, 0) AS w3 FROM s WHERE k = 0 AND pass
UNION ALL SELECT '_m_na_' || s_suppkey || ':and', 'conjunction', s || ',' || c, '_m_na_' || s_suppkey, NULL, NULL, 0, NULL, NULL, NULL FROM s WHERE k = 1 AND pass
UNION ALL SELECT '_m_na_' || s_suppkey || ':then', 'soft_entailment', '_m_na_' || s_suppkey, t, p, 0.999, 0, NULL, NULL, NULL FROM s WHERE k = 1 AND pass
UNION ALL SELECT 'formal:' || s_suppkey || ':0', 'conjunction', s || ',' || c, 'conjunction_result', NULL, NULL, 0, NULL, NULL, NULL FROM s WHERE k IN (2, 5) AND pass
UNION ALL SELECT 'formal:' || s_suppkey || ':1', 'conditional', 'conjunction_result', t, NULL, NULL, 2, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN 0.2 END, told, 0.5), 0.999, NULL FROM s WHERE k = 2 AND pass
UNION ALL SELECT 'formal:' || s_suppkey || ':0', 'soft_entailment', s, t, p * 0.999 + (1 - p) * 0.5, 0.5, 0, NULL, NULL, NULL FROM s WHERE k = 3 AND pass
UNION ALL SELECT 'formal:' || s_suppkey || ':1', 'implication', 'conjunction_result,' || t, 'implication_result', NULL, NULL, 0, NULL, NULL, NULL FROM s WHERE k = 5 AND pass
UNION ALL SELECT 'assoc:' || s_suppkey, 'pairwise', s, c, NULL, NULL, 4, (1 - a - b + m) / ((1 - a) * (1 - b)), (a - m) / (a * (1 - b)), m / (a * b) FROM (
  SELECT *, CASE WHEN b0 IS NULL THEN 0.9 * a * (1 - a) ELSE (greatest(a + b0 - 1, 0) + least(a, b0)) / 2 END AS m, coalesce(b0, a * (1 - a)) AS b FROM (SELECT s_suppkey, s, c, p AS a, b AS b0 FROM s WHERE k = 4 AND pass))
UNION ALL SELECT 'op:' || s_nationkey || '-1', 'contradiction', 's' || min(s_suppkey) || ',s' || max(s_suppkey), 'not_both_' || s_nationkey, NULL, NULL, 0, NULL, NULL, NULL FROM supplier GROUP BY s_nationkey HAVING count(*) > 1)
SELECT factor, kind, inputs, conclusion, round(p1, 6) AS p1, round(p2, 6) AS p2, n_weights, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w3, 6) AS w3 FROM f"""

SQL: dict[str, str] = {
    "every_kind_exact": _gallery_sql(0.001, 0.999),
    "every_kind_junction_tree": _gallery_sql(0.001, 0.999),
    "every_kind_loopy": _gallery_sql(0.0, 1.0),
    "exact_posterior": _REGIONS + "SELECT r AS variable, round(q, 5) AS belief FROM w UNION ALL SELECT n, round(q * p * 0.9 / m1 + (1 - q) * p * 0.1 / m0, 5) FROM m JOIN w USING (r)",
    "exact_joint": _REGIONS + "SELECT a.x::int AS r0, b.x::int AS r1, round(CASE WHEN a.x = 1 THEN u.q ELSE 1 - u.q END * CASE WHEN b.x = 1 THEN v.q ELSE 1 - v.q END, 6) AS p FROM w u, w v, range(2) a(x), range(2) b(x) WHERE u.r = 'r0' AND v.r = 'r1'",
    "event_probability": _REGIONS + "SELECT round(u.q + (1 - u.q) * (1 - v.q), 4) AS p FROM w u, w v WHERE u.r = 'r0' AND v.r = 'r1'",
    "junction_tree_rings": _RINGS,
    "belief_propagation": _bp_sql(),
    "lowered_factors": _LOWERED,
    "lowered_claims": """SELECT 's' || s_suppkey AS variable, round((s_acctbal + 1000) / 11000, 6) AS prior, NULL::int AS hard FROM supplier
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_nationkey < 20 THEN round((c_acctbal + 1000) / 11000, 6) END, NULL FROM customer
UNION ALL SELECT t, round(told, 6), NULL FROM {S} WHERE NOT (k = 4 AND pass)
UNION ALL SELECT 'helper' || n_nationkey, NULL, NULL FROM nation
UNION ALL SELECT 'not_both_' || s_nationkey, NULL, 1 FROM supplier GROUP BY s_nationkey HAVING count(*) > 1""".replace("{S}", _S),
    "repeated_operators": "SELECT s_nationkey || '-2' AS operator_id, 'contradiction' AS operator, 'not_both_' || s_nationkey AS conclusion FROM supplier GROUP BY s_nationkey HAVING count(*) > 1",
}


def distribution_functions(spark, sf_dir):
    """P(X <= x) of every family at a point made of a supplier's balance."""
    x, whole = F.col("s_acctbal") / 1000, F.floor(F.abs(F.col("s_acctbal")) / 500)
    each = {
        "normal": cumulative("normal", x, mu=4.5, sigma=3.0), "lognormal": cumulative("lognormal", x, mu=1.0, sigma=0.8), "cauchy": cumulative("cauchy", x, mu=4.0, gamma=2.0),
        "studentt": cumulative("studentt", x, df=3.0, mu=4.0, sigma=2.5), "exponential": cumulative("exponential", x, rate=0.2), "gamma": cumulative("gamma", x, alpha=3.0, rate=0.5),
        "chisquared": cumulative("chisquared", x, df=4.0), "beta": cumulative("beta", x / 11, alpha=2.0, beta=3.0), "poisson": cumulative("poisson", whole, rate=9.0),
        "binomial": cumulative("binomial", whole, n=15, p=0.4), "betabinomial": cumulative("betabinomial", whole, n=15, alpha=2.0, beta=2.0),
    }
    rows = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(F.array(*[F.struct(F.lit(k).alias("family"), v.alias("p")) for k, v in each.items()])))
    return rows.withColumn("p", F.round("p", 5))


def predicate_priors(spark, sf_dir):
    """Priors of the claims that a balance, measured with an error, is above 5000, and that a number
    of events is below a threshold."""
    c = T.table(spark, sf_dir, "customer")
    above = predicate_prior("normal", ">", F.lit(5000.0), mu=F.col("c_acctbal"), sigma=2000.0)
    fewer = predicate_prior("poisson", "<", F.col("c_acctbal") / 1000, rate=4.0)
    return c.select("c_custkey", F.round(above, 5).alias("above"), F.round(fewer, 5).alias("fewer"))


def _phi(z: str) -> str:
    """The normal distribution function by Simpson's rule on 400 steps; 0 and 1 beyond 8."""
    step = f"list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(({z}) * i / 400.0, 2))))"
    return f"(CASE WHEN ({z}) > 8 THEN 1.0 WHEN ({z}) < -8 THEN 0.0 ELSE 0.5 + ({z}) / 1200 / sqrt(2 * pi()) * {step} END)"


def _steps(mass: str, top: str) -> str:
    return f"coalesce(list_sum(list_transform(range(0, greatest({top} + 1, 0)::bigint), lambda i: {mass})), 0)"


def _distribution_sql() -> str:
    choose = "lgamma(16) - lgamma(i + 1) - lgamma(16 - i)"
    beta = "lgamma(i + 2) + lgamma(17 - i) - lgamma(19) - (lgamma(2) + lgamma(2) - lgamma(4))"
    erlang = lambda k, y: f"CASE WHEN x <= 0 THEN 0 ELSE 1 - exp(-{y}) * (" + " + ".join(f"({y}) ** {j} / {math.factorial(j)}" for j in range(k)) + ") END"
    b = "least(greatest(x / 11, 0), 1)"
    each = {
        "normal": _phi("(x - 4.5) / 3"), "lognormal": f"CASE WHEN x <= 0 THEN 0 ELSE {_phi('(ln(CASE WHEN x > 0 THEN x ELSE 1 END) - 1) / 0.8')} END", "cauchy": "0.5 + atan((x - 4) / 2) / pi()",
        "studentt": "0.5 + (u / sqrt(3) / (1 + u * u / 3) + atan(u / sqrt(3))) / pi()", "exponential": "CASE WHEN x <= 0 THEN 0 ELSE 1 - exp(-0.2 * x) END", "gamma": erlang(3, "(0.5 * x)"), "chisquared": erlang(2, "(x / 2)"),
        "beta": f"6 * {b} ** 2 * (1 - {b}) ** 2 + 4 * {b} ** 3 * (1 - {b}) + {b} ** 4", "poisson": _steps("exp(i * ln(9) - 9 - lgamma(i + 1))", "k"),
        "binomial": _steps(f"exp({choose} + i * ln(0.4) + (15 - i) * ln(0.6))", "least(k, 15)"), "betabinomial": _steps(f"exp({choose} + {beta})", "least(k, 15)"),
    }
    rows = " UNION ALL ".join(f"SELECT s_suppkey, '{f}' AS family, ({v})::double AS p FROM t" for f, v in each.items())
    return f"WITH t AS (SELECT s_suppkey, s_acctbal / 1000 AS x, (s_acctbal / 1000 - 4) / 2.5 AS u, floor(abs(s_acctbal) / 500)::bigint AS k FROM supplier) SELECT s_suppkey, family, round(p, 5) AS p FROM ({rows})"


SQL["distribution_functions"] = _distribution_sql()
SQL["predicate_priors"] = f"SELECT c_custkey, round(least(greatest(1 - {_phi('(5000 - c_acctbal) / 2000')}, 0.001), 0.999), 5) AS above, round(least(greatest({_steps('exp(i * ln(4) - 4 - lgamma(i + 1))', 'ceil(c_acctbal / 1000) - 1')}, 0.001), 0.999), 5) AS fewer FROM customer"
ROWS_ONLY = ("lowered_beliefs",)

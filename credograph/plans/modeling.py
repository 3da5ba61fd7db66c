"""More queries: lowering, logic, densities, checks and event logs, each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from credograph.functions.densities import log_density
from credograph.operators import graph, lowering, priors, trace, validation
from credograph.plans import shared as S
from credograph.sources import tables as T

def _unit(column: str) -> Column:
    return F.col(column) / 600000


def support_factors(spark, sf_dir):
    p1, p2 = lowering.support(F.when(F.col("o_totalprice").isNotNull(), F.least(_unit("o_totalprice"), F.lit(0.999))))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", F.round(p1, 6).alias("p1"), p2.alias("p2"))


def _cells(df, key, table):
    return df.select(key, F.posexplode(table).alias("cell", "p")).withColumn("p", F.round("p", 6))


def deduction_cells(spark, sf_dir):
    q = F.when(F.col("s_nationkey") % 2 == 0, (F.col("s_acctbal") + 1000) / 11000)
    return _cells(T.table(spark, sf_dir, "supplier"), "s_suppkey", lowering.deduction(q))


def infer_cells(spark, sf_dir):
    q = (F.col("s_acctbal") + 1000) / 11000
    return _cells(T.table(spark, sf_dir, "supplier"), "s_suppkey", lowering.infer(q, q / 2, 2))


def _pairs(spark, sf_dir):
    p = 0.1 + F.col("p_size") / 100
    known = F.when(F.col("p_partkey") % 3 > 0, 0.2 + F.col("p_size") / 1000)
    return T.table(spark, sf_dir, "part").select("p_partkey", p.alias("ab"), (p * 0.9).alias("ba"), known.alias("a"), F.when(F.col("p_partkey") % 3 == 2, F.lit(0.3)).alias("b"))


def associate_weights(spark, sf_dir):
    found = lowering.associate(_pairs(spark, sf_dir), "ab", "ba", "a", "b")
    return found.select("p_partkey", "problem", *[F.round(c, 6).alias(c) for c in ("p00", "p11", "w00", "w10", "w01", "w11")])


def maxent_pair(spark, sf_dir):
    cells = lowering.maxent_joint(F.col("ab"), F.col("ba"))
    return _pairs(spark, sf_dir).select("p_partkey", *[F.round(v, 6).alias(k) for k, v in cells.items()])


def trw_weights(spark, sf_dir):
    e = T.strategy_edges(spark, sf_dir)
    factors = e.select(F.concat_ws(">", "child", "parent").alias("factor"), F.explode(F.array("child", "parent")).alias("variable"))
    hard = factors.filter("variable like 'r%' or variable in ('n1', 'n2')").select("variable")
    return lowering.tree_weights(factors, hard).withColumn("rho", F.round("rho", 6))


def moral_graph(spark, sf_dir):
    return graph.moral_edges(T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("factor"), F.col("l_suppkey").alias("variable")))


def connected_components(spark, sf_dir):
    return graph.components(T.strategy_edges(spark, sf_dir))


def log_densities(spark, sf_dir):
    x, whole = F.col("s_acctbal") / 1000, F.floor(F.abs(F.col("s_acctbal")) / 500)
    each = {
        "normal": log_density("normal", x, mu=4.5, sigma=3.0), "lognormal": log_density("lognormal", x, mu=1.0, sigma=0.8), "cauchy": log_density("cauchy", x, mu=4.0, gamma=2.0),
        "studentt": log_density("studentt", x, df=4.0, mu=4.0, sigma=2.5), "exponential": log_density("exponential", x, rate=0.2), "gamma": log_density("gamma", x, alpha=2.0, rate=0.5),
        "chisquared": log_density("chisquared", x, df=5.0), "beta": log_density("beta", x / 11, alpha=2.0, beta=3.0), "poisson": log_density("poisson", whole, rate=9.0),
        "binomial": log_density("binomial", whole, n=15, p=0.4), "betabinomial": log_density("betabinomial", whole, n=15, alpha=2.0, beta=2.0),
    }
    rows = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(F.array(*[F.struct(F.lit(k).alias("family"), v.alias("log_p")) for k, v in each.items()])))
    return rows.filter("log_p > double('-infinity')").withColumn("log_p", F.round("log_p", 6))


def prior_overridden(spark, sf_dir):
    records = T.prior_records(spark, sf_dir)
    winner = priors.resolve(records, "latest").select("knowledge_id", F.col("value").alias("winner"))
    return records.join(winner, "knowledge_id").filter("abs(value - winner) > 1e-9").select("knowledge_id", "pos", F.round("value", 6).alias("value"), F.round("winner", 6).alias("winner"))


def _claims(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))


def validate_priors(spark, sf_dir):
    """Records of customers, where only keys that are a supplier's too are known claims."""
    claims = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    return validation.check_priors(T.prior_records(spark, sf_dir), claims, claims.filter("s_nationkey = 7"))


def validate_strategies(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent"))
    return validation.check_strategies(edges, n.filter("n_nationkey between 2 and 19").select(F.col("n_nationkey").alias("id")))


def validate_claims(spark, sf_dir):
    return validation.check_claims(_claims(spark, sf_dir), "^[1-9]*$")


def _log(spark, sf_dir):
    """Conversations as an event log; every seventh event of a log has no known parent."""
    at = F.col("turn") % 7
    return T.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role")).select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("seq"), F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("role").alias("actor"),
        F.when(F.col("role") == "user", "tool_call").when(at == 1, "retry").when(at == 3, "tool_result").otherwise("decision").alias("kind"),
        F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"), F.when(at == 6, F.lit("x")).otherwise((F.col("turn") - 1).cast("string")))).alias("parent_event_id"),
        F.when(at == 5, F.lit("timeout")).alias("error"),
    )


def tool_pairing(spark, sf_dir):
    return trace.open_tool_calls(_log(spark, sf_dir))


def orphan_parents(spark, sf_dir):
    return trace.orphans(_log(spark, sf_dir))


def retry_chains(spark, sf_dir):
    """Chains of at least one retry, as the logs of a conversation are short."""
    return trace.retry_chains(_log(spark, sf_dir), 0)


_LOG = """(SELECT conv_id AS trace_id, turn AS seq, conv_id || ':' || turn AS event_id, role AS actor, CASE WHEN role = 'user' THEN 'tool_call' WHEN turn % 7 = 1 THEN 'retry' WHEN turn % 7 = 3 THEN 'tool_result' ELSE 'decision' END AS kind,
  CASE WHEN turn > 0 THEN conv_id || ':' || CASE WHEN turn % 7 = 6 THEN 'x' ELSE (turn - 1)::varchar END END AS parent_event_id, CASE WHEN turn % 7 = 5 THEN 'timeout' END AS error FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL))"""
_PAIRS = "(SELECT p_partkey, 0.1::double + p_size / 100.0::double AS ab, (0.1::double + p_size / 100.0::double) * 0.9::double AS ba, CASE WHEN p_partkey % 3 > 0 THEN 0.2::double + p_size / 1000.0::double END AS a, CASE WHEN p_partkey % 3 = 2 THEN 0.3::double END AS b FROM part)"
_MAXENT = "SELECT *, exp((u * ln(u) + v * ln(v)) / (1 + u + v)) AS s FROM (SELECT *, (1 - ba) / ba AS u, (1 - ab) / ab AS v FROM {})"
_Q = "(s_acctbal + 1000) / 11000"
_BITS = "(SELECT i & 1 = 1 AS a, i & 2 = 2 AS b, i & 4 = 4 AS c, i & 8 = 8 AS d FROM range(16) t(i))"


def _density_sql() -> str:
    pi, x, w = "pi()", "x", "w"
    beta = lambda a, b: f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
    choose = "(lgamma(16) - lgamma(w + 1) - lgamma(16 - w))"
    each = {
        "normal": f"-((x - 4.5) ** 2) / 18 - ln(3) - ln(2 * {pi}) / 2", "lognormal": f"CASE WHEN x > 0 THEN -((ln(x) - 1) ** 2) / 1.28 - ln(0.8) - ln(2 * {pi}) / 2 - ln(x) END", "cauchy": f"-ln(2 * {pi} * (1 + ((x - 4) / 2) ** 2))",
        "studentt": f"lgamma(2.5) - lgamma(2) - ln(4 * {pi}) / 2 - ln(2.5) - 2.5 * ln(1 + ((x - 4) / 2.5) ** 2 / 4)", "exponential": "CASE WHEN x >= 0 THEN ln(0.2) - 0.2 * x END", "gamma": "CASE WHEN x > 0 THEN 2 * ln(0.5) + ln(x) - 0.5 * x END",
        "chisquared": "CASE WHEN x > 0 THEN 2.5 * ln(0.5) - lgamma(2.5) + 1.5 * ln(x) - x / 2 END", "beta": f"CASE WHEN x > 0 AND x < 11 THEN ln(x / 11) + 2 * ln(1 - x / 11) - {beta(2, 3)} END", "poisson": "w * ln(9) - 9 - lgamma(w + 1)",
        "binomial": f"CASE WHEN w <= 15 THEN {choose} + w * ln(0.4) + (15 - w) * ln(0.6) END", "betabinomial": f"CASE WHEN w <= 15 THEN {choose} + {beta('w + 2', '17 - w')} - {beta(2, 2)} END",
    }
    rows = " UNION ALL ".join(f"SELECT s_suppkey, '{k}' AS family, round({v}, 6) AS log_p FROM t" for k, v in each.items())
    return f"WITH t AS (SELECT s_suppkey, s_acctbal / 1000 AS {x}, floor(abs(s_acctbal) / 500) AS {w} FROM supplier) SELECT * FROM ({rows}) WHERE log_p IS NOT NULL"


_CLAIMS = "(SELECT c_custkey AS id, c_mktsegment AS label FROM customer)"
_N = "(SELECT n_nationkey AS id FROM nation WHERE n_nationkey BETWEEN 2 AND 19)"

SQL: dict[str, str] = {
    "support_factors": "SELECT o_orderkey, round(h * 0.999::double + (1 - h) * 0.5::double, 6) AS p1, 0.5::double AS p2 FROM (SELECT o_orderkey, least(o_totalprice / 600000, 0.999::double) AS h FROM orders)",
    "deduction_cells": f"SELECT s_suppkey, 0 AS cell, round(CASE WHEN s_nationkey % 2 = 0 THEN {_Q} ELSE 0.5 END, 6) AS p FROM supplier UNION ALL SELECT s_suppkey, 1, 0.999::double FROM supplier",
    "infer_cells": f"SELECT s_suppkey, c::int AS cell, round(CASE c WHEN 6 THEN {_Q} / 2 WHEN 7 THEN {_Q} ELSE 0.5 END, 6) AS p FROM supplier, range(8) t(c)",
    "maxent_pair": f"SELECT p_partkey, round(s / z, 6) AS p00, round(u / z, 6) AS p10, round(v / z, 6) AS p01, round(1 / z, 6) AS p11 FROM (SELECT *, 1 + u + v + s AS z FROM ({_MAXENT.format(_PAIRS)}))",
    "associate_weights": f"""WITH c AS ({_MAXENT.format("(SELECT p_partkey, a AS a0, b AS b0, least(greatest(ab, 0.001), 0.999) AS ab, least(greatest(ba, 0.001), 0.999) AS ba FROM " + _PAIRS + ")")}),
m AS (SELECT *, a0 IS NULL AND b0 IS NULL AS free, coalesce(a0, b0 * ab / ba) AS a, coalesce(b0, a0 * ba / ab) AS b FROM c),
j AS (SELECT *, (ba * a + ab * b) / 2 AS t, 1 + u + v + s AS z FROM m),
k AS (SELECT *, CASE WHEN free THEN NULL WHEN NOT (a > 0 AND a < 1 AND b > 0 AND b < 1) THEN 'marginal' WHEN abs(ba * a - ab * b) > 1e-6 THEN 'inconsistent' WHEN least(1 - a - b + t, a - t, b - t, t) < -1e-6 THEN 'negative' END AS problem,
  CASE WHEN free THEN s / z ELSE greatest(1 - a - b + t, 0) END AS q00, CASE WHEN free THEN u / z ELSE greatest(a - t, 0) END AS q10, CASE WHEN free THEN v / z ELSE greatest(b - t, 0) END AS q01, CASE WHEN free THEN 1 / z ELSE greatest(t, 0) END AS q11 FROM j)
SELECT p_partkey, problem, CASE WHEN problem IS NULL THEN round(q00, 6) END AS p00, CASE WHEN problem IS NULL THEN round(q11, 6) END AS p11, CASE WHEN problem IS NULL THEN round(q00 / CASE WHEN free THEN 0.25 ELSE (1 - a) * (1 - b) END, 6) END AS w00,
  CASE WHEN problem IS NULL THEN round(q10 / CASE WHEN free THEN 0.25 ELSE a * (1 - b) END, 6) END AS w10, CASE WHEN problem IS NULL THEN round(q01 / CASE WHEN free THEN 0.25 ELSE (1 - a) * b END, 6) END AS w01, CASE WHEN problem IS NULL THEN round(q11 / CASE WHEN free THEN 0.25 ELSE a * b END, 6) END AS w11 FROM k""",
    "trw_weights": f"""WITH v AS (SELECT child || '>' || parent AS factor, unnest([child, parent]) AS variable FROM {S.EDGES}), h AS (SELECT *, variable LIKE 'r%' OR variable IN ('n1', 'n2') AS hard FROM v),
s AS (SELECT factor, bool_or(NOT hard) AS soft FROM h GROUP BY 1) SELECT factor, round(CASE WHEN NOT soft THEN 1.0 ELSE least(1.0, ((SELECT count(DISTINCT variable) FROM h WHERE NOT hard) - 1) / (SELECT count(*) FROM s WHERE soft)) END, 6)::double AS rho FROM s""",
    "moral_graph": "SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey",
    "connected_components": f"""WITH RECURSIVE e AS (SELECT child AS x, parent AS y FROM {S.EDGES} UNION ALL SELECT parent, child FROM {S.EDGES}), up AS (SELECT child AS node, parent AS root FROM {S.EDGES} UNION SELECT node, parent FROM up JOIN {S.EDGES} g ON root = g.child),
r AS (SELECT node, root FROM up WHERE root LIKE 'r%' UNION SELECT root, root FROM up WHERE root LIKE 'r%') SELECT node, min(node) OVER (PARTITION BY root) AS component FROM r""",
    "log_densities": _density_sql(),
    "prior_overridden": f"WITH p AS {S.PRIORS} SELECT knowledge_id, pos, round(value, 6) AS value, round(winner, 6) AS winner FROM (SELECT *, first_value(value) OVER (PARTITION BY knowledge_id ORDER BY created_at DESC, pos) AS winner FROM p) WHERE abs(value - winner) > 1e-9",
    "validate_priors": f"""WITH p AS {S.PRIORS}, f AS (SELECT 'prior_dangling' AS check_name, knowledge_id FROM p WHERE knowledge_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'prior_on_helper', knowledge_id FROM p WHERE knowledge_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7) UNION ALL SELECT 'prior_out_of_bounds', knowledge_id FROM p WHERE NOT value BETWEEN 0.001 AND 0.999)
SELECT check_name, knowledge_id::varchar AS id, count(*) AS n_records FROM f GROUP BY ALL""",
    "validate_strategies": f"SELECT DISTINCT check_name, id::varchar AS id FROM (SELECT 'premise_unknown' AS check_name, n_nationkey AS id FROM nation WHERE n_nationkey NOT IN {_N} UNION ALL SELECT 'conclusion_unknown', n_regionkey FROM nation WHERE n_regionkey NOT IN {_N} UNION ALL SELECT 'self_loop', n_nationkey FROM nation WHERE n_nationkey = n_regionkey)",
    "validate_claims": f"SELECT 'id_shape' AS check_name, id::varchar AS id FROM {_CLAIMS} WHERE NOT regexp_full_match(id::varchar, '[1-9]*') UNION ALL SELECT 'id_repeated', id::varchar FROM {_CLAIMS} GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'label_repeated', label FROM {_CLAIMS} GROUP BY label HAVING count(*) > 1",
    "tool_pairing": f"""WITH l AS {_LOG} SELECT trace_id, seq, event_id FROM l c WHERE kind = 'tool_call' AND NOT EXISTS (SELECT 1 FROM l f WHERE f.trace_id = c.trace_id AND f.seq > c.seq
  AND (f.kind IN ('tool_result', 'retry') AND f.parent_event_id = c.event_id OR f.kind = 'decision' AND f.error IS NOT NULL AND f.actor = c.actor))""",
    "orphan_parents": f"WITH l AS {_LOG} SELECT trace_id, event_id, parent_event_id FROM l WHERE parent_event_id IS NOT NULL AND parent_event_id NOT IN (SELECT event_id FROM l)",
    "retry_chains": f"""WITH RECURSIVE l AS {_LOG}, w AS (SELECT event_id, parent_event_id AS at, 1 AS n FROM l WHERE kind = 'retry' UNION ALL SELECT w.event_id, l.parent_event_id, n + (l.kind = 'retry')::int FROM w JOIN l ON l.event_id = w.at)
SELECT event_id, max(n)::bigint AS n_retries FROM w GROUP BY 1""",
}

#: Registered without SQL.
ROWS_ONLY = ()

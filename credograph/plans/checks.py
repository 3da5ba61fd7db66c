"""Queries on what a reasoning graph lacks or breaks, each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from credograph.functions import names
from credograph.operators import diagnostics, validation
from credograph.operators.formalize import FORMAL
from credograph.plans.beliefs import reasoning
from credograph.plans.shared import EDGES
from credograph.sources import tables as T


def _name(kind: str, c) -> Column:
    return F.concat(F.lit(kind), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The reasoning graph with a question for each region, and a note for each nation that is the
    background of its suppliers' strategies."""
    made = reasoning(spark, sf_dir)
    supplier = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("strategy_id"), F.array(_name("note", "s_nationkey")).alias("background"))
    made["strategies"] = made["strategies"].join(supplier, "strategy_id")
    other = T.table(spark, sf_dir, "region").select(_name("q", "r_regionkey").alias("id"), F.lit("question").alias("type")).unionByName(T.table(spark, sf_dir, "nation").select(_name("note", "n_nationkey").alias("id"), F.lit("note").alias("type")))
    made["knowledges"] = made["claims"].select("id", F.lit("claim").alias("type")).unionByName(other)
    return made


def node_roles(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return diagnostics.roles(g["knowledges"], g["strategies"], g["operators"])


def role_counts(spark, sf_dir):
    return node_roles(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


def prior_holes(spark, sf_dir):
    g = _graph(spark, sf_dir)
    records = g["priors"].withColumnRenamed("id", "knowledge_id")
    return diagnostics.holes(g["claims"], diagnostics.roles(g["knowledges"], g["strategies"], g["operators"]), records)


def _balances(spark, sf_dir, scale: float = 11000.0):
    return T.table(spark, sf_dir, "supplier").select(_name("s", "s_suppkey").alias("variable"), ((F.col("s_acctbal") + 1000) / scale).alias("belief"))


def quality_gate(spark, sf_dir):
    goals = T.table(spark, sf_dir, "supplier").select(_name("s", "s_suppkey").alias("id")).unionByName(T.table(spark, sf_dir, "nation").select(_name("n", "n_nationkey").alias("id")))
    return diagnostics.low_posteriors(goals, _balances(spark, sf_dir), 0.3).withColumn("belief", F.round("belief", 6))


def belief_drops(spark, sf_dir):
    found = diagnostics.belief_drops(_balances(spark, sf_dir), _balances(spark, sf_dir, 16000.0), 0.2)
    return found.select("variable", *[F.round(c, 4).alias(c) for c in ("before", "after", "drop")])


def belief_deltas(spark, sf_dir):
    variables = T.table(spark, sf_dir, "supplier").select(_name("s", "s_suppkey").alias("variable"), F.when(F.col("s_suppkey") % 3 != 0, F.lit(0.4)).alias("prior"), F.when(F.col("s_nationkey") == 2, 1).alias("hard"))
    return diagnostics.deltas(variables, _balances(spark, sf_dir)).select("variable", "prior", *[F.round(c, 6).alias(c) for c in ("belief", "delta")])


def disconnected_evidence(spark, sf_dir):
    edges = T.strategy_edges(spark, sf_dir)
    goals = T.table(spark, sf_dir, "region").filter("r_regionkey % 2 = 0").select(_name("r", "r_regionkey").alias("id"))
    return diagnostics.unreached(edges, goals, edges.select(F.col("child").alias("id")).distinct())


def diagnostic_ranking(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in [*diagnostics.RANKS["verify"], "something_else"]])
    rows = T.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("label"), F.element_at(kinds, (F.col("s_suppkey") % 22 + 1).cast("int")).alias("kind"), F.element_at(F.array(*map(F.lit, (*diagnostics.SEVERITIES, "other"))), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("severity"))
    return diagnostics.ranked(rows, "publish").select("label", "kind", "severity", F.col("rank_key.k").cast("int").alias("kind_rank"), F.col("rank_key.s").cast("int").alias("severity_rank"))


def gate_failures(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return diagnostics.gate(g["reviews"], g["strategies"].select(F.col("strategy_id").alias("target_id")))


def validate_operators(spark, sf_dir):
    """A conjunction for each supplier, of itself, its customer's key and its nation, where the
    knowledges are suppliers, nations (notes) and customers of positive balance."""
    s, c, n = (T.table(spark, sf_dir, x) for x in ("supplier", "customer", "nation"))
    known = s.select(_name("s", "s_suppkey").alias("id"), F.lit("claim").alias("type"), (F.col("s_suppkey") % 4 == 0).alias("helper"), F.lit(0.5).alias("prior"))
    known = known.unionByName(n.select(_name("n", "n_nationkey").alias("id"), F.lit("note").alias("type"), F.lit(False).alias("helper"), F.lit(None).cast("double").alias("prior")))
    known = known.unionByName(c.filter("c_acctbal > 0").select(_name("c", "c_custkey").alias("id"), F.lit("claim").alias("type"), F.lit(False).alias("helper"), F.lit(None).cast("double").alias("prior")))
    third = F.when(F.col("s_suppkey") % 5 == 0, _name("n", "s_nationkey")).otherwise(_name("s", "s_suppkey"))
    ops = s.select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "op_").otherwise("lco_"), F.col("s_suppkey").cast("string")).alias("operator_id"), F.array(_name("c", "s_suppkey"), third).alias("variables"), _name("s", "s_suppkey").alias("conclusion"))
    return validation.check_operators(ops, known)


def validate_composites(spark, sf_dir):
    """Suppliers' strategies as parts of their nations', nations as parts of their regions', and
    region 1 as a part of its first nation; suppliers of negative balance are missing."""
    s, n = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation")
    leaf = F.array().cast("array<string>")
    below = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_nationkey", "n_regionkey").agg(F.collect_set(_name("s", "s_suppkey")).alias("own"))
    first = n.filter("n_regionkey = 1").agg(F.min("n_nationkey").alias("k"))
    ring = below.crossJoin(F.broadcast(first)).withColumn("own", F.when(F.col("n_nationkey") == F.col("k"), F.concat("own", F.array(F.lit("r1")))).otherwise(F.col("own")))
    rows = s.filter("s_acctbal >= 0").select(_name("s", "s_suppkey").alias("strategy_id"), leaf.alias("sub_strategies")).unionByName(ring.select(_name("n", "n_nationkey").alias("strategy_id"), F.col("own").alias("sub_strategies")))
    regions = n.groupBy("n_regionkey").agg(F.collect_set(_name("n", "n_nationkey")).alias("sub_strategies")).select(_name("r", "n_regionkey").alias("strategy_id"), "sub_strategies")
    return validation.check_parts(rows.unionByName(regions).unionByName(regions.filter("strategy_id = 'r2'")))


def validate_background(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return validation.check_background(g["strategies"], g["knowledges"].filter("id != 'note3'"))


def _formal(spark, sf_dir):
    """A strategy for each supplier: two premises to a helper, the helper to a claim. Some embedded
    operators speak of a stranger, of another's helper, or go round in a ring."""
    k = F.col("s_suppkey")
    op = lambda vs, c: F.struct(F.lit("conjunction").alias("operator"), F.array(*vs).alias("variables"), c.alias("conclusion"))
    s, c, t, h = _name("s", k), _name("c", k), _name("t", k), _name("h", k)
    second = F.when(k % 4 == 1, F.lit("stranger")).when(k % 4 == 2, t).otherwise(c)
    formal = F.array(op([s, second], h), op([h, c], t)).cast(FORMAL)
    premises = F.when(k % 5 == 0, F.array(s, c, _name("h", k - 1))).otherwise(F.array(s, c))
    return T.table(spark, sf_dir, "supplier").select(k.cast("string").alias("strategy_id"), premises.alias("premises"), t.alias("conclusion"), formal.alias("formal"))


def validate_private(spark, sf_dir):
    ops = T.table(spark, sf_dir, "nation").select(F.array(_name("h", "n_nationkey")).alias("variables"), _name("n", "n_nationkey").alias("conclusion"))
    return validation.check_private(_formal(spark, sf_dir), ops)


def validate_closure(spark, sf_dir):
    return validation.check_closure(_formal(spark, sf_dir))


def qualified_names(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    name = names.qualified(F.lower("p_brand"), F.lit("pkg-1"), F.regexp_replace("p_type", " ", F.when(F.col("p_size") > 25, "_").otherwise(" ")))
    name = F.regexp_replace(name, "#", F.when(F.col("p_size") % 2 == 0, "_").otherwise("#"))
    return p.select("p_partkey", name.alias("name")).select("p_partkey", names.is_qualified(F.col("name")).alias("ok"), names.parts(F.col("name"))["label"].alias("label"))


def content_hashes(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    params = F.array(F.struct(F.lit("size").alias("name"), F.lit("Nat").alias("type")), F.struct(F.col("p_brand").alias("name"), F.lit("Real").alias("type")))
    return p.select("p_partkey", names.content_hash(F.lit("claim"), F.col("p_type"), params, F.lit("text")).alias("h"), names.strategy_id(F.lit("local"), F.lit("infer"), F.array("p_type", "p_brand"), F.when(F.col("p_size") > 10, F.col("p_brand")), F.lit(None).cast("string")).alias("strategy"))


_K = "SELECT *, s_suppkey % 7 AS k FROM supplier"
_ROLES = f"""WITH s AS ({_K}),
r AS (SELECT 's' || s_suppkey AS id, 'independent' AS role FROM s
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey IN (SELECT s_suppkey FROM s WHERE k IN (0, 1, 2, 4, 5)) THEN 'independent' ELSE 'orphaned' END FROM customer
UNION ALL SELECT 't' || s_suppkey, 'derived' FROM s
UNION ALL SELECT 'not_both_' || s_nationkey, 'structural' FROM supplier GROUP BY s_nationkey HAVING count(*) > 1
UNION ALL SELECT 'helper' || n_nationkey, 'orphaned' FROM nation
UNION ALL SELECT 'q' || r_regionkey, 'question' FROM region UNION ALL SELECT 'note' || n_nationkey, 'note' FROM nation)
"""
_P = "(SELECT 's' || s_suppkey AS variable, (s_acctbal + 1000) / 11000 AS belief, (s_acctbal + 1000) / 16000 AS less, s_suppkey, s_nationkey FROM supplier)"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_NAME = "replace(lower(p_brand) || ':pkg-1::' || CASE WHEN p_size > 25 THEN replace(p_type, ' ', '_') ELSE p_type END, '#', CASE WHEN p_size % 2 = 0 THEN '_' ELSE '#' END)"

SQL: dict[str, str] = {
    "node_roles": _ROLES + "SELECT * FROM r",
    "role_counts": _ROLES + "SELECT role, count(*) AS n FROM r GROUP BY 1",
    "prior_holes": _ROLES + "SELECT id FROM r JOIN customer ON id = 'c' || c_custkey WHERE role = 'independent' AND c_nationkey >= 20",
    "quality_gate": f"SELECT variable AS id, 'low_posterior' AS problem, round(belief, 6) AS belief FROM {_P} WHERE belief < 0.3 UNION ALL SELECT 'n' || n_nationkey, 'missing_belief', NULL FROM nation",
    "belief_drops": f"SELECT variable, round(belief, 4) AS before, round(less, 4) AS after, round(belief - less, 4) AS drop FROM {_P} WHERE belief - less >= 0.2",
    "belief_deltas": f"SELECT variable, 0.4::double AS prior, round(belief, 6) AS belief, round(belief - 0.4::double, 6) AS delta FROM {_P} WHERE s_suppkey % 3 != 0 AND s_nationkey != 2",
    "disconnected_evidence": f"WITH RECURSIVE e AS {EDGES}, up AS (SELECT child AS id, parent AS top FROM e UNION SELECT id, parent FROM up JOIN e ON top = child) SELECT DISTINCT child AS id FROM e WHERE child NOT IN (SELECT id FROM up WHERE top IN (SELECT 'r' || r_regionkey FROM region WHERE r_regionkey % 2 = 0))",
    "diagnostic_ranking": f"""SELECT label, kind, severity, coalesce(list_position({_list(diagnostics.RANKS["publish"])}, kind) - 1, 21)::int AS kind_rank, coalesce(list_position({_list(diagnostics.SEVERITIES)}, severity) - 1, 9)::int AS severity_rank
  FROM (SELECT s_name AS label, {_list([*diagnostics.RANKS["verify"], "something_else"])}[s_suppkey % 22 + 1] AS kind, {_list([*diagnostics.SEVERITIES, "other"])}[s_nationkey % 4 + 1] AS severity FROM supplier)""",
    "gate_failures": f"SELECT s_suppkey::varchar AS target_id, 'rejected' AS status FROM ({_K}) WHERE s_suppkey % 3 = 0",
    "validate_operators": """WITH o AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 'op_' ELSE 'lco_' END || s_suppkey AS oid FROM supplier)
SELECT 'operator_id_shape' AS check_name, oid AS id FROM o WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'operator_reference_unknown', oid FROM o WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'operator_reference_no_claim', oid FROM o WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'operator_conclusion_in_variables', oid FROM o WHERE s_suppkey % 5 != 0 UNION ALL SELECT 'helper_with_prior', 's' || s_suppkey FROM o WHERE s_suppkey % 4 = 0""",
    "validate_composites": """SELECT DISTINCT 'part_unknown' AS check_name, 'n' || s_nationkey AS id FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT DISTINCT 'strategy_id_repeated', 'r2' FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 'composite_cycle', unnest(['r1', 'n' || min(n_nationkey)]) FROM nation WHERE n_regionkey = 1""",
    "validate_background": f"SELECT 'background_unknown' AS check_name, s_suppkey::varchar AS id FROM ({_K}) WHERE s_nationkey = 3",
    "validate_private": """SELECT DISTINCT 'private_reference' AS check_name, 'h' || k AS id FROM (SELECT n_nationkey AS k FROM nation UNION SELECT s_suppkey - 1 FROM supplier WHERE s_suppkey % 5 = 0) WHERE k IN (SELECT s_suppkey FROM supplier)""",
    "validate_closure": "SELECT CASE s_suppkey % 4 WHEN 1 THEN 'formal_reference_unknown' ELSE 'formal_cycle' END AS check_name, s_suppkey::varchar AS id FROM supplier WHERE s_suppkey % 4 IN (1, 2)",
    "qualified_names": rf"""SELECT p_partkey, regexp_full_match(name, '[a-z][a-z0-9_]*:[a-z0-9][a-z0-9_\-]*::[A-Za-z_][A-Za-z0-9_]*') AS ok, CASE WHEN ok THEN split_part(name, '::', 2) END AS label FROM (SELECT p_partkey, {_NAME} AS name FROM part)""",
    "content_hashes": """SELECT p_partkey, sha256('claim|text|' || p_type || '|[' || CASE WHEN p_brand < 'size' THEN '(''' || p_brand || ''', ''Real''), (''size'', ''Nat'')' ELSE '(''size'', ''Nat''), (''' || p_brand || ''', ''Real'')' END || ']') AS h,
  'lcs_' || substr(sha256('local|infer|[''' || least(p_type, p_brand) || ''', ''' || greatest(p_type, p_brand) || ''']|' || CASE WHEN p_size > 10 THEN p_brand ELSE 'None' END || '|'), 1, 16) AS strategy FROM part""",
}
ROWS_ONLY = ()

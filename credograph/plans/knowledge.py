"""Queries on coarse graphs, citations, review risks and grounds, each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from credograph.operators import citations, coarsen, graph, synthesis
from credograph.plans.checks import _name
from credograph.plans.shared import EDGES
from credograph.sources import tables as T


def _exports(spark, sf_dir):
    nation, region = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "region")
    return nation.filter("n_nationkey % 2 = 0").select(_name("n", "n_nationkey").alias("node")).unionByName(region.select(_name("r", "r_regionkey").alias("node")))


def coarse_edges(spark, sf_dir):
    return coarsen.coarse(T.strategy_edges(spark, sf_dir), _exports(spark, sf_dir))


def _rings(spark, sf_dir):
    """A ring of one to five claims for each supplier, which alone supports an export of the
    supplier's nation; and that export."""
    s = T.table(spark, sf_dir, "supplier")
    long = F.col("s_suppkey") % 5 + 1
    at = lambda j: F.concat(_name("q", F.col("s_suppkey")), F.lit("_"), j.cast("string"))
    own = s.select("s_suppkey", "s_nationkey", long.alias("long"), F.explode(F.sequence(F.lit(0), long - 1)).alias("j"))
    ring = own.select(at(F.col("j")).alias("child"), at((F.col("j") + 1) % F.col("long")).alias("parent"))
    out = s.select(at(F.lit(0)).alias("child"), _name("x", "s_suppkey").alias("parent")).unionByName(s.select(_name("x", "s_suppkey").alias("child"), _name("n", "s_nationkey").alias("parent")))
    return ring.unionByName(out), s.select(_name("x", "s_suppkey").alias("node"))


def coarse_edges_rings(spark, sf_dir):
    rings, exports = _rings(spark, sf_dir)
    return coarsen.coarse(T.strategy_edges(spark, sf_dir).unionByName(rings), _exports(spark, sf_dir).unionByName(exports))


def strong_components(spark, sf_dir):
    return graph.strong_components(T.strategy_edges(spark, sf_dir).unionByName(_rings(spark, sf_dir)[0]))


#: Inner claims between a supplier's and its customer's.
INNER = 40


def coarse_weights(spark, sf_dir):
    """Each supplier's claim supports its customer's through a chain of inner claims, every third
    with a prior, and a second premise joins half way."""
    s = T.table(spark, sf_dir, "supplier")
    key, share = F.col("s_suppkey"), F.round((F.col("s_acctbal") + 1000) / 11000 * 0.4 + 0.55, 6)
    name = lambda kind, i=None: F.concat(_name(kind, key), F.lit("_"), i.cast("string")) if i is not None else _name(kind, key)
    i = F.col("i").cast("int")
    steps = s.select("s_suppkey", share.alias("share"), F.explode(F.sequence(F.lit(0), F.lit(INNER))).alias("i"))
    none = F.lit(None).cast("array<double>")
    before, after = F.when(i == 0, name("a")).otherwise(name("m", i)), F.when(i == INNER, name("t")).otherwise(name("m", i + 1))
    links = steps.filter(i != INNER // 2).select(name("f", i).alias("factor"), F.lit("soft_entailment").alias("kind"), F.array(before).alias("inputs"), after.alias("conclusion"), F.col("share").alias("p1"), F.lit(0.8).alias("p2"), none.alias("weights"))
    cells = F.array(F.lit(0.1), F.col("share") / 2, F.lit(0.4), F.col("share"))
    middle = steps.filter(i == INNER // 2).select(name("f", i).alias("factor"), F.lit("conditional").alias("kind"), F.array(before, name("b")).alias("inputs"), after.alias("conclusion"), F.lit(None).cast("double").alias("p1"), F.lit(None).cast("double").alias("p2"), cells.alias("weights"))
    prior = F.when(i % 3 == 0, 0.3)
    variables = steps.filter(i < INNER).select(name("m", i + 1).alias("variable"), prior.cast("double").alias("prior"), F.lit(None).cast("int").alias("hard"))
    ends = s.select(F.explode(F.array(name("a"), name("b"), name("t"))).alias("variable"), F.lit(0.9).alias("prior"), F.lit(None).cast("int").alias("hard"))
    edges = s.select(F.explode(F.array(name("a"), name("b"))).alias("premise"), name("t").alias("conclusion"))
    found = coarsen.coarse_tables(variables.unionByName(ends), links.unionByName(middle), edges)
    return found.select("conclusion", F.array_join("premises", ",").alias("premises"), *[F.round(F.col("weights")[k], 6).alias(f"w{k}") for k in range(4)])


def nearest_exports(spark, sf_dir):
    edges = T.strategy_edges(spark, sf_dir)
    return coarsen.nearest_exports(edges, _exports(spark, sf_dir), _exports(spark, sf_dir).unionByName(T.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(_name("s", "s_suppkey").alias("node"))))


def contracted_weights(spark, sf_dir):
    """Each supplier's claim supports its customer's through an inner claim."""
    s = T.table(spark, sf_dir, "supplier")
    key, share = F.col("s_suppkey"), F.round((F.col("s_acctbal") + 1000) / 11000 * 0.9 + 0.05, 6)
    a, m, t = _name("a", key), _name("m", key), _name("t", key)
    variables = s.select(F.explode(F.array(a, m, t)).alias("variable"), F.lit(None).cast("double").alias("prior"), F.lit(None).cast("int").alias("hard"))
    variables = variables.withColumn("prior", F.when(~F.col("variable").startswith("m"), F.lit(0.3)))
    one = lambda name, x, y, p1, p2: F.struct(_name(name, key).alias("factor"), F.lit("soft_entailment").alias("kind"), F.array(x).alias("inputs"), y.alias("conclusion"), p1.alias("p1"), p2.alias("p2"), F.lit(None).cast("array<double>").alias("weights"))
    factors = s.select(F.inline(F.array(one("f", a, m, share, F.lit(0.8)), one("g", m, t, F.lit(0.9), share))))
    targets = s.select(key.alias("target"), F.array(a).alias("premises"), t.alias("conclusion"))
    found = coarsen.contract(variables, factors, targets)
    return found.select("target", F.round(F.col("weights")[0], 6).alias("without"), F.round(F.col("weights")[1], 6).alias("with"))


def _cited(spark, sf_dir):
    k = F.col("doc_id")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" @doc"), (k % 5).cast("string"), F.lit(" [see @smith"), (k % 3).cast("string"), F.lit("; @doc"), (k % 4).cast("string"), F.lit(", p. 3] a@b.c \\@no."))
    return citations.markers(T.table(spark, sf_dir, "documents").select("doc_id", said.alias("text")), "doc_id", "text")


def _keys(spark, sf_dir):
    region = T.table(spark, sf_dir, "region")
    return region.filter("r_regionkey < 3").select(_name("doc", "r_regionkey").alias("key")), region.filter("r_regionkey > 0").select(F.explode(F.array(_name("smith", "r_regionkey"), F.lit("doc1"))).alias("key"))


def citation_markers(spark, sf_dir):
    return citations.resolved(_cited(spark, sf_dir), *_keys(spark, sf_dir))


def citation_mixed_groups(spark, sf_dir):
    return citations.mixed_groups(citation_markers(spark, sf_dir))


def label_collisions(spark, sf_dir):
    return citations.collisions(*_keys(spark, sf_dir))


def review_risks(spark, sf_dir):
    s, c, n = (T.table(spark, sf_dir, x) for x in ("supplier", "customer", "nation"))
    items = s.select(_name("s", "s_suppkey").alias("target_id"), F.array(_name("c", "s_suppkey"), _name("c", F.col("s_suppkey") + 1)).alias("premises"), _name("n", "s_nationkey").alias("conclusion"))
    finding = lambda rows, kind, severity, target: rows.select(F.concat(F.lit(kind + ":"), target).alias("finding"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.array(target).alias("target_ids"))
    findings = finding(c.filter("c_acctbal < 3000"), "prior_hole", "info", _name("c", "c_custkey")).unionByName(finding(s.filter("s_acctbal < 0"), "blocked_warrant_path", "warning", _name("s", "s_suppkey")))
    findings = findings.unionByName(finding(c.filter("c_acctbal > 9500"), "validation_error", "error", _name("c", "c_custkey")))
    deltas = n.select(_name("n", "n_nationkey").alias("claim"), ((F.col("n_nationkey") - 12) / F.lit(50.0)).alias("delta"))
    return synthesis.risks(items, findings, deltas)


def decision_grounds(spark, sf_dir):
    trace = T.conversation_trace(spark, sf_dir).filter("actor != 'user'")
    return synthesis.ungrounded(trace.select("trace_id", "seq", F.when(F.col("seq") % 7 != 3, F.col("reason")).alias("reason"), F.when(F.col("seq") % 5 != 4, F.array(F.lit("The a"), F.col("actor"))).alias("inputs")))


_X = "x AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'r' || r_regionkey FROM region)"
_WALK = "w AS (SELECT id AS source, parent AS node FROM src JOIN e ON child = id UNION SELECT source, parent FROM w JOIN e ON node = child WHERE node NOT IN (SELECT id FROM stops))"
_KEY = r"[A-Za-z0-9_](?:[A-Za-z0-9_:.#$%&+?<>~/\-]*[A-Za-z0-9_])?"
_GROUP = r"\[((?:[^\[\]]*[^\[\]\\])?@[A-Za-z0-9_][^\[\]]*)\]"
_MARKERS = rf"""docs AS (SELECT doc_id, coalesce(text, '') || ' @doc' || doc_id % 5 || ' [see @smith' || doc_id % 3 || '; @doc' || doc_id % 4 || ', p. 3] a@b.c \@no.' AS t FROM documents),
g AS (SELECT doc_id, regexp_extract_all(t, '{_GROUP}', 1) AS bodies, regexp_replace(t, '{_GROUP}', '[]', 'g') AS rest FROM docs),
m AS (SELECT doc_id AS id, i::int AS "group", unnest(regexp_extract_all(bodies[i + 1], '(?:^|[^\\])@({_KEY})', 1)) AS key FROM (SELECT *, unnest(range(len(bodies))) AS i FROM g)
  UNION ALL SELECT doc_id, NULL, unnest(regexp_extract_all(rest, '(?:^|[^\\A-Za-z0-9_])@({_KEY})', 1)) FROM g),
labels AS (SELECT 'doc' || r_regionkey AS key FROM region WHERE r_regionkey < 3), refs AS (SELECT DISTINCT unnest(['smith' || r_regionkey, 'doc1']) AS key FROM region WHERE r_regionkey > 0),
k AS (SELECT *, CASE WHEN key IN (SELECT key FROM refs) THEN 'citation' WHEN key IN (SELECT key FROM labels) THEN 'knowledge' ELSE 'unknown' END AS kind FROM m)"""

_RINGED = f"""r AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 5 + 1 AS l, unnest(range(0, s_suppkey % 5 + 1)) AS j FROM supplier),
ring AS (SELECT 'q' || k || '_' || j AS child, 'q' || k || '_' || (j + 1) % l AS parent FROM r), e AS (SELECT * FROM {EDGES} UNION SELECT * FROM ring
  UNION SELECT 'q' || s_suppkey || '_0', 'x' || s_suppkey FROM supplier UNION SELECT 'x' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
#: Step by step, what each value of the last claim weighs for each value of the two premises.
_CHAIN = f"""WITH RECURSIVE s AS (SELECT s_suppkey AS k, round((s_acctbal + 1000)::double / 11000 * 0.4::double + 0.55::double, 6) AS q FROM supplier),
c(k, q, a, b, i, z0, z1) AS (
  SELECT k, q, a, b, 0, 1.0::double - a, 0.0::double + a FROM s, range(2) t(a), range(2) u(b)
  UNION ALL
  SELECT k, q, a, b, i + 1, y0 / (y0 + y1), y1 / (y0 + y1) FROM (
    SELECT k, q, a, b, i, (z1 * p1 + z0 * p0) * CASE WHEN i < {INNER} AND i % 3 = 0 THEN 0.3::double ELSE 1 END AS y1, (z1 * (1 - p1) + z0 * (1 - p0)) * CASE WHEN i < {INNER} AND i % 3 = 0 THEN 0.7::double ELSE 1 END AS y0
    FROM (SELECT *, CASE WHEN i = {INNER // 2} AND b = 0 THEN q / 2 ELSE q END AS p1, CASE WHEN i != {INNER // 2} THEN 0.2::double WHEN b = 1 THEN 0.4::double ELSE 0.1::double END AS p0 FROM c WHERE i <= {INNER})))
SELECT 't' || k AS conclusion, 'a' || k || ',b' || k AS premises, {", ".join(f"round(max(z1) FILTER (a + 2 * b = {j}), 6) AS w{j}" for j in range(4))} FROM c WHERE i = {INNER + 1} GROUP BY k"""

SQL: dict[str, str] = {
    "coarse_edges_rings": f"""WITH RECURSIVE {_RINGED}, x AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'r' || r_regionkey FROM region UNION SELECT 'x' || s_suppkey FROM supplier), stops AS (SELECT id FROM x),
depth AS (SELECT 'q' || s_suppkey || '_0' AS node, 1 AS d FROM supplier UNION SELECT child, d + 1 FROM depth JOIN ring ON parent = node WHERE d < 6), least AS (SELECT node, min(d) AS d FROM depth GROUP BY node),
reach AS (SELECT child AS a, parent AS b FROM ring UNION SELECT a, parent FROM reach JOIN ring ON child = b), scc AS (SELECT r1.a AS node, min(r1.b) AS c FROM reach r1 JOIN reach r2 ON r1.a = r2.b AND r1.b = r2.a GROUP BY r1.a),
surrogate AS (SELECT arg_min(node, (-d, node)) AS id FROM scc JOIN least USING (node) GROUP BY c),
src AS (SELECT id FROM x UNION SELECT child FROM e WHERE child NOT IN (SELECT parent FROM e) UNION SELECT id FROM surrogate), {_WALK} SELECT DISTINCT source AS premise, node AS conclusion FROM w WHERE node IN (SELECT id FROM x) AND node != source""",
    "strong_components": f"WITH RECURSIVE {_RINGED}, reach AS (SELECT child AS a, parent AS b FROM ring UNION SELECT a, parent FROM reach JOIN ring ON child = b), scc AS (SELECT r1.a AS node, min(r1.b) AS c FROM reach r1 JOIN reach r2 ON r1.a = r2.b AND r1.b = r2.a GROUP BY r1.a) SELECT node, coalesce(c, node) AS component FROM (SELECT child AS node FROM e UNION SELECT parent FROM e) LEFT JOIN scc USING (node)",
    "coarse_weights": _CHAIN,
    "coarse_edges": f"WITH RECURSIVE e AS {EDGES}, {_X}, stops AS (SELECT id FROM x), src AS (SELECT id FROM x UNION SELECT child FROM e WHERE child NOT IN (SELECT parent FROM e)), {_WALK} SELECT DISTINCT source AS premise, node AS conclusion FROM w WHERE node IN (SELECT id FROM x) AND node != source",
    "nearest_exports": f"WITH RECURSIVE e AS (SELECT parent AS child, child AS parent FROM {EDGES}), {_X}, src AS (SELECT id FROM x), stops AS (SELECT id FROM x UNION SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0), {_WALK} SELECT DISTINCT source, node AS export FROM w WHERE node IN (SELECT id FROM stops) AND node != source",
    "contracted_weights": 'SELECT target, round(0.2::double * 0.9::double + 0.8::double * (1 - q), 6) AS without, round(q * 0.9::double + (1 - q) * (1 - q), 6) AS "with" FROM (SELECT s_suppkey AS target, round((s_acctbal + 1000)::double / 11000 * 0.9::double + 0.05::double, 6) AS q FROM supplier)',
    "citation_markers": f"WITH {_MARKERS} SELECT * FROM k",
    "citation_mixed_groups": f"""WITH {_MARKERS} SELECT id, "group" FROM k WHERE "group" IS NOT NULL GROUP BY ALL HAVING bool_or(kind = 'citation') AND bool_or(kind = 'knowledge')""",
    "label_collisions": "SELECT DISTINCT 'doc' || r_regionkey AS key FROM region WHERE r_regionkey = 1",
    "review_risks": """WITH i AS (SELECT s_suppkey, s_acctbal < 0 AS blocked, (s_nationkey - 12) / 50.0::double AS delta, unnest([s_suppkey, s_suppkey + 1]) AS c FROM supplier),
j AS (SELECT s_suppkey, any_value(delta) AS delta, bool_or(blocked)::int AS b, count_if(c_acctbal < 3000) AS h, count_if(c_acctbal > 9500) AS e FROM i LEFT JOIN customer ON c_custkey = c GROUP BY 1),
k AS (SELECT *, h + b + (abs(delta) > 0.05)::int AS n FROM j)
SELECT 's' || s_suppkey AS target_id, (h + b + e)::bigint AS n_findings, n::bigint AS chain, delta, CASE WHEN e > 0 OR abs(delta) > 0.2 OR n >= 3 THEN 'high' WHEN b > 0 OR abs(delta) > 0.1 OR n >= 2 THEN 'medium' ELSE 'low' END AS risk FROM k""",
    "decision_grounds": r"""SELECT trace_id, seq, problem FROM (SELECT conv_id AS trace_id, turn AS seq, CASE WHEN turn % 7 = 3 OR trim(coalesce(text, ''), E' \t\n\r\f\x0b') = '' THEN 'no_reason'
  WHEN turn % 5 != 4 AND NOT list_has_any(string_split_regex(lower(text), '\s+'), ['the', 'a', role]) THEN 'no_shared_word' END AS problem FROM conversations WHERE role != 'user') WHERE problem IS NOT NULL""",
}
ROWS_ONLY = ()

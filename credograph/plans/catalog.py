"""The engine's queries on the tables of a folder, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from credograph.operators import changes, graph, inference, priors, reviews, trace
from credograph.plans import beliefs, checks, compared, formulas, joined, knowledge, logs, modeling
from credograph.plans.shared import EDGES, PRIORS
from credograph.sources import tables as T

PRIORITY = ["1-URGENT", "2-*", "*"]
#: What is said after each text, by its key: the prose itself has none of the phrases.
_SAID = ("Clearly so", "we ADMIT it", "it may be", "nothing", "some  of it is trivial", "self-evident, I am sorry")
RATES = {"low": 20.0, "middle": 25.5, "high": 30.0}

_REVIEWS = "(SELECT l_orderkey AS target_id, l_linenumber AS round, CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'F' THEN 'accepted' ELSE 'unreviewed' END AS status FROM lineitem)"


def _winners(tier: str, where: str = "true") -> str:
    return f"""SELECT knowledge_id, round(value, 6) AS value, source_id, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY knowledge_id ORDER BY tier, created_at DESC, pos) AS k FROM (SELECT *, {tier} AS tier FROM {PRIORS} WHERE {where}) WHERE tier IS NOT NULL) WHERE k = 1"""


def _resolved(spark: SparkSession, sf_dir: str, *how) -> DataFrame:
    return priors.resolve(T.prior_records(spark, sf_dir), *how).withColumn("value", F.round("value", 6))


def prior_resolution_priority(spark, sf_dir):
    return _resolved(spark, sf_dir, "explicit_priority", PRIORITY)


def prior_resolution_latest(spark, sf_dir):
    return _resolved(spark, sf_dir, "latest")


def prior_resolution_source(spark, sf_dir):
    return _resolved(spark, sf_dir, "source", ["3-MEDIUM"])


def prior_resolution_cutoff(spark, sf_dir):
    return _resolved(spark, sf_dir, "latest", [], datetime(1998, 1, 1))


def prior_dissent(spark, sf_dir):
    return priors.dissent(T.prior_records(spark, sf_dir)).withColumn("spread", F.round("spread", 8))


def prior_coverage_gaps(spark, sf_dir):
    return priors.uncovered(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("knowledge_id")), T.prior_records(spark, sf_dir))


def latest_review(spark, sf_dir):
    r = T.reviews(spark, sf_dir)
    return reviews.latest(r.groupBy("target_id", "round").agg(F.min("status").alias("status")))


def review_gate(spark, sf_dir):
    r = T.reviews(spark, sf_dir)
    targets = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"))
    return reviews.gate(targets, r.groupBy("target_id", "round").agg(F.min("status").alias("status")))


def review_status_counts(spark, sf_dir):
    return reviews.status_counts(T.reviews(spark, sf_dir).groupBy("target_id", "round").agg(F.min("status").alias("status")))


def reachability(spark, sf_dir):
    return graph.reachable(T.strategy_edges(spark, sf_dir))


def leaves(spark, sf_dir):
    return graph.leaves(T.strategy_edges(spark, sf_dir))


def topo_layers(spark, sf_dir):
    return graph.layers(T.strategy_edges(spark, sf_dir))


def cycle_check(spark, sf_dir):
    """All strategy edges, and one from a region back to the nation of key 3."""
    n = T.table(spark, sf_dir, "nation")
    back = n.filter("n_nationkey = 3").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("child"), F.lit("n3").alias("parent"))
    return graph.cycles(T.strategy_edges(spark, sf_dir).unionByName(back))


def reaching_exports(spark, sf_dir):
    return graph.reaching(T.strategy_edges(spark, sf_dir), T.table(spark, sf_dir, "region").filter("r_name < 'B'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node")))


def node_degrees(spark, sf_dir):
    return graph.degrees(T.strategy_edges(spark, sf_dir))


def trace_seq_gaps(spark, sf_dir):
    return trace.sequence_gaps(T.conversation_trace(spark, sf_dir).filter("actor != 'system'"))


def trace_ts_disorder(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("value").alias("at"), "event_id", "ts")
    return trace.time_disorder(e, "at", "event_id").select("trace_id", "at", "ts", "before")


def actor_switches(spark, sf_dir):
    return trace.actor_switches(T.conversation_trace(spark, sf_dir))


def hash_chain(spark, sf_dir):
    return trace.hash_chain(T.conversation_trace(spark, sf_dir))


def _with_breaks(spark, sf_dir):
    """The logs with their recorded links, some of them forged."""
    events = T.conversation_trace(spark, sf_dir)
    linked = events.join(trace.hash_chain(events).select("trace_id", "seq", "prev_hash"), ["trace_id", "seq"])
    return linked.withColumn("prev_hash", F.when(F.col("seq") % 5 == 3, "forged").otherwise(F.col("prev_hash")))


def chain_breaks(spark, sf_dir):
    return trace.broken_links(_with_breaks(spark, sf_dir))


def chain_verdicts(spark, sf_dir):
    return trace.verify(_with_breaks(spark, sf_dir))


def events_roots(spark, sf_dir):
    return trace.events_root(T.conversation_trace(spark, sf_dir))


def trace_statistics(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("actor"), "ts")
    return trace.statistics(e, "event_type")


def semantic_diff(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    after = c.withColumn("c_mktsegment", F.when(F.col("c_nationkey") == 3, "OTHER").otherwise(F.col("c_mktsegment"))).filter("c_acctbal > 0")
    return changes.semantic_diff(c.filter("c_acctbal < 5000"), after, "c_custkey", ["c_name", "c_mktsegment"])


def topk_delta(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") - 4500, 2).alias("delta"))
    return changes.largest(s, "delta", "s_suppkey", 20)


def duplicate_content(spark, sf_dir):
    return changes.duplicates(T.table(spark, sf_dir, "documents"), "doc_id", "text")


def redteam_scan(spark, sf_dir):
    return changes.phrase_findings(T.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % len(_SAID) + 1).cast("int"))).alias("text")), "doc_id", "text")


def mutual_information(spark, sf_dir):
    rows = T.table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_acctbal") + 1000) / 11000).alias("prior"), F.lit(0.9).alias("p1"), F.lit(0.7).alias("p2"))
    return rows.select("s_suppkey", F.round(inference.conditional_information(rows, "p1", "p2", "prior"), 6).alias("bits"))


def model_compare(spark, sf_dir):
    found = inference.log_likelihood(T.table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", RATES)
    return found.withColumns({"log_likelihood": F.round("log_likelihood", 4), "posterior": F.round("posterior", 5)})


def _latest_sql() -> str:
    return f"SELECT target_id, arg_max(status, round) AS status, max(round) AS round FROM (SELECT target_id, round, min(status) AS status FROM {_REVIEWS} GROUP BY ALL) GROUP BY target_id"


def _entropy(p: str) -> str:
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0.0 ELSE -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) END)"


def _closure(edges: str) -> str:
    return f"WITH RECURSIVE e AS {edges}, c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT node, parent, depth + 1 FROM c JOIN e ON ancestor = child WHERE depth < 8)"


_RING = f"(SELECT * FROM {EDGES} UNION ALL SELECT 'r' || n_regionkey, 'n3' FROM nation WHERE n_nationkey = 3)"
_LIKELIHOOD = " UNION ALL ".join(f"SELECT *, '{m}' AS model, s * ln({r}::double) - n * {r}::double - f AS l FROM sums" for m, r in RATES.items())
_CHANGED = "CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' ELSE 'changed' END"

def _json(c: str) -> str:
    escaped = f"replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return f"coalesce('\"' || {escaped} || '\"', 'null')"


_EVENTS = f"""(SELECT conv_id AS trace_id, turn AS seq, '{{"actor":' || {_json("role")} || ',"reason":' || {_json("text")} || ',"seq":' || turn || ',"trace_id":' || conv_id || '}}' AS j FROM conversations)"""

SQL: dict[str, str] = {
    "prior_resolution_priority": _winners("CASE WHEN source_id = '1-URGENT' THEN 0 WHEN source_id LIKE '2-%' THEN 1 ELSE 2 END"),
    "prior_resolution_latest": _winners("0"),
    "prior_resolution_source": _winners("0", "source_id = '3-MEDIUM'"),
    "prior_resolution_cutoff": _winners("0", "created_at <= TIMESTAMP '1998-01-01'"),
    "prior_dissent": f"SELECT knowledge_id, count(*) AS n_records, round(max(value) - min(value), 8) AS spread FROM {PRIORS} GROUP BY 1 HAVING count(*) >= 2 AND max(value) - min(value) > 0.2",
    "prior_coverage_gaps": "SELECT p_partkey AS knowledge_id FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)",
    "latest_review": _latest_sql(),
    "review_gate": f"SELECT o_orderkey AS target_id, nullif(o_orderstatus, 'P') AS label FROM orders LEFT JOIN ({_latest_sql()}) ON target_id = o_orderkey WHERE o_orderstatus = 'P' OR status = 'accepted'",
    "review_status_counts": f"SELECT status, count(*) AS n_targets FROM ({_latest_sql()}) GROUP BY 1",
    "reachability": f"{_closure(EDGES)} SELECT node, ancestor, min(depth)::int AS depth FROM c GROUP BY ALL",
    "leaves": f"WITH e AS {EDGES} SELECT DISTINCT child AS node FROM e WHERE child NOT IN (SELECT parent FROM e)",
    "topo_layers": f"{_closure(EDGES)} SELECT node, max(depth)::int AS layer FROM (SELECT node, depth FROM c UNION ALL SELECT parent, 0 FROM e) GROUP BY 1",
    "cycle_check": f"{_closure(_RING)} SELECT DISTINCT node FROM c WHERE node = ancestor",
    "reaching_exports": f"{_closure(EDGES)}, t AS (SELECT 'r' || r_regionkey AS node FROM region WHERE r_name < 'B') SELECT DISTINCT node FROM c WHERE ancestor IN (SELECT node FROM t) UNION SELECT node FROM t",
    "node_degrees": f"WITH e AS {EDGES} SELECT node, sum(p)::bigint AS n_parents, sum(c)::bigint AS n_children FROM (SELECT child AS node, 1 AS p, 0 AS c FROM e UNION ALL SELECT parent, 0, 1 FROM e) GROUP BY 1",
    "trace_seq_gaps": "SELECT * FROM (SELECT conv_id AS trace_id, turn AS seq, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) + 1 AS expected FROM conversations WHERE role != 'system') WHERE seq != expected",
    "trace_ts_disorder": "SELECT * FROM (SELECT user_id AS trace_id, value AS at, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) AS before FROM events) WHERE ts < before",
    "actor_switches": "SELECT * FROM (SELECT conv_id AS trace_id, turn AS seq, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role AS actor FROM conversations) WHERE before != actor",
    "hash_chain": f"SELECT trace_id, seq, event_hash, coalesce(lag(event_hash) OVER (PARTITION BY trace_id ORDER BY seq), '') AS prev_hash FROM (SELECT trace_id, seq, sha256(j) AS event_hash FROM {_EVENTS})",
    "chain_breaks": f"SELECT * FROM (SELECT trace_id, seq, CASE WHEN seq % 5 = 3 THEN 'forged' ELSE e END AS prev_hash, e AS expected FROM (SELECT trace_id, seq, coalesce(lag(sha256(j)) OVER (PARTITION BY trace_id ORDER BY seq), '') AS e FROM {_EVENTS})) WHERE prev_hash != expected",
    "chain_verdicts": f"SELECT trace_id, min(CASE WHEN seq % 5 = 3 THEN seq END) IS NULL AS ok, min(CASE WHEN seq % 5 = 3 THEN seq END) AS first_broken FROM {_EVENTS} GROUP BY trace_id",
    "events_roots": f"SELECT trace_id::varchar AS trace_id, sha256('[' || string_agg(j, ',' ORDER BY seq) || ']') AS root FROM {_EVENTS} GROUP BY trace_id",
    "trace_statistics": "SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_actors, floor(epoch(max(ts)))::bigint - floor(epoch(min(ts)))::bigint AS seconds FROM events GROUP BY 1",
    "semantic_diff": f"""WITH b AS (SELECT * FROM customer WHERE c_acctbal < 5000), a AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal > 0),
j AS (SELECT {_CHANGED} AS category, coalesce(a.c_custkey, b.c_custkey) AS id, b.c_name AS b1, a.c_name AS a1, b.c_mktsegment AS b2, a.c_mktsegment AS a2 FROM b FULL JOIN a ON a.c_custkey = b.c_custkey)
SELECT category, id, NULL::varchar AS field, NULL::varchar AS before, NULL::varchar AS after FROM j WHERE category != 'changed'
UNION ALL SELECT category, id, 'c_name', b1, a1 FROM j WHERE category = 'changed' AND b1 IS DISTINCT FROM a1 UNION ALL SELECT category, id, 'c_mktsegment', b2, a2 FROM j WHERE category = 'changed' AND b2 IS DISTINCT FROM a2""",
    "topk_delta": "SELECT s_suppkey, round(s_acctbal - 4500, 2) AS delta FROM supplier ORDER BY abs(round(s_acctbal - 4500, 2)) DESC, s_suppkey LIMIT 20",
    "duplicate_content": r"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'))) AS c FROM documents)
SELECT doc_id, "first", n AS n_alike FROM t JOIN (SELECT c, min(doc_id) AS "first", count(*) AS n FROM t GROUP BY c HAVING count(*) > 1) USING (c) WHERE doc_id != "first\"""".replace('\\"', '"'),
    "redteam_scan": " UNION ALL ".join(f"SELECT doc_id, '{d}' AS detector, '{p}' AS phrase, '{s}' AS severity FROM documents WHERE contains(lower(' ' || coalesce(text, '') || ' ' || {list(_SAID)}[doc_id % {len(_SAID)} + 1] || ' '), '{p}')" for d, (s, phrases) in changes.PHRASES.items() for p in phrases),
    "mutual_information": f"SELECT s_suppkey, round(greatest({_entropy('c')} - q * {_entropy('0.9::double')} - (1 - q) * {_entropy('0.3::double')}, 0.0), 6) AS bits FROM (SELECT *, q * 0.9::double + (1 - q) * 0.3::double AS c FROM (SELECT s_suppkey, (s_acctbal + 1000) / 11000 AS q FROM supplier))",
    "model_compare": f"""WITH sums AS (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS s, sum(lgamma(l_quantity + 1)) AS f FROM lineitem GROUP BY 1),
l AS ({_LIKELIHOOD}) SELECT l_partkey, n AS n_observations, model, round(l, 4) AS log_likelihood, round(exp(l - max(l) OVER w) / sum(exp(l - m)) OVER w, 5) AS posterior FROM (SELECT *, max(l) OVER (PARTITION BY l_partkey) AS m FROM l) WINDOW w AS (PARTITION BY l_partkey)""",
}


OWN = tuple(SQL)
PARTS = (modeling, beliefs, checks, knowledge, formulas, compared, joined, logs)
for _part in PARTS:
    SQL |= _part.SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in OWN} | {name: getattr(part, name) for part in PARTS for name in (*part.SQL, *part.ROWS_ONLY)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

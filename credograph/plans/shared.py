"""SQL that several query modules use."""

from __future__ import annotations

PRIORS = "(SELECT o_custkey AS knowledge_id, o_orderpriority AS source_id, least(o_totalprice / 1e6, 0.999) AS value, o_orderdate AS created_at, o_orderkey AS pos FROM orders)"
EDGES = """(SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""

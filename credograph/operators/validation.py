"""Structural checks as queries; each gives rows (check_name, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from credograph.functions.potentials import EPSILON


def _found(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), F.col(key).cast("string").alias("id"))


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose ``key`` is no key of ``known``; null keys count as dangling."""
    return rows.join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def check_claims(claims: DataFrame, shape: str) -> DataFrame:
    """``claims`` (id, label): ids of another shape, ids and labels used more than once."""
    twice = lambda c: claims.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1")
    bad = claims.filter(~F.coalesce(F.col("id").rlike(shape), F.lit(False)))
    return _found(bad, "id_shape", "id").unionByName(_found(twice("id"), "id_repeated", "id")).unionByName(_found(twice("label"), "label_repeated", "label"))


def check_strategies(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """``edges`` (child, parent): premises and conclusions that are no claims, and self-loops."""
    parts = [_found(dangling(edges, "child", claims, "id"), "premise_unknown", "child"), _found(dangling(edges, "parent", claims, "id"), "conclusion_unknown", "parent"), _found(edges.filter("child = parent"), "self_loop", "child")]
    return reduce(DataFrame.unionByName, parts).distinct()


def check_priors(records: DataFrame, claims: DataFrame, helpers: DataFrame) -> DataFrame:
    """``records`` (knowledge_id, value): unknown claims, helper claims, values out of bounds."""
    outside = records.filter(~F.coalesce(F.col("value").between(EPSILON, 1 - EPSILON), F.lit(False)))
    on_helper = records.join(helpers.select(F.col("id").alias("knowledge_id")), "knowledge_id", "left_semi")
    parts = [_found(dangling(records, "knowledge_id", claims, "id"), "prior_dangling", "knowledge_id"), _found(on_helper, "prior_on_helper", "knowledge_id"), _found(outside, "prior_out_of_bounds", "knowledge_id")]
    return reduce(DataFrame.unionByName, parts).groupBy("check_name", "id").agg(F.count("*").alias("n_records"))


def check_operators(operators: DataFrame, knowledges: DataFrame) -> DataFrame:
    """``operators`` (operator_id, variables, conclusion): ids of another shape, unknown references,
    references to what is no claim, a conclusion among its variables, and priors on helpers.
    ``knowledges``: id, type, helper, prior."""
    ends = operators.select("operator_id", F.explode(F.concat("variables", F.array("conclusion"))).alias("id"))
    known = ends.join(knowledges.select("id", "type"), "id", "left")
    helped = operators.join(knowledges.filter("helper and prior is not null").select(F.col("id").alias("conclusion")), "conclusion", "left_semi")
    parts = [
        _found(operators.filter(~F.coalesce(F.col("operator_id").startswith("lco_"), F.lit(False))), "operator_id_shape", "operator_id"), _found(known.filter("type is null"), "operator_reference_unknown", "operator_id"),
        _found(known.filter("type != 'claim'"), "operator_reference_no_claim", "operator_id"), _found(operators.filter(F.array_contains("variables", F.col("conclusion"))), "operator_conclusion_in_variables", "operator_id"),
        _found(helped, "helper_with_prior", "conclusion"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def check_parts(strategies: DataFrame) -> DataFrame:
    """``strategies`` (strategy_id, sub_strategies, background): repeated ids, composites with
    unknown parts, and composites on a ring of parts."""
    from credograph.operators.graph import cycles

    parts = strategies.select("strategy_id", F.explode("sub_strategies").alias("part"))
    unknown = parts.join(strategies.select(F.col("strategy_id").alias("part")), "part", "left_anti")
    twice = strategies.groupBy("strategy_id").count().filter("count > 1")
    ring = cycles(parts.select(F.col("strategy_id").alias("child"), F.col("part").alias("parent"))).withColumnRenamed("node", "strategy_id")
    found = [_found(twice, "strategy_id_repeated", "strategy_id"), _found(unknown, "part_unknown", "strategy_id"), _found(ring, "composite_cycle", "strategy_id")]
    return reduce(DataFrame.unionByName, found).distinct()


def check_background(strategies: DataFrame, knowledges: DataFrame) -> DataFrame:
    """Background references that are no knowledge of the graph."""
    refs = strategies.select("strategy_id", F.explode("background").alias("id"))
    return _found(refs.join(knowledges.select("id"), "id", "left_anti"), "background_unknown", "strategy_id").distinct()


def check_private(strategies: DataFrame, operators: DataFrame) -> DataFrame:
    """Conclusions inside a strategy that are none of its premises or its conclusion are its own:
    other strategies and operators must not refer to them. (check_name, id of the private claim)"""
    inner = strategies.filter("formal is not null").select("strategy_id", "premises", "conclusion", F.explode("formal.conclusion").alias("id"))
    own = inner.filter(~F.array_contains("premises", F.col("id")) & ~F.col("id").eqNullSafe(F.col("conclusion"))).select("strategy_id", "id").distinct()
    used = strategies.select(F.col("strategy_id").alias("by"), F.explode(F.concat("premises", F.array("conclusion"))).alias("id"))
    by_operator = operators.select(F.lit(None).cast("string").alias("by"), F.explode(F.concat("variables", F.array("conclusion"))).alias("id"))
    crossed = own.join(used.unionByName(by_operator), "id").filter(~F.col("by").eqNullSafe(F.col("strategy_id")))
    return _found(crossed, "private_reference", "id").distinct()


def check_closure(strategies: DataFrame) -> DataFrame:
    """Embedded operators may only speak of the strategy's premises, its conclusion, and each
    other's conclusions; and these must not be made in a ring. (check_name, strategy id)"""
    from credograph.operators.graph import cycles

    whole = strategies.filter("formal is not null")
    allowed = F.concat("premises", F.array("conclusion"), F.col("formal.conclusion"))
    each = whole.select("strategy_id", allowed.alias("allowed"), F.explode("formal").alias("f")).select("strategy_id", "allowed", F.explode("f.variables").alias("v"), F.col("f.conclusion").alias("c"))
    open_ended = each.filter(~F.array_contains("allowed", F.col("v")))
    tagged = each.select(F.concat_ws("\u001f", "strategy_id", "v").alias("child"), F.concat_ws("\u001f", "strategy_id", "c").alias("parent"))
    ring = cycles(tagged).select(F.split("node", "\u001f")[0].alias("strategy_id"))
    return _found(open_ended, "formal_reference_unknown", "strategy_id").unionByName(_found(ring, "formal_cycle", "strategy_id")).distinct()

"""Reasoning graphs reduced to their exported claims: who supports which, the rest folded away.

Edges run from child (premise) to parent (conclusion). Edges with a null end are ignored; repeated
edges count once; cycles end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from credograph.operators import factor_graph, graph, junction_tree
from credograph.sources.folders import apart, cut, small_batches


def exports_reached(edges: DataFrame, sources: DataFrame, exports: DataFrame) -> DataFrame:
    """source, export: the exports (node) that each source (node) reaches without passing another.
    A source doesn't reach itself."""
    edges = cut(edges.filter("child is not null and parent is not null").select("child", "parent").distinct())
    marked = edges.join(exports.select(F.col("node").alias("parent"), F.lit(True).alias("stop")).distinct(), "parent", "left").select("child", "parent", F.coalesce("stop", F.lit(False)).alias("stop"))
    step = lambda front: front.join(marked, front.node == marked.child).select("source", F.col("parent").alias("node"), "stop").distinct()
    front = found = cut(step(sources.select(F.col("node").alias("source"), "node").distinct()))
    while not front.isEmpty():
        front = cut(step(front.filter(~F.col("stop")).select("source", "node")).join(found, ["source", "node"], "left_anti"))
        found = cut(found.unionByName(front))
    return found.filter("stop and source != node").select("source", F.col("node").alias("export"))


def coarse(edges: DataFrame, exports: DataFrame, helpers: DataFrame | None = None, premises: DataFrame | None = None) -> DataFrame:
    """premise, conclusion of the coarse graph: from leaves and exports to the next exports.

    An export that none of them reaches, nor itself, hangs on cycles only; it gets surrogate leaves. ``helpers``
    (node) are no leaves; ``premises`` (node) are leaves though something concludes them."""
    edges = cut(edges.filter("child is not null and parent is not null").select("child", "parent").distinct())
    leaves = graph.leaves(edges) if helpers is None else graph.leaves(edges).join(helpers, "node", "left_anti")
    starts = leaves.unionByName(exports.select("node")) if premises is None else leaves.unionByName(exports.select("node")).unionByName(premises.select("node"))
    found = exports_reached(edges, starts, exports)
    unreached = cut(exports.select("node").distinct().join(found.select(F.col("export").alias("node")), "node", "left_anti"))
    if not unreached.isEmpty():
        # their cycles and beginnings lie among what reaches them
        before = cut(graph.reaching(edges, unreached))
        within = cut(edges.join(before.withColumnRenamed("node", "child"), "child", "left_semi").join(before.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent"))
        # an export on a cycle of its own supports itself, which is no edge but is support
        orphans = cut(unreached.join(graph.cycles(within), "node", "left_anti"))
        if not orphans.isEmpty():
            found = found.unionByName(exports_reached(edges, surrogates(within, orphans, helpers), exports)).distinct()
    return found.select(F.col("source").alias("premise"), F.col("export").alias("conclusion"))


def surrogates(edges: DataFrame, orphans: DataFrame, helpers: DataFrame | None = None) -> DataFrame:
    """node: leaves in place of cycles. Of the claims that reach an orphan (node), strong components
    that no other one feeds are the beginning; the claim of each that lies farthest from the orphans (ties:
    the least name) stands for it. Helpers (node) are passed through, not taken; a claim that has
    helpers only before it is a beginning."""
    depth = graph.distances(edges, orphans).join(orphans, "node", "left_anti")
    claims = cut(depth if helpers is None else depth.join(helpers, "node", "left_anti"))
    inside = claims.select("node")
    between = cut(edges.join(inside.withColumnRenamed("node", "child"), "child", "left_semi").join(inside.withColumnRenamed("node", "parent"), "parent", "left_semi"))
    own = cut(claims.join(graph.strong_components(between), "node", "left").select("node", "depth", F.coalesce("component", "node").alias("component")))
    fed = graph.condensed(between, own).select(F.col("parent").alias("component")).distinct()
    rank = F.struct((-F.col("depth")).alias("d"), "node")
    return own.join(fed, "component", "left_anti").groupBy("component").agg(F.min_by("node", rank).alias("node")).select("node")


def nearest_exports(edges: DataFrame, starts: DataFrame, exports: DataFrame) -> DataFrame:
    """source, export: the first exports found going back from each start to its premises."""
    return exports_reached(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), starts, exports)


#: Neighbours of a variable that is summed out once for all targets.
_SHARED = 8


def contract(variables: DataFrame, factors: DataFrame, targets: DataFrame, most: int = junction_tree.WIDEST) -> DataFrame:
    """target, weights: for each target (target, premises, conclusion) the chance of its conclusion
    under each assignment of its premises (bit i: premises[i]). All else is summed out with its
    priors; a target's own premises and conclusion take part without theirs. A premise that isn't
    connected to the conclusion changes nothing; a conclusion without factors has chance 0.5.

    Sums are made by elimination: first, once for all targets, over variables that are no target's
    premise or conclusion; what is left is copied to each target and reduced to its own. A connected
    part of few numbers is done in one pass of a task, whatever its depth; others by rounds. Tables are
    logarithms and sums are scaled by their largest term, so depth doesn't wear them out. A target's
    table has 2^n numbers; more than ``MOST_WIDE`` premises raise an error."""
    most_wide = factor_graph.MOST_WIDE
    wrong = lambda why: F.raise_error(F.lit(why)).cast("array<string>")
    premises = F.when(F.array_contains("premises", F.col("conclusion")), wrong("a conclusion is its own premise")).when(F.size("premises") >= most_wide, wrong("too many premises")).otherwise(F.col("premises"))
    each = targets.select("target", premises.alias("premises"), "conclusion")
    each = cut(each.select("target", "premises", "conclusion", F.md5(F.col("target").cast("string")).alias("net")))
    named = each.select("net", F.explode(F.concat("premises", F.array("conclusion"))).alias("variable")).distinct()
    ends = cut(named.select("variable").distinct())
    free = variables.join(ends.withColumn("free", F.lit(True)), "variable", "left").select("variable", F.when(F.col("free").isNull(), F.col("prior")).alias("prior"), F.when(F.col("free").isNull(), F.col("hard")).alias("hard"))
    # connected parts first: small ones are then summed out in one pass of a task, without rounds
    whole = cut(junction_tree.log_tables(free, factors).withColumn("parent", F.col("vars")[0]))
    links = whole.select("parent", F.explode("vars").alias("child")).filter("child != parent").distinct()
    alone = whole.select(F.explode("vars").alias("node")).distinct()
    parts = cut(apart(alone).join(graph.components(links), "node", "left").select(F.col("node").alias("variable"), F.coalesce("component", "node").alias("part")))
    own = parts.withColumnRenamed("variable", "parent")
    passed = junction_tree.within(apart(whole).join(own, "parent").select("part", "vars", "logs"), apart(parts).join(ends, "variable").select("part", "variable"), min(most, _SHARED))
    left = junction_tree.reduced(passed.filter(F.size("vars") > 0).select("vars", "logs"), ends, min(most, _SHARED), strict=False)
    # a target needs the tables of its conclusion's connected part
    tables = cut(apart(left.withColumn("parent", F.col("vars")[0])).join(own, "parent").select("part", "vars", "logs"))
    asked = cut(apart(each.select("net", F.col("conclusion").alias("variable"))).join(parts, "variable").select("net", "part"))
    inner = apart(tables).join(asked, "part").select("net", "vars", "logs")
    # the priors of what is another target's end, but not one's own
    others = apart(factor_graph.unary(variables)).join(ends, "variable", "left_semi").join(apart(parts), "variable").join(apart(asked), "part").join(apart(named), ["net", "variable"], "left_anti")
    inner = inner.unionByName(others.select("net", F.array("variable").alias("vars"), F.array(F.lit(0.0), F.col("base")).alias("logs")))
    within = lambda v: F.concat("net", F.lit(":"), v)
    kept = cut(named.select(F.col("net").alias("part"), within(F.col("variable")).alias("variable")))
    own = junction_tree.within(inner.select(F.col("net").alias("part"), F.transform("vars", within).alias("vars"), "logs"), kept, most)
    done = junction_tree.reduced(own.filter(F.size("vars") > 0).select("vars", "logs"), kept.select("variable"), most)
    plain = done.select(F.substring(F.col("vars")[0], 1, 32).alias("net"), F.transform("vars", lambda v: F.substring(v, F.lit(34), F.length(v))).alias("vars"), "logs")
    held = apart(each).join(plain.groupBy("net").agg(F.collect_list(F.struct("vars", "logs")).alias("f")), "net", "left")
    kind = targets.schema["target"].dataType.simpleString()
    return small_batches(held).select("target", "premises", "conclusion", "f").mapInPandas(_chances, f"target {kind}, weights array<double>")


def _chances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for frame in frames:
            for target, premises, conclusion, factors in zip(*(frame[c] for c in ("target", "premises", "conclusion", "f"))):
                scope = [*dict.fromkeys(premises), conclusion]
                table = junction_tree.product(scope, factors if factors is not None else ())
                odds = (table[..., 1] - table[..., 0]).reshape(-1, order="F")
                cells = np.arange(1 << len(premises))
                # a premise named twice has one value; cells that say otherwise take the first's
                at = np.zeros(len(cells), np.int64)
                for i, p in enumerate(premises):
                    if premises[i] not in list(premises[:i]):
                        at |= ((cells >> i) & 1) << scope.index(p)
                yield target, (1 / (1 + np.exp(-np.clip(odds[at], -700, 700)))).tolist()

    return junction_tree.chunks(rows(), ["target", "weights"], 1)


def coarse_tables(variables: DataFrame, factors: DataFrame, edges: DataFrame) -> DataFrame:
    """conclusion, premises (in order of name), weights: the tables of a coarse graph (premise,
    conclusion, see ``coarse``)."""
    targets = edges.filter("premise != conclusion").groupBy("conclusion").agg(F.sort_array(F.collect_set("premise")).alias("premises")).withColumn("target", F.col("conclusion"))
    return targets.join(contract(variables, factors, targets), "target").select("conclusion", "premises", "weights")

"""Graph operators on (child, parent) edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from credograph.sources.folders import apart, cut


def reachable(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, ancestor, depth (shortest) of all that nodes reach over their parents."""
    edges = edges.select("child", "parent").distinct()
    front = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    if start is not None:
        front = front.join(start, "node", "left_semi")
    found = front
    depth = 1
    while True:
        depth += 1
        step = front.join(edges, front.ancestor == edges.child).select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        front = cut(step.join(found, ["node", "ancestor"], "left_anti"))
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front))


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes that are no other node's parent."""
    return edges.select(F.col("child").alias("node")).distinct().join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


def peeled(edges: DataFrame) -> DataFrame:
    """The edges that stay when nodes without parents or without children are taken away again and
    again: those on cycles and on ways between cycles. Empty if there is no cycle."""
    left = cut(edges.select("child", "parent").distinct())
    n = left.count()
    while n:
        ends = left.select(F.col("parent").alias("node")).intersect(left.select(F.col("child").alias("node")))
        left = cut(left.join(ends.withColumnRenamed("node", "child"), "child", "left_semi").join(ends.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent"))
        before, n = n, left.count()
        if n == before:
            break
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): nodes that reach one another. Edges with a null end are
    ignored.

    Of what peeling leaves, every node takes the smallest node that reaches it as its colour. A node
    of its own colour is a root; what reaches it within the colour is its component. Then components
    and edges between colours go, and the rest is coloured again. A pass over a colour takes as many
    rounds as its longest shortest way; only nodes and edges are kept, never pairs that reach one
    another."""
    edges = edges.filter("child is not null and parent is not null").select("child", "parent").distinct()
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    left, found = peeled(edges.filter("child != parent")), []
    while not left.isEmpty():
        colours = cut(left.select(F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("colour", F.col("node")))
        for k in count():
            near = left.join(colours.withColumnRenamed("node", "child"), "child").groupBy(F.col("parent").alias("node")).agg(F.min("colour").alias("near"))
            new = cut(colours.join(near, "node", "left").select("node", F.least("colour", "near").alias("colour"), (F.col("near") < F.col("colour")).alias("moved")), k)
            colours = new.select("node", "colour")
            if new.filter("moved").isEmpty():
                break
        ends = lambda side: colours.select(F.col("node").alias(side), F.col("colour").alias(f"c_{side}"))
        inner = cut(left.join(ends("child"), "child").join(ends("parent"), "parent").filter("c_child = c_parent").select("child", "parent", F.col("c_child").alias("colour")))
        own = front = cut(colours.filter("node = colour"))
        while not front.isEmpty():
            step = inner.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node"), "colour").distinct()
            front = cut(step.join(own, "node", "left_anti"))
            own = cut(own.unionByName(front))
        found.append(own)
        gone = own.select("node")
        left = peeled(inner.join(gone.withColumnRenamed("node", "child"), "child", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti"))
    out = nodes
    for own in found:
        out = own.select("node", F.col("colour").alias("component")).unionByName(out.join(own, "node", "left_anti"), allowMissingColumns=True)
    return out.select("node", F.coalesce("component", "node").alias("component")) if found else nodes.select("node", F.col("node").alias("component"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """child, parent: edges between different strong components, by their names."""
    name = lambda side: components.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    joined = edges.select("child", "parent").join(name("child"), "child").join(name("parent"), "parent")
    return joined.filter("c_child != c_parent").select(F.col("c_child").alias("child"), F.col("c_parent").alias("parent")).distinct()


def distances(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """node, depth: the least number of edges from each node to a target (node), over parents."""
    edges = cut(edges.select("child", "parent").distinct())
    front = found = cut(targets.select("node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = edges.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = cut(step.join(found, "node", "left_anti"))
        found = cut(found.unionByName(front))
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those of a strong component with others, and those with an edge
    to themselves."""
    own = strong_components(edges)
    alike = own.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return own.join(alike, "component", "left_semi").select("node").union(edges.filter("child = parent").select("child")).distinct()


def layers(edges: DataFrame) -> DataFrame:
    """node and its layer: roots are 0, all others one more than their deepest parent. A graph with
    a cycle raises an error."""
    edges = cut(edges.select("child", "parent").distinct())
    if not peeled(edges).isEmpty():
        raise ValueError("the graph has a cycle")
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    out = nodes.select("node", F.lit(0).alias("layer"))
    for k in count():
        deeper = edges.join(out, edges.parent == out.node).groupBy("child").agg((F.max("layer") + 1).alias("next"))
        new = cut(out.join(deeper, out.node == deeper.child, "left").select("node", F.coalesce("next", F.lit(0)).alias("layer"), (F.coalesce("next", F.lit(0)) != F.col("layer")).alias("moved")), k)
        out = new.select("node", "layer")
        if new.filter("moved").isEmpty():
            return out


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes from which a target (node) is reached over parents, targets included. Only nodes are
    kept, whatever the number of ways."""
    edges = cut(edges.select("child", "parent").distinct())
    found = front = cut(targets.select("node").distinct())
    while not front.isEmpty():
        step = edges.join(front.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        front = cut(step.join(found, "node", "left_anti"))
        found = cut(found.unionByName(front))
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """node, number of parents and of children."""
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(edges.select(F.col("parent").alias("node"), F.lit(0).alias("p"), F.lit(1).alias("c")))
    return ends.groupBy("node").agg(F.sum("p").alias("n_parents"), F.sum("c").alias("n_children"))


#: Rows of factors that a task takes.
_ROWS = 250_000


def moral_edges(factors: DataFrame, most: int = 26) -> DataFrame:
    """a, b (a < b): variables that share a factor. ``factors`` has factor and variable; a factor
    of more than ``most`` variables, which no table could hold, raises an error."""
    # as many tasks as the input needs, so that none holds more when there is more
    n = max(int(factors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-factors.count() // _ROWS))
    once = factors.select("factor", "variable").repartition(n, "factor").distinct()
    wide = once.groupBy("factor").agg(F.count("*").alias("n"))
    # counted first, so that no wide factor is ever gathered
    fit = wide.select(F.when(F.col("n") <= most, F.col("factor")).otherwise(F.raise_error(F.lit("factor too wide")).cast(wide.schema["factor"].dataType)).alias("factor"))
    checked = apart(once).join(fit, "factor").groupBy("factor").agg(F.sort_array(F.collect_list("variable")).alias("v"))
    pairs = checked.select("v", F.posexplode("v").alias("i", "a")).select("a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    return pairs.repartition(n, "a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node). Each round takes the smallest label around a node,
    then that label's own label, which halves the way."""
    both = edges.select(F.col("child").alias("node"), F.col("parent").alias("other")).unionByName(edges.select(F.col("parent").alias("node"), F.col("child").alias("other"))).distinct()
    labels = both.select("node", F.col("node").alias("label")).distinct()
    for k in count():
        near = apart(both).join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = cut(apart(labels).join(near, "node").select("node", "label", F.least("label", "near").alias("low")))
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = cut(apart(step).join(jump, "low").select("node", "label", F.least("low", "lower").alias("next")), k)
        labels = new.select("node", F.col("next").alias("label"))
        if new.filter("label != next").isEmpty():
            return labels.withColumnRenamed("label", "component")

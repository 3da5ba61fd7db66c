"""Connected components of a table of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from credograph.llm.shared import Scratch, stored


def components(links: DataFrame, path: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node in ``links`` (bigint columns); the label is the smallest node
    of the component. Each round links the larger neighbours of a node, then the smaller ones,
    to its smallest neighbour; rounds are written to the shared folder and end when the links
    no longer change. Rows of one node are never gathered: minima are pre-aggregated, and the
    joins that hand them out are ordinary ones, which Spark splits where they are skewed. The answer
    is written to ``path``; the rounds' tables are removed."""
    work = Scratch(links.sparkSession, "components")
    edges = work.write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = work.write(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = work.write(small.filter("u != v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    inner = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    answer = stored(inner.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), path)
    work.close()
    return answer

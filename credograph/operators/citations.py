"""Citations in texts: ``@key`` on its own, or several in brackets. A null text has none; a backslash
before ``@`` or ``[`` takes its meaning away, and an address such as ``a@b`` is no citation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: The shape of a key, of a group in brackets, of a key on its own.
KEY = r"(?:[A-Za-z0-9_][A-Za-z0-9_:.#$%&+?<>~/\-]*[A-Za-z0-9_]|[A-Za-z0-9_])"
GROUP = r"(?<!\\)\[([^\[\]]*(?<!\\)@[A-Za-z0-9_][^\[\]]*)\]"
BARE = rf"(?<!\\)(?<![A-Za-z0-9_])@({KEY})"


def markers(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, group (number of its brackets in the text, from 0; null on its own), key: a row for each citation."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = F.regexp_extract_all(text, F.lit(GROUP), F.lit(1))
    inner = F.flatten(F.transform(groups, lambda g, i: F.transform(F.regexp_extract_all(g, F.lit(rf"(?<!\\)@({KEY})"), F.lit(1)), lambda k: F.struct(i.alias("group"), k.alias("key")))))
    outer = F.transform(F.regexp_extract_all(F.regexp_replace(text, GROUP, "[]"), F.lit(BARE), F.lit(1)), lambda k: F.struct(F.lit(None).cast("int").alias("group"), k.alias("key")))
    return texts.filter(F.contains(text, F.lit("@"))).select(F.col(id_col).alias("id"), F.inline(F.concat(inner, outer)))


def resolved(found: DataFrame, labels: DataFrame, references: DataFrame) -> DataFrame:
    """``found`` with kind: citation (key of ``references``), else knowledge (key of ``labels``), else unknown."""
    cited = references.select("key").distinct().withColumn("cited", F.lit(True))
    known = labels.select("key").distinct().withColumn("known", F.lit(True))
    kind = F.when(F.col("cited"), "citation").when(F.col("known"), "knowledge").otherwise("unknown")
    return found.join(cited, "key", "left").join(known, "key", "left").select(*found.columns, kind.alias("kind"))


def mixed_groups(resolved_markers: DataFrame) -> DataFrame:
    """id, group of brackets that hold both knowledge and citations."""
    count = lambda k: F.max(F.when(F.col("kind") == k, 1).otherwise(0))
    return resolved_markers.filter("group is not null").groupBy("id", "group").agg(count("citation").alias("c"), count("knowledge").alias("k")).filter("c = 1 and k = 1").select("id", "group")


def collisions(labels: DataFrame, references: DataFrame) -> DataFrame:
    """Keys that are both a label and a reference."""
    return labels.select("key").intersect(references.select("key"))

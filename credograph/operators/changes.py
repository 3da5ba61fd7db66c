"""Differences between snapshots, and the largest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def semantic_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """category (added, removed, changed), id, field, before and after as text. One join by key
    serves all fields."""
    side = lambda df, s: df.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(s))
    both = side(before, "b").join(side(after, "a"), key, "full_outer")
    whole = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("before"), F.col(f"a.{f}").alias("after")) for f in fields])
    changed = F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))
    category = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    rows = both.select(category.alias("category"), F.col(key).alias("id"), F.when(F.col("b").isNull() | F.col("a").isNull(), F.array(whole)).otherwise(changed).alias("x"))
    return rows.select("category", "id", F.inline("x"))


def largest(deltas: DataFrame, delta: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of the largest change, either way; ties by key."""
    return deltas.orderBy(F.abs(delta).desc(), key).limit(k)


def duplicates(claims: DataFrame, key: str, content: str) -> DataFrame:
    """Claims whose text (blanks collapsed, lower case) another claim has, with the first of them."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"[ \t\n\r]+", " ")))
    own = claims.select(F.col(key), F.sha2(text, 256).alias("h"))
    groups = own.groupBy("h").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return own.join(groups, "h").filter(F.col(key) != F.col("first")).select(key, "first", F.col("n").alias("n_alike"))


#: Phrases by detector, with its severity.
PHRASES = {
    "redteam_shortcut": ("error", ("sorry", "admit", "axiom", "assume without proof")),
    "redteam_weak_provenance": ("warning", ("obvious", "clearly", "trivial", "self-evident")),
    "redteam_target_weakening": ("warning", ("there exists", "at least one", "some ", " may ", " could ")),
}


def phrase_findings(claims: DataFrame, key: str, content: str, phrases: dict[str, tuple[str, tuple[str, ...]]] = PHRASES) -> DataFrame:
    """A row for each claim and phrase in its text: detector, phrase, severity."""
    text = F.lower(F.concat(F.lit(" "), F.coalesce(content, F.lit("")), F.lit(" ")))
    found = lambda d, p, s: F.struct(F.lit(d).alias("detector"), F.lit(p).alias("phrase"), F.lit(s).alias("severity"))
    own = [F.when(F.contains(text, F.lit(p)), found(d, p, s)) for d, (s, each) in phrases.items() for p in each]
    return claims.select(key, F.inline(F.array_compact(F.array(*own))))

"""Qualified names and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the shape of a qualified name.
QUALIFIED = r"^[a-z][a-z0-9_]*:[a-z0-9][a-z0-9_\-]*::[A-Za-z_][A-Za-z0-9_]*$"


def qualified(namespace: Column, package: Column, label: Column) -> Column:
    return F.concat(namespace, F.lit(":"), package, F.lit("::"), label)


def is_qualified(name: Column) -> Column:
    return F.coalesce(name.rlike(QUALIFIED), F.lit(False))


def parts(name: Column) -> Column:
    """namespace, package and label of a qualified name; null for another."""
    whole = lambda i: F.regexp_extract(name, r"^([^:]+):([^:]+)::(.+)$", i)
    return F.when(is_qualified(name), F.struct(whole(1).alias("namespace"), whole(2).alias("package"), whole(3).alias("label")))


def quoted(text: Column) -> Column:
    """A string as the hashed payloads spell it: in single quotes, or in double ones if it holds
    single ones only; backslashes, the quote itself, tabs and line ends escaped. (Other
    characters that can't be printed, which that spelling escapes too, are left as they are.)"""
    out = text
    for c, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(escaped))
    single, double = text.contains("'"), text.contains('"')
    return F.when(single & ~double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def listed(items: Column) -> Column:
    """Strings in their order as a list in brackets."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def content_hash(kind: Column, content: Column, parameters: Column, form: Column) -> Column:
    """Fingerprint of a claim's content. ``parameters`` is an array of (name, type)."""
    pairs = F.transform(F.array_sort(parameters), lambda p: F.concat(F.lit("("), quoted(p["name"]), F.lit(", "), quoted(p["type"]), F.lit(")")))
    return F.sha2(F.concat(kind, F.lit("|"), form, F.lit("|"), content, F.lit("|["), F.array_join(pairs, ", "), F.lit("]")), 256)


def strategy_id(scope: Column, kind: Column, premises: Column, conclusion: Column, structure: Column) -> Column:
    """lcs_ and a hash of the strategy's parts; a missing conclusion counts as None."""
    text = F.concat(scope, F.lit("|"), kind, F.lit("|"), listed(F.array_sort(premises)), F.lit("|"), F.coalesce(conclusion, F.lit("None")), F.lit("|"), F.coalesce(structure, F.lit("")))
    return F.concat(F.lit("lcs_"), F.substring(F.sha2(text, 256), 1, 16))

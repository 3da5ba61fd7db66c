"""License phrases and license blocks in texts.

Only DataFrame functions are used. Fixed phrases are found as runs of words. Besides, an exact
set-similarity join finds every block of text that holds at least ``percent`` hundredths of the
words of a template:

1. A block for a template is ``STRETCH`` times as many consecutive words as the template has
   (fewer at the end of a text); one begins at every word. Texts are cut into pieces, in each of
   which every block that begins in its first half lies whole.
2. The templates' words are ordered by the number of documents that hold them, rare ones first.
3. Prefix filter: a piece with the required overlap holds one of a template's rarest words; other
   pieces are dropped, and the rest join the templates on such a word.
4. Length filter: the piece must hold enough words of any template. Positional filter: the words
   after the common one, in either order, and those before it must be enough for the overlap.
5. The blocks of what is left are counted exactly. Licenses that share a sentence differ in a few
   words: a block ends before the first word of ``without``, and what is left of it must hold the
   words of ``must`` in their order. ``must`` names words on both sides of those that tell the licenses
   apart, so that a block can't end just before them or begin just behind. As a block
   begins at every word, what stands before or behind a notice decides nothing.

Words of no template can't overlap and take no part. The templates are fixed and few; they and
their words are all that is broadcast.

Defined cases: a null text is empty and has no words; a text shorter than a block is a block; repeated rows are rows of their own; equal counts order words by name; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from credograph.llm.shared import written

#: What separates words, phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Sentences by which licenses are known: label, words, words that decide, words that another license has.
_CC = "this work is licensed under a creative commons attribution {}4 0 international license"
_FREE = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license"
_GNU = "this work is licensed under the gnu {}general public license version {}"
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "charge obtaining", "organization"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "organization", ""),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache 2", ""),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "", ""),
    ("cc-by", _CC.format(""), "attribution license", "noncommercial commercial sharealike alike noderivatives noderivs derivatives"),
    ("cc-by-sa", _CC.format("sharealike "), "attribution sharealike license", "noncommercial commercial"),
    ("cc-by-nd", _CC.format("noderivatives "), "attribution noderivatives license", "noncommercial commercial"),
    ("cc-by-nc", _CC.format("noncommercial "), "attribution noncommercial license", "sharealike alike noderivatives noderivs derivatives"),
    ("cc-by-nc-sa", _CC.format("noncommercial sharealike "), "noncommercial sharealike", ""),
    ("cc-by-nc-nd", _CC.format("noncommercial noderivatives "), "noncommercial noderivatives", ""),
    ("gpl", _FREE.format("program", ""), "gnu general public license", "lesser affero"),
    ("lgpl", _FREE.format("library", "lesser "), "gnu lesser", ""),
    ("agpl", _FREE.format("program", "affero "), "gnu affero", ""),
    ("gpl-2", _GNU.format("", 2), "gnu version 2", "lesser affero 3"),
    ("gpl-3", _GNU.format("", 3), "gnu version 3", "lesser affero 2"),
    ("lgpl-3", _GNU.format("lesser ", 3), "gnu lesser 3", "2"),
    ("agpl-3", _GNU.format("affero ", 3), "gnu affero 3", "2"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee", ""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse 2", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", ""),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "", ""),
)
STRETCH = 2


def block(text: str) -> int:
    """Words of a block for a template."""
    return STRETCH * len(text.split())


def required(size: int, percent: int) -> int:
    """Least overlap with a template of so many distinct words."""
    return -(-percent * size // 100)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _spaced(text: Column) -> Column:
    """The words of a text with a blank before and after each, or one blank if there are none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), SEPARATORS, " ")


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(spaced: Column, n_words: Column, phrase: str) -> Column:
    """Number of places of a phrase, and the first and last word where one begins."""
    parts = F.split(spaced, f" {phrase}(?= )", -1)
    n = F.size(parts).cast("long") - 1
    last = n_words - len(phrase.split()) - (_blanks(F.element_at(parts, -1)) - 1)
    return F.when(n > 0, F.struct(n.alias("n"), _blanks(parts[0]).alias("first"), last.alias("last")))


def ranked_words(docs: DataFrame, text_col: str, templates=TEMPLATES) -> list[str]:
    """The templates' words from rare to frequent, by the number of documents that hold them."""
    words = sorted({w for _, t, _, _ in templates for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(_strings(words), F.split(_spaced(F.col(text_col)), " "))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _template_table(spark: SparkSession, ranked: list[str], percent: int, templates) -> tuple[DataFrame, list[str]]:
    """A row for each template and word of its prefix; and all prefix words."""
    rank = {w: i for i, w in enumerate(ranked)}
    rows, prefixes = [], set()
    for label, text, must, without in templates:
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = required(len(words), percent)
        for i, w in enumerate(words[: len(words) - need + 1]):
            prefixes.add(w)
            rows.append(F.struct(F.lit(w).alias("word"), F.lit(label).alias("label"), F.lit(i).alias("i"), F.lit(need).alias("need"), F.lit(block(text)).alias("length"),
                                 _strings(words).alias("template"), _strings(must.split()).alias("must"), _strings(without.split()).alias("without")))
    return spark.range(1).select(F.inline(F.array(*rows))), sorted(prefixes, key=rank.__getitem__)


def scanned(docs: DataFrame, id_col: str, text_col: str, percent: int, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """A row for each document with its base columns, and the matches (row, label, containment)
    of its blocks with templates."""
    spark = docs.sparkSession
    ranked = ranked_words(docs, text_col, templates)
    table, prefixes = _template_table(spark, ranked, percent, templates)
    own = docs.select(F.col(id_col).alias("id"), _spaced(F.col(text_col)).alias("spaced"))
    own = own.withColumn("n_words", _blanks(F.col("spaced")) - 1)
    for k, (phrase, _) in enumerate(PHRASES):
        own = own.withColumn(f"p{k}", _places(F.col("spaced"), F.col("n_words"), phrase))
    own = own.withColumn("words", F.slice(F.split("spaced", " "), 2, F.col("n_words").cast("int")))
    step = max((block(t) for _, t, _, _ in templates), default=1)
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)).cast("int"), F.lit(step))
    held = F.transform(starts, lambda s: F.slice("words", s + 1, 2 * step - 1))
    held = F.filter(held, lambda b: F.arrays_overlap(b, _strings(prefixes)))
    pieces = F.when(F.arrays_overlap("words", _strings(prefixes)), held)
    own = own.select("id", "n_words", *(f"p{k}" for k in range(len(PHRASES))), pieces.alias("pieces"))
    rows = written(own.withColumn("row", F.monotonically_increasing_id()), "license-pieces")

    common = rows.select("row", F.explode("pieces").alias("piece")).withColumn("held", F.array_intersect(_strings(ranked), "piece"))
    pairs = common.select("*", F.posexplode("held").alias("j", "word")).join(F.broadcast(table), "word").filter(F.size("held") >= F.col("need"))
    after = F.least(F.size("template") - F.col("i"), F.size("held") - F.col("j"))
    pairs = pairs.filter((F.least("i", "j") + after >= F.col("need")) & (F.size(F.array_intersect("template", "held")) >= F.col("need")))
    starts = F.sequence(F.lit(1), F.least(F.lit(step), F.size("piece")))
    blocks = pairs.select("row", "label", "need", "template", "must", "without", F.explode(F.transform(starts, lambda s: F.slice("piece", s, F.col("length")))).alias("block"))
    overlap = F.size(F.array_intersect("template", "block"))
    whole = blocks.filter(overlap >= F.col("need"))
    first = lambda end, w: F.least(end, F.nullif(F.array_position("block", w), F.lit(0)))
    ended = whole.withColumn("block", F.slice("block", 1, F.aggregate("without", F.size("block").cast("long") + 1, first).cast("int") - 1))
    # the place of each word behind the one before, 0 once one is missing
    behind = lambda at, w: F.when(at >= 0, F.nullif(F.array_position(F.slice("block", at + 1, F.size("block")), w).cast("int"), F.lit(0)) + at)
    fits = F.aggregate("must", F.lit(0), behind).isNotNull()
    exact = ended.filter((overlap >= F.col("need")) & fits).select("row", "label", (overlap / F.size("template")).alias("containment"))
    return rows, exact


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, templates=TEMPLATES) -> DataFrame:
    """One row for each document: n_words, places of the fixed phrases (number, first and last
    word), labels of the phrases, all labels, and score: 1 with a phrase, else the largest share
    of a template that a block holds, if that is enough, else 0."""
    rows, exact = scanned(docs, id_col, text_col, percent, templates)
    found = exact.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = F.array_compact(F.array(*[F.when(F.col(f"p{k}").isNotNull(), F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    every = lambda field, how: how(*[F.col(f"p{k}.{field}") for k in range(len(PHRASES))])
    total = sum((F.coalesce(F.col(f"p{k}.n"), F.lit(0)) for k in range(len(PHRASES))), F.lit(0).cast("long"))
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", total.alias("n_base"), every("first", F.least).alias("first_word"), every("last", F.greatest).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(total > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def sql(percent: int = 80) -> str:
    """The same report over ``documents`` in DuckDB's SQL: each block against each template that the whole text holds enough of."""
    phrase = lambda p: "[" + ", ".join(f"'{w}'" for w in p.split()) + "]"
    starts = lambda p: f"list_filter(range(0, len(w)::bigint), lambda i: w[i + 1 : i + {len(p.split())}] = {phrase(p)})"
    places = ", ".join(f"{starts(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))
    joined = "list_concat(" + "list_concat(p0, p1), p2)"
    base = "list_concat(list_concat(" + "), ".join(f"CASE WHEN len(p{k}) > 0 THEN ['{label}'] ELSE []::varchar[] END" + (", " if k == 0 else "") for k, (_, label) in enumerate(PHRASES[:2])) + f", CASE WHEN len(p2) > 0 THEN ['{PHRASES[2][1]}'] ELSE []::varchar[] END)"
    words = lambda t: phrase(" ".join(sorted(set(t.split())))) + "::varchar[]"
    templates = ", ".join(f"('{label}', {words(t)}, {block(t)}, {phrase(m) if m else '[]'}::varchar[], {words(o)})" for label, t, m, o in TEMPLATES)
    return rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
base AS (SELECT r, doc_id, w, {places} FROM words),
templates(label, t, size, must, without) AS (VALUES {templates}),
held AS (SELECT * FROM (SELECT r, w, list_distinct(w) AS d FROM words), templates WHERE 100 * len(list_intersect(d, t)) >= {percent} * len(t)),
blocks AS (SELECT label, t, must, without, r, unnest(list_transform(range(0, len(w)::bigint), lambda s: w[s + 1 : s + size])) AS b FROM held),
ended AS (SELECT label, t, must, r, b[: coalesce(list_min(list_filter(list_transform(without, lambda x: list_position(b, x)), lambda p: p > 0)), len(b) + 1) - 1] AS b FROM blocks),
pairs AS (SELECT r, label, len(list_intersect(list_distinct(b), t)) AS k, len(t) AS n FROM ended WHERE (' ' || array_to_string(b, '  ') || ' ') LIKE '%' || array_to_string(list_transform(must, lambda x: ' ' || x || ' '), '%') || '%'),
found AS (SELECT r, list(DISTINCT label) AS more, max(k / n) AS best FROM pairs WHERE 100 * k >= {percent} * n GROUP BY r),
all_of AS (SELECT *, {joined} AS p, {base} AS own FROM base LEFT JOIN found USING (r))
SELECT doc_id, len(w)::bigint AS n_words, len(p)::bigint AS n_base, list_min(p)::bigint AS first_word, list_max(p)::bigint AS last_word,
  array_to_string(list_sort(own), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, []::varchar[])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::double ELSE coalesce(best, 0.0)::double END AS score
FROM all_of"""

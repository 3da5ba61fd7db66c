"""The operators as queries on the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from credograph.llm import chat_format, conversation_repair, decontamination, hard_negatives, jaccard, kneser_ney, language, license_scan, packing, quality, secret_scan, token_counts, warc
from credograph.llm.shared import new_path, written

#: Place of the public tokenizer that op5 packs with; None: ask the package that holds it.
TOKENIZER: str | None = None


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good")))
    return quality.judge(docs, model)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(5) == 1, F.lit(False))
    model = kneser_ney.train(docs.filter(~held_out))
    found = kneser_ney.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(fold(4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: every document is inserted; toxic ones are deleted; those of
    low quality lose their repeated lines, which revises their counts; the insert is sent again."""
    labels = table(spark, sf_dir, "labels")
    told = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    read = token_counts.counts_and_revisions(table(spark, sf_dir, "documents"), "text").select("doc_id", *token_counts.GROUPS, "tokens", "revised")
    insert = written(read, "token-counts-read")  # counts only: no text is shuffled or read twice
    known = insert.join(told, "doc_id").withColumnRenamed("tokens", "old_tokens")
    rollup = token_counts.Rollup(spark, new_path(spark, "token-counts"))
    crawl = insert.withColumns({"change": F.lit("insert"), "old_tokens": F.lit(0)})
    rollup.commit("crawl", crawl)
    rollup.commit("toxic", known.filter("toxic = 1").withColumns({"change": F.lit("delete"), "tokens": F.lit(0)}))
    rollup.compact()
    poor = known.filter("quality = 0 and (toxic is null or toxic != 1)").withColumnRenamed("revised", "tokens")
    rollup.commit("repeated lines", poor.withColumn("change", F.lit("revise")))
    rollup.commit("crawl", crawl)
    return rollup.totals()


OP8_SQL = r"""
WITH told AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
lines AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text FROM (
    SELECT r, line, min(i) AS i FROM (SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
      SELECT row_number() OVER () AS r, string_split(text, chr(10)) AS l FROM documents)) GROUP BY r, line) GROUP BY r),
state AS (SELECT d.source, d.lang, CASE WHEN t.quality = 0 THEN l.text ELSE d.text END AS text
  FROM (SELECT *, row_number() OVER () AS r FROM documents) d LEFT JOIN lines l USING (r) LEFT JOIN told t USING (doc_id) WHERE coalesce(t.toxic, 0) != 1),
counted AS (
  SELECT source, lang, 'blank-words-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM state
  UNION ALL SELECT source, lang, 'letter-words-1', len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM state)
SELECT source, lang, version, count(*) AS documents, sum(tokens)::bigint AS tokens FROM counted GROUP BY ALL"""


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"), parts=True)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.get(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int")).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digest(chat_format.examples(turns))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the damaged conversations, and of those that lost all rows."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = table(spark, sf_dir, "conversations")
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    own = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    damaged = own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    found = conversation_repair.report(damaged.drop("copy"))
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_warc, op2_license_scan, op3_quality, op4_kneser_ney, op5_packing, op6_decontamination, op7_language, op8_token_counts, op9_jaccard, op10_secret_scan, op11_chat_format, op12_hard_negatives, op13_conversation_repair)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op2_license_scan": license_scan.sql(), "op6_decontamination": decontamination.SQL, "op8_token_counts": OP8_SQL, "op9_jaccard": jaccard.SQL, "op11_chat_format": chat_format.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_conversation_repair": conversation_repair.SQL}

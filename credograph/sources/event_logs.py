"""Event logs in files, read so that bad records become rows and good ones stay.

A file is one log. In the line layout its first line that isn't blank is the manifest and every other line
an event; in the single layout it is one object with ``manifest`` and ``events``. Lines are read where they
lie, so a long log is split among tasks, and numbered by counting each split's lines first. A
single object has to be read whole.

Nothing here raises: what can't be decoded, lacks a field, has one too many or of the wrong kind is
an issue (file, location, message), and only that record is left out. A file without a valid
manifest keeps its events. Defined cases: blank lines are skipped; an empty file is an issue; repeated
records stay; a field that is null or missing has its default where there is one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from credograph.sources.folders import cut

#: The kinds of events and of references, and the fields of each record with what they must be.
KINDS = ("decision", "tool_call", "tool_result", "intermediate_state", "retry", "claim_ref")
RELATIONS = ("asserts", "uses", "contradicts")
EVENT = {
    "event_id": "name", "seq": "count", "prev_hash": "text", "ts": "time", "kind": "kind", "actor": "name", "inputs": "object", "outputs": "object or null", "reason": "text or null",
    "refs": "refs", "parent_event_id": "text or null", "tool": "text or null", "error": "text or null",
}
MANIFEST = {"schema_version": "text", "arm_id": "name", "session_id": "name", "trace_id": "name", "created_at": "time", "events_root": "text", "manifest_hash": "text", "signature": "text or null"}
_NEEDED = ("event_id", "seq", "ts", "kind", "actor", "arm_id", "session_id", "trace_id", "created_at")
_REF = "array<struct<claim_id:string,review_id:string,relation:string>>"


def _parsed(value: Column) -> Column:
    """The one JSON value that a text is, else null. The parser itself stops after a first value, so what
    follows one shows only inside something."""
    listed = F.try_parse_json(F.concat(F.lit("["), value, F.lit("\n]")))
    named = F.try_parse_json(F.concat(F.lit('{"a":'), value, F.lit("\n}")))
    one = F.try_variant_get(listed, "$[1]", "variant").isNull() & named.isNotNull()
    return F.when(one, F.try_variant_get(listed, "$[0]", "variant"))


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, line (from 1), value, first (whether no line before it has text) of all files."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    own = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("at", F.monotonically_increasing_id())
    real = F.when(F.trim("value") != "", F.col("at"))
    sizes = own.groupBy("file", "block").agg(F.count("*").alias("n"), F.min(real).alias("real"))
    # one row a split: how many lines the splits before it have, and whether one of them has text
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = sizes.select("file", "block", "real", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.min("real").over(order).isNull().alias("open"))
    number = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return own.withColumn("k", number).join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("k")).alias("line"), "value", (F.col("open") & (F.col("at") == F.col("real"))).alias("first"))


def _items(spark: SparkSession, path: str, lines: str, singles: str) -> tuple[DataFrame, DataFrame]:
    """Records (file, place, order, manifest, value) of both layouts, and the issues of whole files."""
    each = _lines(spark, path, lines)
    place = F.when(F.col("first"), "manifest").otherwise(F.concat(F.lit("line:"), F.col("line").cast("string")))
    rows = each.filter(F.trim("value") != "").select("file", place.alias("place"), F.col("line").cast("long").alias("order"), F.col("first").alias("manifest"), "value")
    whole = spark.read.option("pathGlobFilter", singles).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    root = _parsed(F.col("value"))
    kind = F.schema_of_variant(root)
    told = F.from_json("value", "manifest string, events array<string>")
    good = whole.filter(F.coalesce(kind.startswith("OBJECT"), F.lit(False))).select("file", told.alias("t"))
    issue = F.when(F.trim("value") == "", "empty file").when(root.isNull(), "json decode").when(~kind.startswith("OBJECT"), "root must be object")
    issues = whole.select("file", F.lit("<file>").alias("location"), issue.alias("message")).filter("message is not null")
    no_lines = each.groupBy("file").agg(F.max(F.trim("value") != "").alias("some")).filter("not some").select("file", F.lit("<file>").alias("location"), F.lit("empty file").alias("message"))
    one = good.select("file", F.lit("manifest").alias("place"), F.lit(0).cast("long").alias("order"), F.lit(True).alias("manifest"), F.coalesce("t.manifest", F.lit("null")).alias("value"))
    events = good.select("file", F.posexplode("t.events").alias("i", "value")).select("file", F.concat(F.lit("events["), F.col("i").cast("string"), F.lit("]")).alias("place"), F.col("i").cast("long").alias("order"), F.lit(False).alias("manifest"), F.coalesce("value", F.lit("null")).alias("value"))
    return rows.unionByName(one).unionByName(events), issues.unionByName(no_lines)


def _problem(kind: str, field: str) -> Column:
    """Why a field of variant ``v`` isn't what it must be, or null."""
    sort = F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))
    text = F.try_variant_get("v", f"$.{field}", "string")
    if kind == "name":
        wrong = F.when(sort != "STRING", "must be text").when(text == "", "must not be empty")
    elif kind == "kind":
        wrong = F.when((sort != "STRING") | ~text.isin(*KINDS), "unknown kind")
    elif kind == "count":
        wrong = F.when(sort != "BIGINT", "must be a whole number").when(text.startswith("-"), "must not be negative")
    elif kind == "time":
        wrong = F.when((sort != "STRING") | F.try_to_timestamp(text).isNull(), "must be a time")
    elif kind.startswith("object"):
        wrong = F.when(~sort.startswith("OBJECT"), "must be an object")
    elif kind == "refs":
        bad = lambda r: (F.coalesce(r["claim_id"], F.lit("")) == "") | (F.coalesce(r["review_id"], F.lit("")) == "") | ~F.coalesce(r["relation"].isin(*RELATIONS), F.lit(False))
        refs = F.from_json(F.to_json(F.try_variant_get("v", f"$.{field}", "variant")), _REF)
        wrong = F.when(~sort.startswith("ARRAY"), "must be a list").when(F.coalesce(F.exists(refs, bad), F.lit(False)), "unknown reference")
    else:
        wrong = F.when(sort != "STRING", "must be text")
    null = F.lit(None) if kind.endswith("or null") else F.lit("must not be null")
    return F.when(sort.isNull(), F.lit("missing") if field in _NEEDED else F.lit(None)).when(sort == "VOID", null).otherwise(wrong)


def _checked(items: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The items with nothing wrong, with variant ``v``; and the issues of the others."""
    own = cut(items.withColumn("v", _parsed(F.col("value"))))
    sort = F.schema_of_variant("v")
    whole = F.when(sort.isNull(), "json decode").when(~sort.startswith("OBJECT"), "must be an object")
    each = F.array(*[F.struct(F.lit(f".{k}").alias("field"), _problem(kind, k).alias("message")) for k, kind in fields.items()])
    more = F.transform(F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*map(F.lit, fields))), lambda k: F.struct(F.concat(F.lit("."), k).alias("field"), F.lit("unknown field").alias("message")))
    one = F.array(F.struct(F.lit("").alias("field"), whole.alias("message")))
    found = F.filter(F.when(whole.isNotNull(), one).otherwise(F.concat(each, more)), lambda x: x["message"].isNotNull())
    # written once: else the filter below and every field parse and check each record again
    own = cut(own.withColumn("wrong", found))
    issues = own.select("file", "place", F.explode("wrong").alias("x")).select("file", F.concat("place", "x.field").alias("location"), "x.message")
    return own.filter(F.size("wrong") == 0), issues


def read(spark: SparkSession, path: str, lines: str = "*.jsonl", singles: str = "*.json") -> dict[str, DataFrame]:
    """manifests, events and issues (file, location, message) of all files below ``path`` whose names fit
    ``lines`` (line layout) or ``singles`` (single layout). Events have file, order, their fields, and
    inputs, outputs and refs also as canonical JSON."""
    items, whole = _items(spark, path, lines, singles)
    headers, wrong_headers = _checked(items.filter("manifest"), MANIFEST)
    rows, wrong_rows = _checked(items.filter("not manifest"), EVENT)
    text = lambda k, default=None: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit(default)).alias(k)
    time = lambda k: F.try_to_timestamp(F.try_variant_get("v", f"$.{k}", "string")).alias(k)
    plain = lambda k, default: F.coalesce(F.nullif(F.to_json(F.try_variant_get("v", f"$.{k}", "variant")), F.lit("null")), F.lit(default)).alias(f"{k}_json")
    manifests = headers.select("file", text("schema_version", "1"), text("arm_id"), text("session_id"), text("trace_id"), time("created_at"), text("events_root", ""), text("manifest_hash", ""), text("signature"))
    refs = F.coalesce(F.from_json(F.to_json(F.try_variant_get("v", "$.refs", "variant")), _REF), F.array().cast(_REF)).alias("refs")
    events = rows.select(
        "file", "order", text("event_id"), F.try_variant_get("v", "$.seq", "bigint").alias("seq"), text("prev_hash", ""), time("ts"), text("kind"), text("actor"), plain("inputs", "{}"), plain("outputs", None), text("reason"),
        refs, plain("refs", "[]"), text("parent_event_id"), text("tool"), text("error"),
    )
    return {"manifests": manifests, "events": events, "issues": reduce(DataFrame.unionByName, [whole, wrong_headers, wrong_rows])}


def unresolved_references(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """file, event_id, seq, place, claim_id, review_id of references to a review that isn't there."""
    each = events.select("file", "event_id", "seq", F.posexplode("refs").alias("place", "ref")).select("file", "event_id", "seq", "place", "ref.claim_id", "ref.review_id")
    return each.join(reviews.select("review_id").distinct(), "review_id", "left_anti").select("file", "event_id", "seq", "place", "claim_id", "review_id")


def manifest_mismatches(manifests: DataFrame, events: DataFrame) -> DataFrame:
    """file, field (events_root or manifest_hash), declared, recomputed, where a manifest declares a
    hash that isn't its own. Events are hashed in the order of the file."""
    from credograph.operators import trace

    own = events.select(F.col("file").alias("trace_id"), F.col("order").alias("place"), *[c for c in events.columns if c not in ("file", "order", "refs")])
    roots = trace.events_root(own, "place", ("trace_id", "place")).select(F.col("trace_id").alias("file"), "root")
    empty = F.sha2(F.lit("[]"), 256)
    fields = manifests.drop("file", "manifest_hash")
    both = manifests.join(roots, "file", "left").select("file", "events_root", "manifest_hash", F.coalesce("root", empty).alias("root"), F.sha2(trace.payload(fields), 256).alias("own"))
    each = both.select("file", F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("declared"), F.col(v).alias("recomputed")) for k, v in (("events_root", "root"), ("manifest_hash", "own"))])))
    return each.filter("declared != '' and declared != recomputed")

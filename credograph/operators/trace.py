"""Checks on event logs (trace_id, seq, actor, reason, ...). A window never spans logs, so the
work is split by trace; counts combine within tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from credograph.sources.folders import cut


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Events whose number is not the one after the last; a log begins with 0."""
    before = F.lag("seq").over(Window.partitionBy("trace_id").orderBy("seq"))
    return events.select("trace_id", "seq", (F.coalesce(before, F.lit(-1)) + 1).alias("expected")).filter("seq != expected")


def time_disorder(events: DataFrame, *order: str) -> DataFrame:
    """Events earlier than the event before them."""
    before = F.lag("ts").over(Window.partitionBy("trace_id").orderBy(*order or ["seq"]))
    return events.select("trace_id", *order or ["seq"], "ts", before.alias("before")).filter("ts < before")


def actor_switches(events: DataFrame) -> DataFrame:
    """Events by another actor than the event before."""
    before = F.lag("actor").over(Window.partitionBy("trace_id").orderBy("seq"))
    return events.select("trace_id", "seq", before.alias("before"), "actor").filter("before != actor")


def json_text(text: Column) -> Column:
    """A string as canonical JSON: quotes, backslashes and control characters escaped, nothing
    else; null for a null."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        full = F.replace(full, F.lit(chr(code)), F.lit(short))
    return F.coalesce(F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), full).otherwise(plain), F.lit('"')), F.lit("null"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object of JSON values, keys in order and without blanks."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_time(t: Column) -> Column:
    """A time in UTC as text with a Z; parts of a second only where there are some."""
    utc = F.to_utc_timestamp(t, F.current_timezone())
    part = F.date_format(utc, "SSSSSS")
    return json_text(F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(""), F.lit("Z")))


def payload(events: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """An event as canonical JSON. All columns but the recorded ``prev_hash`` and ``but`` take part; columns
    named ``*_json`` hold JSON already and go under the name without that ending. Texts, whole numbers,
    booleans and times have one spelling; other types are refused."""
    fields = {}
    for f in events.schema:
        if f.name == "prev_hash" or f.name in but:
            continue
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if f.name.endswith("_json"):
            fields[f.name[:-5]] = F.coalesce(c, F.lit("null"))
        elif kind in ("byte", "short", "integer", "long", "boolean"):
            fields[f.name] = F.coalesce(c.cast("string"), F.lit("null"))
        elif kind in ("timestamp", "timestamp_ntz"):
            fields[f.name] = json_time(c.cast("timestamp"))
        elif kind in ("string", "void"):
            fields[f.name] = json_text(c.cast("string"))
        else:
            raise TypeError(f"{f.name}: {kind} has no canonical JSON here; give it as text or as {f.name}_json")
    return canonical_json(fields)


def hash_chain(events: DataFrame) -> DataFrame:
    """Each event's hash, and that of the event before (empty for the first)."""
    hashed = events.select("trace_id", "seq", F.sha2(payload(events), 256).alias("event_hash"))
    return hashed.withColumn("prev_hash", F.coalesce(F.lag("event_hash").over(Window.partitionBy("trace_id").orderBy("seq")), F.lit("")))


def broken_links(events: DataFrame, genesis: str = "") -> DataFrame:
    """Events (with a recorded prev_hash) that don't follow the event before them; a log's first
    must follow ``genesis``."""
    own = events.select("trace_id", "seq", "prev_hash", F.sha2(payload(events), 256).alias("event_hash"))
    expected = F.coalesce(F.lag("event_hash").over(Window.partitionBy("trace_id").orderBy("seq")), F.lit(genesis))
    return own.withColumn("expected", expected).filter("not prev_hash <=> expected").select("trace_id", "seq", "prev_hash", "expected")


def verify(events: DataFrame, genesis: str = "") -> DataFrame:
    """trace_id, ok, first_broken: the number of the first event that breaks the chain, or null."""
    bad = broken_links(events, genesis).groupBy("trace_id").agg(F.min("seq").alias("first_broken"))
    return events.select("trace_id").distinct().join(bad, "trace_id", "left").select("trace_id", F.col("first_broken").isNull().alias("ok"), "first_broken")


def events_root(events: DataFrame, order: str = "seq", but: tuple[str, ...] = ()) -> DataFrame:
    """trace_id, root: the hash of the JSON list of a log's events, in ``order``. Logs are hashed as they
    stream through a task; none is held whole. Columns ``but`` take no part."""
    rows = events.select(F.col("trace_id").cast("string").alias("trace_id"), F.col(order).alias("seq"), payload(events, but).alias("j")).repartition("trace_id").sortWithinPartitions("trace_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for batch in batches:
            for trace, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest is None or trace != at:
                    if digest is not None:
                        digest.update(b"]")
                        out.append((at, digest.hexdigest()))
                    at, digest = trace, hashlib.sha256(b"[")
                else:
                    digest.update(b",")
                digest.update(text.encode())
            yield _roots(out)
            out = []
        if digest is not None:
            digest.update(b"]")
            yield _roots([(at, digest.hexdigest())])

    return rows.mapInArrow(run, "trace_id string, root string")


def _roots(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["trace_id", "root"])


def statistics(events: DataFrame, kind: str) -> DataFrame:
    """Events, distinct actors and seconds from first to last, by kind."""
    span = F.unix_seconds(F.max("ts").cast("timestamp_ltz")) - F.unix_seconds(F.min("ts").cast("timestamp_ltz"))
    return events.groupBy(kind).agg(F.count("*").alias("n_events"), F.countDistinct("actor").alias("n_actors"), span.alias("seconds"))


def open_tool_calls(events: DataFrame) -> DataFrame:
    """Calls (kind tool_call) without a later result, retry or noted error: a tool_result or
    retry whose parent is the call, or a decision or intermediate_state by the same actor with an
    error. Only each key's last such event is joined, so long logs multiply nothing."""
    last = lambda where, key, name: events.filter(where).groupBy("trace_id", F.col(key).alias(name)).agg(F.max("seq").alias(f"last_{name}"))
    answers = last("kind in ('tool_result', 'retry') and parent_event_id is not null", "parent_event_id", "event_id")
    errors = last("kind in ('decision', 'intermediate_state') and error is not null and error != ''", "actor", "actor")
    calls = events.filter("kind = 'tool_call'").select("trace_id", "seq", "event_id", "actor")
    late = lambda c: F.coalesce(F.col(c) > F.col("seq"), F.lit(False))
    return calls.join(answers, ["trace_id", "event_id"], "left").join(errors, ["trace_id", "actor"], "left").filter(~late("last_event_id") & ~late("last_actor")).select("trace_id", "seq", "event_id")


def orphans(events: DataFrame) -> DataFrame:
    """Events whose parent isn't in their log."""
    known = events.select("trace_id", F.col("event_id").alias("parent_event_id"))
    return events.filter("parent_event_id is not null").join(known, ["trace_id", "parent_event_id"], "left_anti").select("trace_id", "event_id", "parent_event_id")


def retry_chains(events: DataFrame, limit: int, most_doublings: int = 24) -> DataFrame:
    """Retries with more than ``limit`` retries on their way up (themselves included), found by
    doubling the way that each event has gone, so the rounds follow the logarithm of its length.
    Event ids are unique; a ring of parents raises an error."""
    way = events.select("event_id", F.col("parent_event_id").alias("to"), (F.col("kind") == "retry").cast("long").alias("n"))
    for _ in range(most_doublings):
        further = way.select(F.col("event_id").alias("to"), F.col("to").alias("next"), F.col("n").alias("more"))
        way = cut(way.join(further, "to", "left").select("event_id", F.col("next").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        if way.filter("`to` is not null").isEmpty():
            return events.filter("kind = 'retry'").select("event_id").join(way, "event_id").filter(F.col("n") > limit).select("event_id", F.col("n").alias("n_retries"))
    raise RuntimeError("parents form a ring")

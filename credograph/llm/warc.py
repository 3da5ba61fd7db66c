"""WARC archives: writing, normalising whole-file gzip streams, and reading by offset.

``write_archives`` makes one archive for each partition, compressed as a single stream, as many
old crawls are. ``normalise`` inflates such a file once from front to end and rewrites every
record as a gzip member of its own, with a sidecar index of offsets beside it; the index is also
a table. ``read_records`` then fetches records by offset. Files are read and written in pieces,
records are not held whole by the normaliser, and a task that runs again writes the same files.

A revisit record stands for a payload that another record of the set holds: it keeps the HTTP
header and the digest and names the other record. Only digests are shuffled to find these. What
each revisit refers to is kept in sorted arrays, by a 64-bit hash of page and digest, which the
writing tasks search; payloads are never shuffled or sent out.

Defined cases: a null payload is empty; a null address leaves its header out; repeated rows are
records of their own; of equal payloads the record with the largest id is the response (rows
that repeat this id and payload too); rows without an id refer to it, or are responses if no
equal row has an id; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from credograph.llm import files, lookup
from credograph.llm.shared import Scratch, delete, new_path, small_batches, stored

CHUNK = 1 << 20
#: Bytes of payloads that are handed on at once.
HANDED = 8 << 20
_GZIP = 31
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _id(page) -> str:
    return "<urn:page:none>" if page is None else f"<urn:page:{page}>"


def _page(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def record(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_to))]
    block = http + payload if refers_to is None else http
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def head_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def references(pages: DataFrame, folder: str, id_col: str, payload_col: str, least: int = 0) -> lookup.Table:
    """What the revisits refer to, by ``_mark`` of page and payload."""
    work, payload = Scratch(pages.sparkSession, "revisits"), _payload(payload_col)
    narrow = pages.select(F.col(id_col).cast("long").alias("page"), F.sha1(payload).alias("sha"), F.length(payload).alias("size"), _mark(id_col, payload_col).alias("key")).filter(F.col("size") >= least)
    first = narrow.groupBy("sha").agg(F.max("page").alias("to"), F.count("*").alias("n")).filter("n > 1 and to is not null").select("sha", "to")
    revisits = narrow.join(first, "sha").filter(~F.col("page").eqNullSafe(F.col("to"))).groupBy("key").agg(F.max("to").alias("value"))
    table = lookup.write(work.write(revisits, "pages"), folder)
    work.close()
    return table


def _payload(payload_col: str):
    return F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))


def _mark(id_col: str, payload_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.sha1(_payload(payload_col)))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> list[str]:
    """One stream-compressed archive for each partition with rows; their places."""
    files.make_folder(folder)
    refers = references(pages, f"{folder}/refers-to", id_col, payload_col, least)
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col("url").cast("string").alias("url"), _payload(payload_col).alias("payload"), _mark(id_col, payload_col).alias("key"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            page, url, payload, key = batch.columns
            found, to = refers.find(key)
            for i in range(len(page)):  # one payload at a time, whatever a batch holds
                data = payload[i].as_py()
                yield record(page[i].as_py(), url[i].as_py(), data, base32_sha1(data), int(to[i]) if found[i] else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = records(batches)
        row = next(rows, None)
        if row is None:
            return
        place, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with files.writing(place) as out:
            squeeze = zlib.compressobj(1, zlib.DEFLATED, _GZIP)
            while row is not None:
                out.write(squeeze.compress(row))
                row, n = next(rows, None), n + 1
            out.write(squeeze.flush())
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([n], pa.int64())], names=["place", "n"])

    # one short row for each archive
    places = sorted(r.place for r in own.mapInArrow(run, "place string, n bigint").collect())
    delete(pages.sparkSession, f"{folder}/refers-to")
    return places


def inflate(source) -> Iterator[bytes]:
    """Pieces of the plain text of a gzip file of one or more members."""
    squeeze, data = zlib.decompressobj(_GZIP), source.read(CHUNK)
    started = False
    while data:
        started = True
        piece = squeeze.decompress(data, CHUNK)
        if piece:
            yield piece
        if squeeze.eof:
            data = squeeze.unused_data or source.read(CHUNK)
            squeeze, started = zlib.decompressobj(_GZIP), False
        else:
            data = squeeze.unconsumed_tail or source.read(CHUNK)
    while started and not squeeze.eof:
        piece = squeeze.decompress(b"", CHUNK)
        if not piece:
            raise EOFError("the gzip stream is cut off")
        yield piece


class _Members:
    """Writes records as members of their own and remembers where they are."""

    def __init__(self, out, level: int):
        self.out, self.level, self.at, self.index = out, level, 0, []

    def begin(self, head: bytes) -> None:
        self.squeeze, self.start, self.fields = zlib.compressobj(self.level, zlib.DEFLATED, _GZIP), self.at, head_fields(head)
        self.put(head + b"\r\n\r\n")

    def put(self, data: bytes) -> None:
        self._out(self.squeeze.compress(data))

    def _out(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def end(self) -> None:
        self._out(self.squeeze.flush())
        f = self.fields
        self.index.append({"record_id": f.get("warc-record-id"), "type": f.get("warc-type"), "uri": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest"), "start": self.start, "size": self.at - self.start})


def normalise_file(source, out, level: int = 6) -> list[dict]:
    """Rewrite one archive record by record; the index of the new one."""
    made, held, left = _Members(out, level), bytearray(), None
    for piece in inflate(source):
        held += piece
        while True:
            if left is None:
                cut = held.find(b"\r\n\r\n")
                if cut < 0:
                    break
                head = bytes(held[:cut]).lstrip(b"\r\n")
                made.begin(head)
                del held[: cut + 4]
                left = int(made.fields["content-length"]) + 4
            part = bytes(held[:left])
            if part:
                made.put(part)
                del held[: len(part)]
                left -= len(part)
            if left:
                break
            made.end()
            left = None
    if left or held.strip():
        raise EOFError("the last record is cut off")
    return made.index


_INDEX = pa.schema([("place", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("start", pa.int64()), ("size", pa.int64())])


def normalise(spark: SparkSession, places: list[str], folder: str) -> DataFrame:
    """Rewrite the archives into ``folder``, one task for each; the index of all as a table."""
    files.make_folder(folder)
    sent = spark.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                source = sent.value[i]
                place = f"{folder}/{source.rpartition('/')[2]}"
                with files.reading(source) as f, files.writing(place) as out:
                    index = normalise_file(f, out)
                with files.writing(f"{place}.idx") as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pylist([x | {"place": place} for x in index], schema=_INDEX)

    n = len(places)
    made = spark.range(0, n, 1, max(n, 1)).mapInArrow(run, "place string, record_id string, type string, uri string, digest string, start bigint, size bigint")
    return stored(made, f"{folder}/index")


def _bodies(index: DataFrame, make, schema: pa.Schema) -> DataFrame:
    """``make`` applied to (index row, record head fields, HTTP head fields, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, source, rows, held = None, None, [], 0
        for batch in batches:
            for x in batch.to_pylist():
                if x["place"] != place:
                    if source is not None:
                        source.close()
                    place, source = x["place"], files.reading(x["place"])
                source.seek(x["start"])
                raw = zlib.decompress(source.read(x["size"]), _GZIP)
                head, _, block = raw.partition(b"\r\n\r\n")
                fields = head_fields(head)
                http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
                rows.append(make(x, fields, head_fields(http), payload))
                held += len(payload) if "payload" in rows[-1] else 0
                if held > HANDED or len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if source is not None:
            source.close()

    return index.mapInArrow(run, from_arrow_schema(schema))


_PAYLOADS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("payload", pa.binary())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_payloads(index: DataFrame) -> DataFrame:
    """record_id, type, uri and payload (binary) of every record."""
    return _bodies(index, lambda x, f, h, payload: {"record_id": x["record_id"], "type": x["type"], "uri": x["uri"], "payload": payload}, _PAYLOADS)


def read_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record. A
    response's size and digest are taken from its payload, a revisit's from its heads."""

    def make(x: dict, fields: dict, http: dict, payload: bytes) -> dict:
        kind = fields["warc-type"]
        full = kind == "response"
        size = len(payload) if full else int(http["content-length"])
        digest = base32_sha1(payload) if full else fields["warc-payload-digest"].removeprefix("sha1:")
        return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("warc-refers-to"))}

    return _bodies(index, make, _RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as archives, normalise them, and read every record back."""
    spark = small_batches(pages).sparkSession
    folder = new_path(spark, "warc")
    places = write_archives(pages, f"{folder}/stream", id_col, payload_col, least)
    index = normalise(spark, places, f"{folder}/records")
    delete(spark, f"{folder}/stream")
    return read_records(index)


#: The same rows in DuckDB's SQL. Base 32 is written 20 bits, or four characters, at a time.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS body FROM pages),
t AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY html) AS top, count(*) OVER (PARTITION BY html) AS alike FROM p)
SELECT page_id, n::bigint AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || hex[5 * i + 1 : 5 * i + 5])::bigint >> s) & 31) + 1)::bigint]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN alike > 1 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN alike > 1 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t"""

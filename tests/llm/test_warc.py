import base64
import gzip
import hashlib
import io
import json
import random

import duckdb
import pandas as pd
import pytest
from credograph.llm import files, warc
from credograph.llm.shared import new_path


def brute(pages, least=0):
    out = []
    same = {}
    for i, _, h in pages:
        same.setdefault(h or "", []).append(i)
    for i, _, h in pages:
        p = (h or "").encode()
        ids = [x for x in same[h or ""] if x is not None]
        to = max(ids) if ids and len(same[h or ""]) > 1 and len(p) >= least else None
        to = None if to == i else to
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rnd = random.Random(1)
    texts = ["", "a", "é" * 9, "x\r\n\r\ny WARC/1.1\r\n", "z" * 3_000_000, *(str(rnd.random()) for _ in range(20))]
    pages = [(i, rnd.choice(["http://a b\r\n/", None, "http://é"]), rnd.choice([*texts, None])) for i in range(120)]
    pages += [(7, "u", "twice"), (7, "u", "twice"), (None, "u", "twice"), (None, None, "alone"), (119, "u", "other")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, record_type int").repartition(3)
    got = warc.round_trip(frame, least=least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pages, least)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_normalised_members_and_index(spark):
    frame = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * i) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    folder = new_path(spark, "test")
    places = warc.write_archives(frame, f"{folder}/a")
    index = warc.normalise(spark, places, f"{folder}/b")
    rows = index.collect()
    with files.reading(rows[0].place) as f:
        whole = f.read()
    with files.reading(places[0]) as f:
        assert gzip.decompress(whole) == gzip.decompress(f.read())
    assert sum(r["size"] for r in rows) == len(whole)
    for r in rows:
        one = gzip.decompress(whole[r.start : r.start + r["size"]])
        assert one.startswith(b"WARC/1.1\r\n") and r.record_id.encode() in one
    with files.reading(rows[0].place + ".idx") as f:
        assert len([json.loads(x) for x in f.read().splitlines()]) == 50
    assert {r.record_id: r.payload.decode() for r in warc.read_payloads(index).collect()}["<urn:page:3>"] == "<p>3</p>" * 3


def test_rare_revisits_over_several_batches_and_the_sql(spark):
    html = [None if i % 700 == 5 else f"<p>{i}</p>é" for i in range(2500)] + ["<p>7</p>é", "<p>7</p>é"]
    pages = pd.DataFrame({"page_id": range(len(html)), "url": [None if i % 1100 < 1050 else "u" for i in range(len(html))], "html": html})
    frame = spark.createDataFrame(pages).coalesce(1)
    got = warc.round_trip(frame).toPandas().astype({"refers_to": "Int64"})
    assert list(got.record_type).count("revisit") == 5
    want = duckdb.sql(warc.SQL).df().astype({"refers_to": "Int64"})
    key = lambda t: t.sort_values("page_id").reset_index(drop=True)[want.columns]
    pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False)
    index = warc.normalise(spark, warc.write_archives(frame, new_path(spark, "test")), new_path(spark, "test"))
    assert warc.read_payloads(index).filter("uri is null").count() > 2000


def test_members_in_pieces_and_cut_files(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    one = warc.record(1, "u", b"hello" * 50, "D", None)
    two = warc.record(2, None, b"", "E", 1)
    for raw in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        out = io.BytesIO()
        assert [x["type"] for x in warc.normalise_file(io.BytesIO(raw), out)] == ["response", "revisit"]
        assert gzip.decompress(out.getvalue()) == one + two
        with pytest.raises((EOFError, KeyError)):
            warc.normalise_file(io.BytesIO(raw[:-20]), io.BytesIO())
    assert warc.normalise_file(io.BytesIO(b""), io.BytesIO()) == []

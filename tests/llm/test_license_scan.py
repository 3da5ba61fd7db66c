import re

import duckdb
import pandas as pd

from credograph.llm import license_scan as L

GPL, MIT, BSD = (next(t for x, t, *_ in L.TEMPLATES if x == label) for label in ("gpl-3", "mit", "bsd"))


def corpus():
    rest = "und mit der unter the license of public work 2 0 3 version file".split()
    prose = " ".join(rest[i * 7 % len(rest)] for i in range(400))
    docs = [
        (1, f"Foo. {GPL.upper()}!"), (2, None), (3, ""), (4, "cc-by-nc cc by\nNC x"), (5, "Under the MIT License; under the mit license under the mit licenses"), (6, "Apache License, Version 2.0"),
        (7, prose), (8, f"{prose} {MIT} {prose}"), (9, " ".join(reversed(MIT.split()))), (10, " ".join(MIT.split()[:14])), (11, " ".join(MIT.split()[:17])), (12, "--"), (13, "é" + " x" * 20_000 + f" {BSD}"),
        (None, GPL), (1, f"Foo. {GPL.upper()}!"), (14, "apache license version 2 apache license version 20"),
    ]
    for k in range(30):
        docs.append((100 + k, f"{prose[k:]} {' '.join(w for i, w in enumerate(L.TEMPLATES[k % len(L.TEMPLATES)][1].split()) if (i + k) % 5)} {prose}"))
    return docs


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, own = [], set()
    for p, label in L.PHRASES:
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        own |= {label} if at else set()
    found = {}
    for label, t, must, without in L.TEMPLATES:
        most, need, t, without = 2 * len(t.split()), -(-4 * len(set(t.split())) // 5), set(t.split()), set(without.split())
        order = re.compile(".*".join(f" {x} " for x in must.split()))
        # every run of words, at any place and of any length up to twice the template's
        for i in range(len(w)) if len(t & set(w)) >= need else ():
            run = set()
            for j in range(i, min(i + most, len(w))):
                if w[j] in without:
                    break
                run |= {w[j]} & t
                if len(run) >= need and len(run) / len(t) > found.get(label, 0) and order.search(f" {'  '.join(w[i : j + 1])} "):
                    found[label] = len(run) / len(t)
    best, more = max(found.values(), default=0.0), own | set(found)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(more)), 1.0 if places else best


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


def test_matches_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, words string").repartition(3)
    got = L.report(frame)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    want = [(d, *brute(t)) for d, t in docs]
    assert order(map(tuple, got.collect())) == order(want)
    assert sum(r[6] != "" and r[5] == "" for r in want) > 15
    documents = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert order(duckdb.sql(L.sql()).fetchall()) == order(want)
    assert L.report(frame.limit(0)).count() == 0


CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."


def test_neighbouring_licenses(spark):
    texts = {
        CC.format(""): "cc-by", CC.format("-ShareAlike"): "cc-by-sa", CC.format("-NonCommercial"): "cc-by-nc", CC.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd", CC.format("-NonCommercial-ShareAlike"): "cc-by-nc-sa",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
        "this work is licensed under the GNU General Public License version 2": "gpl-2", "this work is licensed under the GNU General Public License version 3": "gpl-3",
        "this text tells of the license of a work under the sun, 4 of 10 creative people": "",
    }
    docs = [(i, pad + t) for i, t in enumerate(texts) for pad in ("", "w " * 61, "w " * 999)]
    got = L.report(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "labels").collect()
    assert sorted(map(tuple, got)) == sorted((i, list(texts.values())[i]) for i, _ in docs)


def test_neighbours_on_both_sides_change_nothing(spark):
    """Each notice at the start, middle and end of a text, before and behind each other one."""
    by_label = {}
    for label, t, *_ in L.TEMPLATES:
        by_label.setdefault(label, t)
    pad = "y " * 40
    docs, want = [], []
    for label, t in by_label.items():
        for k, text in enumerate((t, f"{pad}{t} {pad}", f"{pad}{t}", f"{t} commercial use of lesser or affero organization is fine 2 3", f"{t} {t}")):
            docs.append((len(docs), text))
            want.append({label})
        for other, u in by_label.items():
            docs.append((len(docs), f"{t} {u}"))
            want.append({label, other})
    got = L.report(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "labels").collect()
    wrong = [(docs[r.doc_id][1], r.labels, want[r.doc_id]) for r in got if set(r.labels.split(",")) - {""} != want[r.doc_id]]
    # a phrase or a sentence that both licenses have may name a third; none may be lost
    assert not [x for x in wrong if not x[2] <= set(x[1].split(","))]
    assert len(wrong) <= len(docs) // 20


def test_stretched_notice_is_found_at_every_offset(spark):
    words = BSD.split()
    stretched = " ".join(f"{w} x" for w in words)
    got = L.report(spark.createDataFrame([(k, "y " * k + stretched + " z" * 90) for k in range(100)], "doc_id long, text string"))
    assert {r.labels for r in got.collect()} == {"bsd"}


def test_templates_hold_what_decides():
    for _, t, must, without in L.TEMPLATES:
        assert set(must.split()) <= set(t.split()) and not set(without.split()) & set(t.split())

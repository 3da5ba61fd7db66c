import hashlib
import math
import random
import re
import string

from credograph.llm import secret_scan as S

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def joined(found):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in found)


def battery(token):
    """(stratum, cell) by the definitions."""
    body = token.rstrip("=")
    if re.fullmatch(r"[0-9]+", body) or re.fullmatch(r"(?:[A-Z]?[a-z]*|[A-Z]+)(?:[+/_-]+(?:[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,4}))*", body):
        return None
    i = next((i for i, x in enumerate(S.ENCODINGS) if re.fullmatch(x[1], body)), None)
    if i is None:
        return None
    alphabet = S.ENCODINGS[i][2]
    if i in (0, 2):
        body = body.lower()
    n, k = len(body), len(alphabet)
    chi = k * sum(body.count(c) ** 2 for c in alphabet) / n - n
    z = max((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)), 0)
    v = [alphabet.index(c) - (k - 1) / 2 for c in body]
    serial = sum(a * b for a, b in zip(v, v[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    runs = (sum((a > 0) != (b > 0) for a, b in zip(v, v[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    t = z * z + serial * serial + runs * runs
    p = max(min(math.erfc(math.sqrt(t / 2)) + math.sqrt(2 * t / math.pi) * math.exp(-t / 2), 1), 1e-300)
    return i * 64 + n.bit_length() - 1, min(math.floor(-math.log10(p) * 20), 399)


def brute(docs, rate):
    cells = {}
    candidates = {}
    for j, (_, t) in enumerate(docs):
        candidates[j] = [(m.start(), m.end(), *x) for m in re.finditer(S.CANDIDATE, t or "") if (x := battery(m[0]))]
        for _, _, stratum, cell in candidates[j]:
            cells.setdefault(stratum, []).append(cell)
    limit = {}
    for stratum, own in cells.items():
        own.sort(reverse=True)
        ranked = [c for c in own if 10 ** (-c / 20) <= rate * sum(x >= c for x in own) / len(own)]
        limit[stratum] = min(ranked, default=400)
    out = {}
    for j, (d, t) in enumerate(docs):
        b = base(t or "")
        more = [(s, 3, e) for s, e, stratum, cell in candidates[j] if cell < limit[stratum] and not any(x <= s and e <= y for x, _, y in b)]
        out[d] = (*(sum(k == i for _, k, _ in b) for i in range(3)), hashlib.sha256(joined(b).encode()).hexdigest(), joined(sorted(b + more)))
    return out


def corpus():
    rnd = random.Random(5)
    pick = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    parts = [
        lambda: "password=" + pick(alnum, rnd.randint(3, 20)), lambda: "API_KEY : '" + pick(alnum, 9), lambda: "Tokenſecret=abcdefg", lambda: "toKen=abcdefgh", lambda: "secret==x" + pick("/+.", 6), lambda: "passwd:" + pick("é", 3),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, rnd.randint(0, 30)), lambda: pick("0123456789abcdef", rnd.randint(10, 70)), lambda: pick(alnum, rnd.randint(18, 90)),
        lambda: pick(alnum + "+/", 44) + "==", lambda: pick("ab", 30) + "1", lambda: "Internationalisierungsbehörde", lambda: "some-long-file-name-with-2024-in-it", lambda: "ABAB1212" * 9, lambda: pick("0123456789", 25), lambda: "日本 wörter ", lambda: pick("ABCDEF0123456789", 40), lambda: "tokentoken=abcdef.password=",
    ]
    docs = [(i, rnd.choice([" ", "", "\n"]).join(rnd.choice(parts)() for _ in range(rnd.randint(0, 9)))) for i in range(250)]
    return docs + [(900, None), (901, ""), (902, "x" * 50_000 + " " + docs[3][1])]


def test_matches_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in S.report(frame).collect()}
    want = brute(docs, 0.05)
    assert got == want
    assert sum("random" in x[-1] for x in want.values()) > 20
    assert S.report(frame.limit(0)).count() == 0
    plan = S.report(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_redaction(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, None if d[1] is None else len(d[1])) for d in docs], "doc_id long, text string, n_chars long")
    spans = {d: x[-1] for d, x in brute(docs, 0.05).items()}
    for r in S.redact(frame, length_col="n_chars").collect():
        t = dict(docs)[r.doc_id]
        want, at = "", 0
        for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[r.doc_id].split(",") if x):
            if s > at or at == 0:
                want += t[at:s] + "[SECRET]"
            at = max(at, e)
        want = None if t is None else want + t[at:]
        assert r.text == want and r.n_chars == (None if t is None else len(want))


def test_false_discovery_cells():
    assert S._first_rejected({0: 10}, 0.05) == 400
    assert S._first_rejected({0: 10, 100: 5}, 0.05) == 100
    assert S._first_rejected({0: 95, 30: 5}, 0.05) == 400


def test_parts_between_signs_and_short_keys(spark):
    rnd = random.Random(9)
    pick = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    key, short, signed = pick(alnum, 40), pick(alnum, 16), pick(alnum, 30) + "-" + pick(alnum, 20)
    texts = [f"get v1/my-app/{key} now", f"id {short} end", f"a/b+{signed}/c", "a-path/of_ordinary/words-in/some_folder", "x " + pick(alnum + "+/", 60) + "=="]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in S.report(frame, parts=True).collect()}
    place = lambda i, x: f"random:{texts[i].index(x)}:{texts[i].index(x) + len(x)}"
    # short words beside a key may not make it too regular, and are then masked with it
    assert got[0] == place(0, "app/" + key) and got[1] == place(1, short) and place(2, signed) in got[2]
    assert got[3] == "" and got[4] == f"random:2:{len(texts[4])}"
    masked = {r.doc_id: r.text for r in S.redact(frame, parts=True).collect()}
    assert masked[0] == "get v1/my-[SECRET] now" and masked[3] == texts[3]
    assert not any(x in masked[2] for x in signed.split("-"))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "token=abcdef123", ["mine"], "x")], "doc_id long, text string, all_spans array<string>, Base_Spans string")
    r = S.redact(docs, parts=True).first()
    assert (r.text, r.all_spans, r.Base_Spans) == ("[SECRET]", ["mine"], "x")


def test_share_of_random_tokens_found(spark):
    rnd = random.Random(5)
    alphabets = {"hex": "0123456789abcdef", "base32": string.ascii_uppercase + "234567", "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
    docs, kinds = [], {}
    for name, letters in alphabets.items():
        for n in (20, 24, 32, 40, 64):
            for _ in range(20):
                kinds[len(docs)] = name
                docs.append((len(docs), f"see {''.join(rnd.choice(letters) for _ in range(n))} here"))
    words = ["Parser", "Node", "Stream", "Factory", "Buffer", "Token", "Reader", "Cache", "Index", "Value"]
    first = len(docs)
    docs += [(first + i, f"class {''.join(rnd.sample(words, 4))} is") for i in range(200)]
    got = {r.doc_id: r.spans for r in S.report(spark.createDataFrame(docs, "doc_id long, text string"), parts=True).collect()}
    for name in alphabets:
        own = [i for i, k in kinds.items() if k == name]
        assert sum(got[i] != "" for i in own) >= 0.9 * len(own)
    assert sum(got[i] != "" for i in range(first, len(docs))) <= 20  # 13 here

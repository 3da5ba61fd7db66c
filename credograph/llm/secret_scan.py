"""Secrets in texts: three fixed patterns, and a battery of randomness tests.

Only DataFrame functions are used. The fixed kinds are found by regular expressions. Besides,
every run of at least ``SHORTEST`` characters that encoders write is a candidate if its
characters suggest an encoding (hexadecimal, base 32, 36, 62 or 64; a word or a number suggests
none). With ``parts``, so are the parts of a run between its signs, as in a path; a part inside a
longer one that is reported isn't reported again. For its encoding three things are tested: that all characters of the alphabet are as
frequent (chi-squared), that runs above and below the middle of the alphabet are as long as
chance makes them, and that neighbours don't correlate. The three statistics are near normal if
the candidate is random; the sum of their squares gives one p-value.

Whether a candidate is too regular is decided with false-discovery control over all candidates
of the same encoding and length class (Benjamini-Hochberg at ``rate``; short ones, with little
power, aren't mixed with long ones). Those not found too regular are reported as kind
``random``. So ``rate`` bounds the share of truly random runs among those passed over as too
regular, not the share of other runs among those reported. The p-values are counted in a fixed number of cells for that, so what is gathered is
bounded: encodings times length classes times cells.

Texts are searched and candidates tested once; what was found is written beside the documents,
read for the counts, and read again for the result. No text is shuffled. Within a text the work grows with its length: places
are running sums, spans inside others are dropped in one sweep over sorted spans, and masks are
put in block by block.

Positions count code points and ends are exclusive. Defined cases: a null text is empty; a
candidate inside a span of a fixed kind is not added; repeated rows count each; an empty table
gives no rows; other columns are ignored, and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credograph.llm.shared import unused, written

#: Kinds in their order, and the patterns of the base.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

SHORTEST = 16
#: A run is looked at from its first character only.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST
#: Besides whole runs, their parts between the signs of one or the other base 64, or of both.
PARTS = tuple(r"(?<![A-Za-z0-9%s])[A-Za-z0-9%s]{%d,}={0,2}" % (signs, signs, SHORTEST) for signs in ("+/", "_-", ""))
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Name, pattern of its texts, alphabet; the first that fits is taken.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?:[a-z0-9]+|[A-Z0-9]+)$", _DIGITS + _LOWER),
    ("base62", r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
_CELLS, _PER_DECADE = 400, 20
#: Items of a list that are folded in one go, and code points of a text that masks are put in at once.
_CHUNK, _BLOCK = 256, 4096


def bound(value: Column, body) -> Column:
    """``body(value)``, with ``value`` made once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, step, make, state: str, kind: str) -> Column:
    """``make(s, x)`` (of type ``kind``) for each item, s (of type ``state``) being ``step`` folded over
    the items before it. Lists grow by copying, so they are folded in chunks."""
    none = lambda t: F.array().cast(f"array<{t}>")
    grown = lambda acc, s, x: F.struct(s.alias("s"), F.concat(acc["o"], F.array(x)).alias("o"))
    begin = lambda s, t: F.struct(s.alias("s"), none(t).alias("o"))
    within = lambda c, s: F.aggregate(c, begin(s, kind), lambda acc, x: grown(acc, step(acc["s"], x), make(acc["s"], x)), lambda acc: acc["o"])
    firsts = lambda cs: F.aggregate(cs, begin(zero, state), lambda acc, c: grown(acc, F.aggregate(c, acc["s"], step), acc["s"]), lambda acc: acc["o"])
    chunks = bound(items, lambda xs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_CHUNK)), lambda i: F.slice(xs, i, _CHUNK)))
    return bound(chunks, lambda cs: F.flatten(F.zip_with(cs, firsts(cs), within)))


_SPANS = "array<struct<s:bigint,e:bigint,v:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Spans (s, e, v) of all matches of ``pattern``, v the text of ``group``. The text between
    matches gives their places."""

    def placed(whole: Column) -> Column:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("m"), value.alias("v"))
        after = lambda p, x: p + F.length(x["gap"]) + F.length(x["m"])
        one = lambda p, x: F.struct((p + F.length(x["gap"])).alias("s"), after(p, x).alias("e"), x["v"].alias("v"))
        return F.when(F.size(whole) == 0, F.array().cast(_SPANS)).otherwise(running(rows, F.lit(0).cast("bigint"), after, one, "bigint", "struct<s:bigint,e:bigint,v:string>"))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _encoding(token: Column) -> Column:
    """Number of the encoding that a token suggests, or null. Letters of one case, capitalised
    words, words joined by signs and plain numbers suggest none."""
    plain = token.rlike(r"^[0-9]+$") | token.rlike(r"^(?:[A-Z]?[a-z]*|[A-Z]+)(?:[+/_-]+(?:[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,4}))*$")
    found = F.lit(None).cast("int")
    for i in range(len(ENCODINGS) - 1, -1, -1):
        found = F.when(token.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(found)
    return F.when(plain, F.lit(None).cast("int")).otherwise(found)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to about 1e-7 (a rational approximation)."""
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return series * F.exp(-x * x)


def _statistic(x: Column) -> Column:
    """The sum of squares of the three statistics of a token (fields n, squares, places, k) under
    evenly drawn characters."""
    n, k = x["n"].cast("double"), x["k"].cast("double")
    uniform = F.greatest((k * x["squares"] / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)), F.lit(0.0))
    zero = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("product"), F.lit(0.0).alias("changes"))

    def add(acc: Column, v: Column) -> Column:
        # places are never 0, so only the first has no place before it
        change = F.when(acc["before"] * v < 0, 1.0).otherwise(0.0)
        return F.struct(v.alias("before"), (acc["product"] + acc["before"] * v).alias("product"), (acc["changes"] + change).alias("changes"))

    def statistic(acc: Column) -> Column:
        serial = acc["product"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
        # with an even alphabet, a change of side is as likely as none
        runs = (acc["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        return serial * serial + runs * runs

    return uniform * uniform + F.aggregate(x["places"], zero, add, statistic)


def _each(items: Column, make) -> Column:
    """``items`` with the fields that ``make`` gives. A step of its own keeps the expression
    small: what later steps use often is made once and named."""
    return F.transform(items, lambda x: F.struct(*[c.alias(name) for name, c in make(x).items()]))


def _tested(spans: Column) -> Column:
    """Candidates with stratum (encoding and length class) and cell of the p-value."""
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    kept = lambda x, *names: {c: x[c] for c in names}
    out = _each(spans, lambda x: kept(x, "s", "e") | {"v": F.regexp_replace(x["v"], "=+$", "")})
    out = F.filter(_each(out, lambda x: kept(x, "s", "e", "v") | {"encoding": _encoding(x["v"])}), lambda x: x["encoding"].isNotNull())
    out = _each(out, lambda x: kept(x, "s", "e", "encoding") | {"v": F.when(x["encoding"].isin(0, 2), F.lower(x["v"])).otherwise(x["v"]), "alphabet": F.get(alphabets, x["encoding"])})
    out = _each(out, lambda x: kept(x, "s", "e", "encoding", "v", "alphabet") | {"n": F.length(x["v"]), "k": F.length(x["alphabet"])})
    places = lambda x: F.transform(F.split(x["v"], "(?!^)(?!$)"), lambda c: F.instr(x["alphabet"], c) - (x["k"] + 1) / 2)
    squares = lambda x: F.aggregate(F.split(x["alphabet"], "(?!^)(?!$)"), F.lit(0.0), lambda a, c: a + F.pow(x["n"] - F.length(F.replace(x["v"], c, F.lit(""))), F.lit(2)))
    out = _each(out, lambda x: kept(x, "s", "e", "encoding", "n", "k") | {"squares": squares(x), "places": places(x)})
    out = _each(out, lambda x: kept(x, "s", "e", "encoding", "n") | {"t": _statistic(x)})
    tail = lambda t: F.greatest(F.least(_erfc(F.sqrt(t / 2)) + F.sqrt(2 * t / 3.141592653589793) * F.exp(-t / 2), F.lit(1.0)), F.lit(1e-300))
    out = _each(out, lambda x: kept(x, "s", "e", "encoding", "n") | {"p": tail(x["t"])})
    cell = lambda x: F.least(F.floor(-F.log10(x["p"]) * _PER_DECADE), F.lit(_CELLS - 1)).cast("int")
    return _each(out, lambda x: kept(x, "s", "e") | {"stratum": x["encoding"] * 64 + F.floor(F.log2(x["n"])).cast("int"), "cell": cell(x)})


def _candidates(text: Column, parts: bool) -> Column:
    """Runs, and with ``parts`` what lies between their signs. A part between signs of one kind
    that has none of the other is one between signs of both, and is taken as such only."""
    if not parts:
        return located(text, CANDIDATE)
    none = F.array().cast(_SPANS)

    def inside(x: Column) -> Column:
        plus, dash = x["v"].rlike("[+/]"), x["v"].rlike("[_-]")
        signed = lambda pattern, own: F.when(plus & dash, F.filter(located(x["v"], pattern), lambda y: y["v"].rlike(own))).otherwise(none)
        found = F.concat(signed(PARTS[0], "[+/]"), signed(PARTS[1], "[_-]"), F.when(plus | dash, located(x["v"], PARTS[2])).otherwise(none))
        return F.transform(found, lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"), y["v"].alias("v")))

    return bound(located(text, CANDIDATE), lambda runs: F.concat(runs, F.flatten(F.transform(F.filter(runs, lambda x: x["v"].rlike("[+/_-]")), inside))))


def thresholds(found: DataFrame, tested_col: str, rate: float) -> dict[int, int]:
    """By stratum, the first cell whose candidates are too regular."""
    candidates = found.select(F.explode(tested_col).alias("x"))
    table: dict[int, dict[int, int]] = {}
    for stratum, cell, n in candidates.groupBy("x.stratum", "x.cell").agg(F.count("*").alias("n")).collect():
        table.setdefault(stratum, {})[cell] = n
    return {stratum: _first_rejected(cells, rate) for stratum, cells in table.items()}


def _first_rejected(cells: dict[int, int], rate: float) -> int:
    """Benjamini-Hochberg on cells: a cell's p-values count as its largest, 10^(-cell / 20)."""
    total, rank, first = sum(cells.values()), 0, _CELLS
    for cell in sorted(cells, reverse=True):
        rank += cells[cell]
        if 10 ** (-cell / _PER_DECADE) <= rate * rank / total:
            first = cell
    return first


def spans(docs: DataFrame, text_col: str = "text", rate: float = 0.05, parts: bool = False, keep_text: bool = True) -> tuple[DataFrame, str, str]:
    """All columns of ``docs`` (the text only with ``keep_text``) with two more: arrays of
    (s, kind number, e) in order, of the fixed kinds and of all kinds; and their names."""
    base_col, tested_col, spans_col = unused(docs.columns, "base_spans", "tested_spans", "all_spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with_kind = lambda found, kind: F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))
    assign = F.filter(located(text, ASSIGN, 1), lambda x: F.length(x["v"]) >= 6)
    base = F.array_sort(F.concat(with_kind(assign, 0), with_kind(located(text, ACCESS), 1), with_kind(located(text, HEX), 2)))
    own = docs.withColumns({base_col: base, tested_col: _tested(_candidates(text, parts))})
    out = written(own if keep_text else own.drop(text_col), "secret-spans")
    first = thresholds(out, tested_col, rate)
    if not first:
        return out.withColumn(spans_col, F.col(base_col)).drop(tested_col), base_col, spans_col
    limits = F.create_map(*[F.lit(int(x)) for pair in first.items() for x in pair])
    accepted = F.filter(tested_col, lambda x: x["cell"] < F.element_at(limits, x["stratum"]))
    return out.withColumn(spans_col, bound(accepted, lambda a: F.when(F.size(a) == 0, F.col(base_col)).otherwise(_outermost(F.col(base_col), a)))).drop(tested_col), base_col, spans_col


def _outermost(base: Column, accepted: Column) -> Column:
    """``base`` and those of ``accepted`` that lie in no other span, in order: sorted by start, longer
    ones first, a span lies in another if one before it ends there or later."""
    rows = lambda found, kind: F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), kind(x).alias("k")))
    swept = running(
        F.array_sort(F.concat(rows(base, lambda x: x["k"]), rows(accepted, lambda x: F.lit(3)))), F.lit(0).cast("bigint"), lambda e, x: F.greatest(e, -x["ne"]),
        lambda e, x: F.struct(x["s"].alias("s"), x["k"].alias("k"), (-x["ne"]).alias("e"), ((x["k"] == 3) & (e >= -x["ne"])).alias("inner")), "bigint", "struct<s:bigint,k:int,e:bigint,inner:boolean>",
    )
    return F.array_sort(F.transform(F.filter(swept, lambda x: ~x["inner"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))


def _joined(found: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05, parts: bool = False) -> DataFrame:
    """One row for each document: counts of the fixed kinds, a digest of their spans, all spans."""
    found, base_col, spans_col = spans(docs.select(F.col(id_col), F.col(text_col)), text_col, rate, parts, keep_text=False)
    count = lambda kind: F.size(F.filter(base_col, lambda x: x["k"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select(id_col, count(0), count(1), count(2), F.sha2(_joined(base_col), 256).alias("base_sha256"), _joined(spans_col).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", rate: float = 0.05, mask: str = "[SECRET]", length_col: str | None = None, parts: bool = False) -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; ``length_col``, if there, is set anew."""
    names = docs.columns
    found, _, spans_col = spans(docs, text_col, rate, parts)
    (clean_col,) = unused(found.columns, "clean_text")
    text, own = F.col(text_col), F.col(spans_col)
    clean = F.when(F.size(own) == 0, text).otherwise(_masked(text, own, mask))
    out = found.withColumn(clean_col, clean)
    change = lambda c: F.col(clean_col).alias(c) if c == text_col else F.when(F.size(spans_col) > 0, F.length(clean_col).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == length_col else F.col(c)
    return out.select(*[change(c) for c in names])


def _masked(text: Column, found: Column, mask: str) -> Column:
    """``text`` with ``mask`` for each of the spans; overlapping and touching ones make one mask."""
    # what stays before each span, and whether a mask begins there
    fresh = lambda p, x: (x["s"] >= p) & ((x["s"] > p) | (p == 0))
    before = running(found, F.lit(0).cast("bigint"), lambda p, x: F.greatest(p, x["e"]), lambda p, x: F.struct(p.alias("lo"), x["s"].alias("hi"), fresh(p, x).alias("mask")), "bigint", "struct<lo:bigint,hi:bigint,mask:boolean>")
    tail = F.struct(F.array_max(F.transform(found, lambda x: x["e"])).alias("lo"), F.length(text).cast("bigint").alias("hi"), F.lit(False).alias("mask"))

    def block(kept: Column, c: Column, i: Column) -> Column:
        start = i.cast("bigint") * _BLOCK
        here = F.filter(kept, lambda g: ((g["hi"] > g["lo"]) & (g["lo"] < start + _BLOCK) & (g["hi"] > start)) | (g["mask"] & (g["hi"] >= start) & (g["hi"] < start + _BLOCK)))
        low, high = lambda g: F.greatest(g["lo"], start) - start, lambda g: F.least(g["hi"], start + _BLOCK) - start
        piece = lambda g: F.when(high(g) > low(g), F.substring(c, (low(g) + 1).cast("int"), (high(g) - low(g)).cast("int"))).otherwise("")
        return F.array_join(F.transform(here, lambda g: F.concat(piece(g), F.when(g["mask"] & (g["hi"] >= start) & (g["hi"] < start + _BLOCK), mask).otherwise(""))), "")

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))
    return bound(F.concat(before, F.array(tail)), lambda kept: F.array_join(F.transform(blocks, lambda c, i: block(kept, c, i)), ""))

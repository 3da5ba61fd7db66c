import hashlib
import itertools
import random
import re

import duckdb
import pandas as pd

from credograph.llm import conversation_repair as R, queries as Q

BLANK = " \t\n\x0b\x0c\r"
KINDS = "conv_id long, turn long, role string, text string, conv string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def ordered(rows):
    return sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = text.strip(BLANK)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """By every string of edits, for few rows: all audits with inserts, in order of cost."""
    rows = ordered(rows)
    told = faults(rows)
    best = None
    for n_inserts in range(0, 5):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(t in ("blank", "duplicate") and e != "D" for t, e in zip(told, edits)):
                continue
            cost = 5 * n_inserts + sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (t == "truncated" and e != "D") for t, e in zip(told, edits))
            if best is not None and cost > best[0]:
                continue
            for gaps in itertools.combinations_with_replacement(range(len(rows) + 1), n_inserts):
                audit, items = "", []
                for i in range(len(rows) + 1):
                    for _ in range(gaps.count(i)):
                        audit += "I"
                        items.append((None, ""))
                    if i < len(rows):
                        audit += edits[i]
                        if edits[i] != "D":
                            items.append((rows[i][1] if edits[i] == "K" else None, rows[i][2]))
                # the grammar leaves one role to a reroled or inserted turn
                roles = []
                for r, _ in items:
                    roles.append(r if r is not None else "assistant" if roles and roles[-1][:1] == "u" else "user")
                if all(roles):
                    if GRAMMAR.fullmatch("".join(r[:1] for r in roles)) and (best is None or (cost, audit) < best[:2]):
                        best = (cost, audit, "\n".join(f"{r}:{x}" for r, (_, x) in zip(roles, items)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(told.count(x) for x in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def corpus(n=150, most=5):
    rnd = random.Random(6)
    role = lambda: rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
    text = lambda: rnd.choice(["Yes.", "No!", "Why? \n", "cut", "", " \t", None, f"{rnd.random()}."])
    rows = [(c, rnd.choice([None, rnd.randrange(9)]), role(), text()) for c in range(n) for _ in range(rnd.randint(1, most))]
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, 1, "assistant", "Ho.")]


def grouped(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


def test_matches_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x") for r in rows], KINDS).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in R.report(frame).collect()}
    assert got == {c: brute(x) for c, x in grouped(rows).items()}
    assert len({x[6] for x in got.values()}) > 30
    assert R.report(frame.limit(0)).count() == 0 and R.repaired(frame.limit(0)).count() == 0


def test_repaired_rows_agree_with_the_report(spark):
    rows = corpus(80, 30) + [(700, t, ("user", "assistant", "assistant")[t % 3], f"Turn {t}{'.' if t % 5 else ''}") for t in range(5000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], KINDS)
    made = {}
    for r in R.repaired(frame).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(r)
    for r in R.report(frame).collect():
        own = made[r.conv_id]
        kept = [x for x in own if x.edit != "D"]
        assert [x.place for x in own] == list(range(len(own))) and "".join(x.edit for x in own) == r.audit
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in kept).encode()).hexdigest() == r.repaired_sha256
        assert GRAMMAR.fullmatch("".join(x.role[:1] for x in kept))


def test_long_conversations_hold_a_short_end_of_the_audit():
    held, made = 0, []
    walk = R.Walk(lambda *x: made.append(x))
    for t in range(20_000):
        walk.row("assistant" if t % 2 else "user", f"{t}.", None)
        held = max(held, len(walk.rows))
    assert walk.end() == 0 and len(made) == 20_000 and held < 200


def test_query_matches_sql(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in corpus(400, 8)] + [(5000 + c, t, "user", "only") for c in range(60) for t in range(1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], KINDS)
    frame.write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = Q.op13_conversation_repair(spark, f"file://{tmp_path}")
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    key = lambda r: [(x is None, x) for x in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(duckdb.sql(R.SQL).fetchall(), key=key)
    assert got.filter("audit = ''").count() > 3

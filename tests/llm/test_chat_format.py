import hashlib
import random
import re

import duckdb
import pandas as pd

from credograph.llm import chat_format as C

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", " ", "\n", "é", "😀", "ok", "s>", "INST]", "$1"]


def corpus():
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "assistant", text(), None]), rnd.choice([text(), text(), None])) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (900, None, "user", "first"), (900, 0, "assistant", "x"), (900, 0, "assistant", "x"), (900, 0, "assistant", "a")]
    rows += [(901, t, "assistant" if t % 2 else "user", "word " * 50 + str(t)) for t in range(300)] + [(902, 0, "assistant", "long " * 50_000)]
    return rows


def brute(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digest_equals_brute_force_and_sql(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, turns int").repartition(3)
    found = C.digest(C.examples(frame))
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().toString())
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert {c: x[:4] for c, x in got.items()} == brute(rows)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(C.SQL).fetchall() if r[0] != -1}
    assert got == want
    assert C.digest(C.examples(frame.limit(0))).count() == 0


def test_examples_hold_all_before_and_train_the_reply_only(spark):
    turns = [(1, 0, "system", "be </s> kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "[INST] no"), (1, 3, "user", "why"), (1, 4, "assistant", "\\so"), (1, 5, "user", "bye"), (2, 0, "user", "alone")]
    made = C.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.example, r.last) for r in made] == [(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, True)]
    assert [r.text[r.start : r.end] for r in made] == ["[\\INST] no", "\\\\so", "", ""]
    assert made[0].text == "<s>[INST] system [/INST] be <\\/s> kind</s><s>[INST] user [/INST] hi</s><s>[INST] assistant [/INST] [\\INST] no</s>"
    assert made[1].text.startswith(made[0].text) and made[2].text.startswith(made[1].text)
    assert [r.text.count("</s>") for r in made] == [3, 5, 6, 1]


def test_escaping_is_exact_and_hides_control_strings(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 15))) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", C.escape(frame.t).alias("e"), C.unescape(C.escape(frame.t)).alias("back")).collect():
        assert r.back == r.t and not any(c in r.e for c in C.CONTROL)

"""Conversations as training examples, one for each reply.

Only DataFrame functions are used. Every assistant turn becomes an example of its own: all turns
before it are the context, and only its text is trainable. What follows the last reply, or all of
a conversation without one, is a last example with nothing trainable, so that no turn is lost.

A turn is written ``<s>[INST] role [/INST] text</s>``. In roles and texts a backslash is doubled
and a backslash is put after the first character of each control string, so that none of them
appears inside and the way back is exact. How a turn is written doesn't depend on its neighbours.

The turns are shuffled once; examples are made row by row where they are read. Together the
examples of a conversation grow with the square of its turns: that is what the method makes. One
conversation is one row, as its hash is sequential.

Defined cases: a null role or text is empty; turns are ordered by number (nulls first), equal ones
by role, then text; repeated rows are turns of their own; the null id is a conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
REPLY_ROLE = "assistant"


def escape(text: Column) -> Column:
    """``text`` without control strings."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def written_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each example: the id, ``example`` (from 0), whether it is the ``last``,
    ``text`` (context and reply as they are written), and the trainable span of it, ``start`` and
    ``end`` in code points, end exclusive; both are 0 if nothing is trainable."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    talks = own.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    talks = talks.select(
        "conv", F.transform("turns", lambda x: written_turn(x["role"], x["text"])).alias("pieces"),
        # the place of each reply, from 1; a last turn that is no reply ends the last example
        F.filter(F.transform("turns", lambda x, i: F.when((x["role"] == REPLY_ROLE) | (i == F.size("turns") - 1), i + 1)), lambda i: i.isNotNull()).alias("ends"),
        F.when(F.element_at("turns", -1)["role"] != REPLY_ROLE, F.size("turns")).otherwise(0).alias("rest"),
    )
    rows = talks.select("conv", "pieces", "rest", F.size("ends").alias("n"), F.posexplode("ends").alias("example", "at"))
    rows = rows.select("conv", "example", (F.col("example") == F.col("n") - 1).alias("last"), (F.col("at") != F.col("rest")).alias("reply"),
                       F.array_join(F.slice("pieces", 1, F.col("at") - 1), "").alias("context"), F.get("pieces", F.col("at") - 1).alias("piece"))
    before = F.length("context") + len(OPEN) + len(REPLY_ROLE) + len(MIDDLE)
    end = F.length("context") + F.length("piece") - len(CLOSE)
    place = lambda x: F.when(F.col("reply"), x).otherwise(0).cast("long")
    return rows.select(F.col("conv").alias(id_col), "example", "last", F.concat("context", "piece").alias("text"), place(before).alias("start"), place(end).alias("end"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) that an example was written from."""
    bodies = F.split(text, CLOSE, -1)
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)
    middle = lambda x: F.instr(x, F.lit(MIDDLE.strip()))
    role = lambda x: F.substring(x, F.lit(len(OPEN) + 1), middle(x) - len(OPEN) - 2)
    body = lambda x: F.substring(x, middle(x) + len(MIDDLE) - 1, F.length(x))
    return F.transform(bodies, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(body(x)).alias("text")))


def digest(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from ``examples``: for each conversation its turns and their hash, the
    trainable text of all examples in order and its hash, and the code points of all examples."""
    all_turns = F.when(F.col("last"), read_turns(F.col("text")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    reply = unescape(F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")))
    read = made.select(id_col, "example", F.length("text").cast("long").alias("chars"), reply.alias("reply"), all_turns.alias("turns"))
    read = read.select(id_col, "example", "chars", "reply", F.size("turns").cast("long").alias("n"), F.sha2(said, 256).alias("sha"))
    ordered = F.array_sort(F.collect_list(F.struct("example", "reply")))
    found = read.groupBy(id_col).agg(F.max(F.when(F.col("sha").isNotNull(), F.col("n"))).alias("n_turns"), F.max("sha").alias("turns_sha256"), ordered.alias("replies"), F.sum("chars").alias("formatted_chars"))
    found = found.withColumn("loss", F.array_join(F.transform("replies", lambda x: x["reply"]), ""))
    return found.select(id_col, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The digest over ``conversations`` and conversation -1 in DuckDB's SQL.
SQL = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
sized AS (
  SELECT *, length(role) + length(text) + 23 + list_sum(list_transform(['\', '<s>', '</s>', '[INST]', '[/INST]'],
      lambda c: len(string_split(role, c)) + len(string_split(text, c)) - 2)) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM own),
ended AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized),
told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, sum(upto) FILTER (role = 'assistant' OR k = n)::bigint AS formatted_chars
  FROM ended GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM told"""

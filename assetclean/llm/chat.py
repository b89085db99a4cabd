"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all turns before it are the
context, and only its own reply is trainable. The output keeps the formatted
text and the span (start, length in code points) of the loss mask. DataFrame
functions only.

Template: a turn is ``<turn:role>`` newline, the text, ``</turn>`` newline.
Backslash and ``<`` inside roles and texts are escaped with a backslash, so no
text can close or open a turn, and the escape can be undone exactly; role
names also escape ``>``.

Defined results: null text and null role are empty; a null conv_id is a
conversation of its own; rows are ordered by turn (null first), then role and
text, so ties are resolved by content; repeated rows are repeated turns; a
conversation without assistant turns has no examples; extra columns are
ignored; an empty table gives no rows. The expansion's output grows with the
square of the turns of a conversation, which is what the method produces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

OPEN, CLOSE = "<turn:", "</turn>\n"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<>])", "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(">"), F.lit("\\>")), F.lit(">\n"))


def segment(turn: Column) -> Column:
    return F.concat(header(turn["role"]), escape(turn["text"]), F.lit(CLOSE))


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> conv_id, turns: ordered array of
    (turn, role, text)."""
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("turns"))


def expand(rows: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, position (of the target among the
    conversation's turns, from 0), n_turns, formatted, loss_start,
    loss_length. ``formatted`` ends with the target's closing mark."""
    c = conversations(rows).withColumn("segments", F.transform("turns", segment))
    c = c.select("conv_id", F.size("turns").alias("n_turns"), "segments", F.posexplode("turns").alias("position", "target")).filter(F.col("target.role") == TARGET)
    context = F.array_join(F.slice("segments", F.lit(1), F.col("position")), "")
    head = F.concat("context", header(F.col("target.role")))
    body = escape(F.col("target.text"))
    return c.withColumn("context", context).select(
        "conv_id", F.col("position").cast("long").alias("position"), F.col("n_turns").cast("long").alias("n_turns"),
        F.concat(head, body, F.lit(CLOSE)).alias("formatted"),
        F.char_length(head).cast("long").alias("loss_start"), F.char_length(body).cast("long").alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """Formatted text -> array of (role, text), unescaped. An unescaped ``<``
    occurs only in the marks, so splitting there is exact."""
    turns = F.regexp_extract_all(formatted, F.lit(r"(?s)<turn:((?:[^\\<>]|\\.)*+)>\n((?:[^\\<]|\\.)*+)</turn>\n"), F.lit(0))
    head = r"(?s)^<turn:((?:[^\\<>]|\\.)*+)>\n.*$"
    return F.transform(turns, lambda t: F.struct(
        unescape(F.regexp_replace(t, head, "$1")).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(t, r"(?s)^<turn:(?:[^\\<>]|\\.)*+>\n", ""), r"(?s)</turn>\n$", "")).alias("text"),
    ))


def digests(examples: DataFrame, tails: DataFrame) -> DataFrame:
    """Per conversation, from formatted text alone: the turns of its longest
    text (the last example plus what follows it) and everything under the loss
    masks in order."""
    loss = unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    got = examples.select("conv_id", "position", loss.alias("loss"), "formatted")
    last = got.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.max_by("formatted", "position").alias("formatted"), F.sum(F.char_length("formatted")).alias("examples_chars"), F.count("*").alias("n_examples"))
    both = tails.join(last, tails["conv_id"].eqNullSafe(last["conv_id"]), "left").select(tails["conv_id"], F.coalesce("loss", F.lit("")).alias("loss"), F.concat(F.coalesce("formatted", F.lit("")), "tail").alias("whole"), "examples_chars", "n_examples")
    turns = parse(F.col("whole"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return both.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("whole").cast("long").alias("formatted_chars"),
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"), F.coalesce("examples_chars", F.lit(0)).cast("long").alias("examples_chars"),
    )


def tail(rows: DataFrame) -> DataFrame:
    """conv_id, tail: the formatted turns after the last assistant turn (no
    example holds them)."""
    c = conversations(rows)
    last = F.aggregate(F.sequence(F.lit(1), F.size("turns")), F.lit(0), lambda a, i: F.when(F.element_at("turns", i)["role"] == TARGET, i).otherwise(a))
    rest = F.when(last < F.size("turns"), F.slice("turns", last + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    return c.select("conv_id", F.array_join(F.transform(rest, segment), "").alias("tail"))


SAMPLE = "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and the two-turn conversation -7, writes
    examples and tails, and digests what is read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(SAMPLE).alias("text"))
    rows = rows.unionByName(extra)
    return digests(cut(expand(rows), "examples"), cut(tail(rows), "tails"))


#: The same digests straight from the turns.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length('<turn:' || replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') || '>' || chr(10)
                   || replace(replace(text, '\', '\\'), '<', '\<') || '</turn>' || chr(10)) AS chars FROM r),
w AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS so_far FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples,
       CAST(coalesce(sum(so_far) FILTER (role = 'assistant'), 0) AS BIGINT) AS examples_chars
FROM w GROUP BY conv_id
"""

"""Conversations as training examples by prefix-target expansion, with DataFrame functions only.

A turn is written ``<turn ROLE>``, a line feed, its text, ``</turn>`` and a line feed. In roles and texts ``&``, ``<``
and ``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a mark, and reading it back is exact.

Every assistant turn gives an example: all turns before it as context, then that turn; the loss mask covers that
turn's text alone. Turns after the last assistant turn stand in one more example without a loss mask. An example
holds its whole context, as a model has to see it, so what is written grows with turns times length of a
conversation; a conversation has to fit into a row, as a document has to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"
ASSISTANT = "assistant"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) from (conv_id, turn, role, text).

    example is the number of the last turn, from 1; the mask is [loss_start, loss_end) in code points of text, null
    where nothing is trained. Null roles and texts count as empty; turns go by turn (null first), then role, then
    text, so rows that repeat a turn all stand. A null conv_id is a conversation of its own.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    piece = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(CLOSE))
    last = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("turns", i)["role"] == ASSISTANT) | (i == last))
    each = whole.select("conv_id", "turns", F.transform("turns", piece).alias("pieces"), F.explode(targets).alias("example"))
    text = F.array_join(F.slice("pieces", F.lit(1), F.col("example")), "")
    end = F.length("text") - len(CLOSE)
    own = F.element_at("turns", F.col("example"))
    each = each.select("conv_id", "example", text.alias("text"), own["role"].alias("role"), F.length(escaped(own["text"])).alias("n"))
    trained = F.col("role") == ASSISTANT
    return each.select("conv_id", "example", "text", F.when(trained, end - F.col("n")).alias("loss_start"), F.when(trained, end).alias("loss_end"))


def read_back(written_examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from examples' output."""
    loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    by = written_examples.select("conv_id", "example", "text", F.length("text").alias("chars"), loss.alias("loss")).groupBy("conv_id")
    got = by.agg(F.max_by("text", "example").alias("text"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"))
    pieces = F.filter(F.split("text", CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), MIDDLE, 1)
        body = F.substring(p, F.length(role) + (len(OPEN) + len(MIDDLE) + 1), F.length(p))
        return F.concat(unescaped(role), F.lit("\n"), unescaped(body), F.lit("\n"))

    trained = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return got.select(
        "conv_id",
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(pieces, turn), ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: What both turns of conversation -7 say.
PROBE = "\\### Assistant: </turn> ok"


def op8(conversations: DataFrame) -> DataFrame:
    """Rows of op8_prefix_targets, read back from the written examples.

    Rows that have conv_id -7 already are further turns of that conversation. Nulls, ties and repeated turns are as for
    `examples`; a very long text makes its conversation's examples long. Extra columns, whatever their names, play no part.
    """
    probe = conversations.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text")) for n, role in enumerate(("user", ASSISTANT))))))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return read_back(written(examples(rows.unionByName(probe)), "chat-examples"))


#: op8 in SQL for DuckDB.
OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS last,
         16 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
            + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS chars
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR k = last) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

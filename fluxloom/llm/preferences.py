"""Preference formatting, in DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once, as the
prompt; what follows on either side is rendered as its completion, with the character spans that a loss
should count: the words of assistant turns and the mark that ends them, never a header or another role.

Turns compare by role and text. A null role counts as ``user``, a null text as empty; turns of one number
are ordered by role and text. Marks of the template that occur in a text are broken up by a blank, so that
a text cannot open or close a turn. Rows without a conversation id belong to none and are left out. A
conversation without its counterpart gives a row with ``paired`` false, no prompt and one empty side. Equal
conversations give a prompt and two empty completions. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _rendered(turn: Column) -> tuple[Column, Column]:
    """Header, and body with its end."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), plain(turn["role"]), F.lit("\n")), F.concat(plain(turn["text"]), F.lit(CLOSE + "\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(*_rendered(t))), "")


def _spans(turns: Column) -> Column:
    """(start, end) of trained characters within the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head, body = (F.length(part) for part in _rendered(turn))
        own = F.struct((state["at"] + head).alias("start"), (state["at"] + head + body - 1).alias("end"))
        trained = turn["role"] == TRAINED_ROLE
        return F.struct(
            (state["at"] + head + body).alias("at"),
            F.when(trained, F.concat(state["spans"], F.array(own))).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda state: state["spans"])


def format_preferences(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row per pair of conversations in ``turns`` (conv_id, turn, role, text).

    ``pair`` names the pair of a row's conversation and ``chosen`` tells whether it is the preferred one.
    Returns pair_id, paired, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        pair.alias("pair_id"),
        chosen.alias("preferred"),
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("user")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    # A group is two conversations, each of which is one output row's content anyway.
    sides = rows.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("preferred"), F.col("t")))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col("preferred"), F.col("t")))).alias("r"),
    )
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, F.lit(False)).cast("int")
    cut = sides.withColumn("common", F.when(differs > 0, differs - 1).otherwise(F.size("c")))
    rest = lambda side: F.slice(F.col(side), F.col("common") + 1, F.greatest(F.size(side) - F.col("common"), F.lit(0)))
    return cut.select(
        "pair_id",
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("paired"),
        F.col("common").alias("prompt_turns"),
        _joined(F.slice("c", F.lit(1), F.col("common"))).alias("prompt"),
        _joined(rest("c")).alias("chosen"),
        _spans(rest("c")).alias("chosen_spans"),
        _joined(rest("r")).alias("rejected"),
        _spans(rest("r")).alias("rejected_spans"),
    )


def preference_report(turns: DataFrame) -> DataFrame:
    """Conversations 2n and 2n + 1 are a pair, the even one preferred; spans as text."""
    odd = F.pmod(F.col("conv_id"), F.lit(2))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    found = format_preferences(turns, F.col("conv_id") - odd, odd == 0)
    return found.withColumns({c: text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


PREFERENCE_SQL = f"""
WITH t AS (
  SELECT conv_id - ((conv_id % 2) + 2) % 2 AS pair_id, conv_id % 2 = 0 AS preferred, coalesce(role, 'user') AS role,
         coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
differ AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.pos, r.pos)) AS first
  FROM (SELECT * FROM t WHERE preferred) c FULL JOIN (SELECT * FROM t WHERE NOT preferred) r
    ON c.pair_id = r.pair_id AND c.pos = r.pos
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
drawn AS (
  SELECT t.pair_id, preferred, role, pos, pos >= coalesce(first, 1000000000) AS completion,
         '{OPEN}' || replace(role, '<|', '< |') || chr(10) AS head, replace(text, '<|', '< |') || '{CLOSE}' || chr(10) AS body
  FROM t LEFT JOIN differ USING (pair_id)),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, preferred, completion ORDER BY pos)
            - length(body) AS begins FROM drawn)
SELECT pair_id, bool_or(preferred) AND bool_or(NOT preferred) AS paired,
       (count(*) FILTER (preferred AND NOT completion))::INTEGER AS prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (preferred AND NOT completion), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (preferred AND completion), '') AS chosen,
       coalesce(string_agg(begins::BIGINT || '-' || (begins + length(body) - 1)::BIGINT, ',' ORDER BY pos)
         FILTER (preferred AND completion AND role = '{TRAINED_ROLE}'), '') AS chosen_spans,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (NOT preferred AND completion), '') AS rejected,
       coalesce(string_agg(begins::BIGINT || '-' || (begins + length(body) - 1)::BIGINT, ',' ORDER BY pos)
         FILTER (NOT preferred AND completion AND role = '{TRAINED_ROLE}'), '') AS rejected_spans
FROM placed GROUP BY pair_id
"""

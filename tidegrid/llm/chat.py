"""Preference formatting: the turns that two conversations share are the prompt, what follows are the completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN = "struct<role:string,text:string>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, *by: str) -> DataFrame:
    """``<by>, conv_id, turns array<struct<role, text>>`` in turn order, ties by role and text.

    One row of the result is one conversation. A null role is ``unknown``, a null
    text empty, a null turn comes first; rows without conv_id are left out.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(*by, F.col("conv_id").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    listed = rows.groupBy(*by, "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select(*by, "conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, n.cast("long"))


def head_of(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head_of(t), t["text"], F.lit(f"{CLOSE}\n"))), "")


def trained(turns: Column) -> Column:
    """``array<struct<start, end>>``: code points of the rendered turns that count for the loss: what an assistant says, with its end mark."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(head_of(t))
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda s: s["spans"])


def preference_format(pairs: DataFrame) -> DataFrame:
    """Adds ``n_prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask`` to rows with ``chosen`` and ``rejected`` turns.

    A null side counts as no turns. If one conversation begins with the whole of
    the other, that one's completion is empty. Narrow: no shuffle.
    """
    side = lambda c: F.coalesce(F.col(c), F.array().cast(f"array<{TURN}>"))
    n = common_turns(side("chosen"), side("rejected")).cast("int")
    cut = pairs.withColumn("n_prompt_turns", n.cast("long"))
    after = lambda c: F.slice(side(c), F.col("n_prompt_turns").cast("int") + 1, F.greatest(F.size(side(c)), F.lit(1)))
    return cut.select(
        *pairs.columns, "n_prompt_turns", render(F.slice(side("chosen"), F.lit(1), F.col("n_prompt_turns").cast("int"))).alias("prompt"),
        *(x for c in ("chosen", "rejected") for x in (render(after(c)).alias(f"{c}_text"), trained(after(c)).alias(f"{c}_mask"))),
    )


def answer_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, other_id, chosen, rejected``: each conversation up to its last answer, and with the answer that its neighbour got instead.

    Conversations 2k and 2k + 1 are neighbours. An answer is an assistant's turn.
    Without a neighbour that has one, the rejected side ends before the answer; a
    conversation without an answer stands whole on both sides. One shuffle of the
    turns, by pair; a conversation becomes one row, so its turns meet in one task.
    """
    near = turns.where(F.col("conv_id").isNotNull()).select(F.floor(F.col("conv_id") / 2).alias("pair_id"), "conv_id", "turn", "role", "text").repartition("pair_id")
    listed = conversations(near, "pair_id").withColumn("last", F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant").cast("int") + 1)
    has = F.col("last") <= F.size("turns")
    cut = listed.select("pair_id", "conv_id", F.when(has, F.slice("turns", F.lit(1), F.col("last"))).otherwise(F.col("turns")).alias("chosen"), F.when(has, F.col("last")).alias("last"))
    cut = cut.withColumn("answer", F.when(F.col("last").isNotNull(), F.element_at("chosen", -1)))
    both = cut.groupBy("pair_id").agg(F.collect_list(F.struct("conv_id", "chosen", "last", "answer")).alias("own"))
    each = both.select(F.explode("own").alias("c"), "own").withColumn("other", F.get(F.filter("own", lambda x: x["conv_id"] != F.col("c.conv_id")), F.lit(0)))
    before = F.slice("c.chosen", F.lit(1), F.col("c.last") - 1)
    instead = F.when(F.col("other.answer").isNotNull(), F.array("other.answer")).otherwise(F.array().cast(f"array<{TURN}>"))
    rejected = F.when(F.col("c.last").isNull(), F.col("c.chosen")).otherwise(F.concat(before, instead))
    return each.select("c.conv_id", F.col("other.conv_id").alias("other_id"), "c.chosen", rejected.alias("rejected"))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference for each conversation of ``conversations``: its own last answer over its neighbour's.

    Repeated turns count as often as they stand; null roles are ``unknown``, null
    texts empty, null turns come first; rows without conv_id are left out. An
    empty table gives no rows.
    """
    made = preference_format(answer_pairs(table(spark, sf_dir, "conversations")))
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(c)
    return made.select("conv_id", "other_id", "n_prompt_turns", "prompt", "chosen_text", mask("chosen_mask"), "rejected_text", mask("rejected_mask"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body FROM t),
c AS (SELECT conv_id, count(*) AS size, max(i) FILTER (WHERE role = 'assistant') AS last FROM n GROUP BY 1),
a AS (SELECT conv_id, last, text AS answer, head, body FROM c JOIN n USING (conv_id) WHERE i = last),
p AS (SELECT c.conv_id, other.conv_id AS other_id, c.last, mine.head, mine.body, b.head AS other_head, b.body AS other_body,
    CASE WHEN c.last IS NULL THEN c.size WHEN mine.answer = b.answer THEN c.last ELSE c.last - 1 END AS np
  FROM c LEFT JOIN a mine USING (conv_id)
    LEFT JOIN c other ON other.conv_id // 2 = c.conv_id // 2 AND other.conv_id <> c.conv_id
    LEFT JOIN a b ON b.conv_id = other.conv_id),
r AS (SELECT p.conv_id, string_agg(n.head || n.body || chr(10), '' ORDER BY i) AS prompt FROM p JOIN n ON n.conv_id = p.conv_id AND n.i <= np GROUP BY 1)
SELECT p.conv_id, other_id, CAST(np AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  CASE WHEN np < last THEN head || body || chr(10) ELSE '' END AS chosen_text,
  CASE WHEN np < last THEN length(head) || ':' || length(head || body) ELSE '' END AS chosen_mask,
  CASE WHEN np < last AND other_body IS NOT NULL THEN other_head || other_body || chr(10) ELSE '' END AS rejected_text,
  CASE WHEN np < last AND other_body IS NOT NULL THEN length(other_head) || ':' || length(other_head || other_body) ELSE '' END AS rejected_mask
FROM p LEFT JOIN r USING (conv_id)
"""

"""Preference formatting: a chosen and a rejected conversation share the prompt up to their first difference.

The longest common prefix of turns is rendered once as prompt; what follows is rendered for either side, and only the
assistant's turns carry loss. One row is one rendered turn: a conversation of any length spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(value: Column) -> Column:
    """Control marks inside a text are broken up, so a text cannot open or close a turn."""
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def render(role: Column, text: Column) -> Column:
    role = F.coalesce(role, F.lit("unknown"))
    return F.concat(F.lit(OPEN), _safe(role), F.lit("\n"), _safe(text), F.lit(CLOSE + "\n"))


def turns(df: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """(pair, turn, role, text), one row per turn: of repeated turns the one with the smallest (role, text); a null turn comes first."""
    rows = df.select(F.col(pair).alias("pair"), F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    one = rows.groupBy("pair", "turn").agg(F.min(F.struct(
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )).alias("t"))
    return one.select("pair", "turn", "t.role", "t.text")


def prefer(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(pair_id, part, turn, rendered, loss): the turns of ``prompt``, ``chosen`` and ``rejected`` in order of ``turn``.

    Turns are compared by number, role and text; the prompt ends before the first that differs or that one side lacks. Equal
    conversations are all prompt. Loss is true for the assistant's turns after the prompt. Null roles count as ``unknown``, null texts as
    empty, a null pair id as a pair of its own; of repeated turns one stays (see ``turns``). A pair that only one side has gets
    an empty prompt. Further columns are ignored and an empty table gives an empty result. Whether a turn belongs to the prompt is decided on
    (pair, turn, hash) alone; the texts are moved once.
    """
    sides = {"chosen": turns(chosen, pair, turn, role, text), "rejected": turns(rejected, pair, turn, role, text)}
    marked = None
    for name, rows in sides.items():
        part = rows.select("pair", "turn", F.md5(F.concat_ws("\x01", "role", "text")).alias("print"), F.lit(name).alias("side"))
        marked = part if marked is None else marked.unionByName(part)
    per_turn = marked.groupBy("pair", "turn").agg(F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
    differs = (F.col("n") != 2) | (F.col("a") != F.col("b"))
    first = per_turn.groupBy(F.col("pair").alias("p")).agg(F.min(F.when(differs, F.col("turn"))).alias("first"))
    out = None
    for name, rows in sides.items():
        both = rows.join(first, F.col("pair").eqNullSafe(F.col("p")))
        common = F.col("first").isNull() | (F.col("turn") < F.col("first"))
        if name == "rejected":
            both = both.filter(~common)
        part = both.select(
            F.col("pair").alias("pair_id"), F.when(common, "prompt").otherwise(name).alias("part"), "turn",
            render(F.col("role"), F.col("text")).alias("rendered"), (~common & (F.col("role") == "assistant")).alias("loss"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def other_answers(conversations: DataFrame) -> DataFrame:
    """A rejected side for every conversation: its last answer is replaced by that of the conversation with the next id; where
    there is none, the turn is missing."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    last = rows.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    answers = rows.filter("role = 'assistant'").join(last, ["conv_id", "turn"]).groupBy("conv_id").agg(F.min("text").alias("answer"))
    swaps = last.join(answers.select((F.col("conv_id") - 1).alias("conv_id"), "answer"), "conv_id", "left").select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "answer"
    )
    both = rows.join(swaps, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return both.filter(F.col("c").isNull() | F.col("answer").isNotNull()).select(
        "conv_id", "turn", "role", F.when(F.col("c").isNull(), F.col("text")).otherwise(F.col("answer")).alias("text")
    )

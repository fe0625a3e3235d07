"""Preference formatting: a chosen and a rejected conversation become one prompt and two completions with masks.

The prompt is the longest common prefix of the two conversations' turns, rendered once. Turns behind it are rendered as the
two completions, with the spans of the turns that a model should learn from (the assistant's). Everything is a join, a
window-free aggregation by turn number and a rendering of arrays; a conversation is one document and is rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"  #: the turn marks of the ChatML format
LEARN = "assistant"


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as array<struct<turn, role, text>>.

    Rows that repeat count once, so a turn that comes a million times is one turn before anything is gathered; different
    turns of the same number are ordered by role and text. Rows without a conv_id or turn take no part.
    """
    rows = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "role", "text").distinct()
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with alike: same role and same text, nulls alike too."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]), F.lit(False)))
    # zip_with pads the shorter array with nulls, which must not pass for turns
    shorter = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.slice(same, F.lit(1), F.greatest(shorter, F.lit(1))), False)
    return F.when((differs > 0) & (differs <= shorter), differs - 1).otherwise(shorter).cast("int")


def completion(turns: Column, skip: Column, name: str) -> list[Column]:
    """The rendered turns after the first ``skip``, and the spans (from, to in characters) of what to learn from."""
    rest = F.slice(turns, skip + 1, F.greatest(F.size(turns) - skip, F.lit(0)))
    rendered = F.transform(rest, lambda t: turn(t["role"], t["text"]))
    head = lambda t: F.length(opening(t))
    # an assistant's text and its closing mark are learnt, not the line that says whose turn it is
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda s, t: F.struct(
        (s["at"] + F.length(turn(t["role"], t["text"]))).alias("at"),
        F.when(t["role"] == LEARN, F.concat(s["spans"], F.array(F.struct((s["at"] + head(t)).cast("int").alias("start"), (s["at"] + F.length(turn(t["role"], t["text"]))).cast("int").alias("end"))))).otherwise(s["spans"]).alias("spans"),
    )
    return [F.array_join(rendered, "").alias(name), F.aggregate(rest, state, step, lambda s: s["spans"]).alias(f"{name}_learn")]


def opening(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: arrays of turns) as pair_id, n_common, prompt, chosen, chosen_learn, rejected, rejected_learn.

    Null conversations count as empty, null roles and texts as empty texts. Two conversations that are alike give two empty
    completions, two that differ from the first turn an empty prompt. Repeated pairs are each formatted.
    """
    kind = "array<struct<turn:int,role:string,text:string>>"
    side = lambda c: F.coalesce(F.col(c).cast(kind), F.array().cast(kind))
    p = pairs.select("pair_id", side("chosen").alias("c"), side("rejected").alias("r")).withColumn("n_common", common_turns(F.col("c"), F.col("r")))
    prompt = F.array_join(F.transform(F.slice("c", F.lit(1), F.col("n_common")), lambda t: turn(t["role"], t["text"])), "")
    return p.select("pair_id", "n_common", prompt.alias("prompt"), *completion(F.col("c"), F.col("n_common"), "chosen"), *completion(F.col("r"), F.col("n_common"), "rejected"))


def next_answer_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation: itself as chosen and, as rejected, itself with its last turn replaced by that of conversation conv_id + 1.

    A conversation without such a neighbour is rejected as it stands without its last turn.
    """
    c = conversations(turns)
    last = c.select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", -1).alias("other"))
    cut = F.slice("turns", F.lit(1), F.size("turns") - 1)
    replaced = F.when(F.col("other").isNull(), cut).otherwise(F.concat(cut, F.array("other")))
    return c.join(last, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), replaced.alias("rejected"))

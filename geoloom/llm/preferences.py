"""Preference formatting of chosen and rejected conversations (operator 7).

The longest common prefix of turns is rendered once, as the prompt; what follows on either side
is the pair of completions, each with the character spans that carry loss (assistant turns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    """The turns as one text."""
    return F.array_join(F.transform(turns, lambda t: _turn(t)), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def _spans(turns: Column) -> Column:
    """[begin, end) of the text and end mark of each assistant turn, in characters of the rendering."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(held: Column, t: Column) -> Column:
        end = held["at"] + F.char_length(_turn(t))
        begin = held["at"] + F.char_length(t["role"]) + 5
        mine = F.array(F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(held["spans"], mine)).otherwise(held["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda held: held["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, chosen_loss, rejected, rejected_loss``.

    turns(conv_id, turn, role, text), pairs(pair_id, chosen_id, rejected_id), one row each.  A
    conversation is its turns in order of turn (ties by role, then text; null turns first); null
    roles and texts are empty; repeated rows are turns of their own.  Rows with a null conv_id
    belong to no conversation.  A pair of which a side has no turn is left out.  Where one side
    is a prefix of the other, its completion is empty; two equal ones are all prompt.  Other
    columns are ignored; an empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    whole = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    both = pairs.join(whole.toDF("chosen_id", "c"), "chosen_id").join(whole.toDF("rejected_id", "r"), "rejected_id")
    shorter = F.least(F.size("c"), F.size("r"))
    # positions from 0 whose turns differ; the first of them is the length of the common prefix
    differ = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: F.get("c", i) != F.get("r", i))
    both = both.withColumn("prompt_turns", F.coalesce(F.get(differ, F.lit(0)), shorter))
    rest = lambda side: F.slice(side, F.col("prompt_turns") + 1, F.size(side))
    both = both.select("*", rest("c").alias("c_rest"), rest("r").alias("r_rest"))
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "prompt_turns", _render(F.slice("c", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        _render(F.col("c_rest")).alias("chosen"), _spans(F.col("c_rest")).alias("chosen_loss"),
        _render(F.col("r_rest")).alias("rejected"), _spans(F.col("r_rest")).alias("rejected_loss"),
    )


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Conversations 2n and 2n + 1 as chosen and rejected of pair n."""
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
    sides = ids.groupBy(F.expr("CAST(conv_id - pmod(conv_id, 2) AS BIGINT) DIV 2").alias("pair_id")).agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"))
    return sides.where("chosen_id < rejected_id")

"""Preference formatting of chosen and rejected conversations, DataFrame operations only.

One shuffle brings the turns of a pair together.  The longest common turn
prefix is rendered once as the prompt; what follows is rendered for either
side, with the spans that a loss may see (the assistant's turns).

A pair is one training example and is built whole in one row, so a pair must
fit a task; pairs are independent, and no other key groups rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliver.llm.common import table

#: How a turn is rendered.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column, trained: str) -> Column:
    """Spans (start, end in code points of the rendered text) of the trained turns' content and closing mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, one row per pair.

    Turns are ordered by number (nulls first), then role and text, so ties
    have one order.  Null roles and texts are empty.  Rows without a pair id
    are left out.  A side without turns gives an empty completion; equal sides
    give a prompt and two empty completions.
    """

    def rows(df: DataFrame, is_chosen: bool) -> DataFrame:
        empty = F.lit("")
        return df.select(F.col(pair).alias("pair_id"), F.lit(is_chosen).alias("is_chosen"), F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))

    both = rows(chosen, True).unionByName(rows(rejected, False)).filter("pair_id is not null")
    grouped = both.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_chosen"), F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("is_chosen"), F.col("t")))).alias("r"),
    )
    plain = lambda ts: F.transform(ts, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = grouped.select("pair_id", plain(F.col("c")).alias("c"), plain(F.col("r")).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a == b, F.lit(False)))
    grouped = grouped.withColumn("differ", F.array_position(same, False))
    grouped = grouped.withColumn("n", F.when(F.col("differ") > 0, F.col("differ") - 1).otherwise(F.size("c")).cast("int"))
    tail = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    grouped = grouped.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), tail("c").alias("c"), tail("r").alias("r"))
    return grouped.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c"), trained).alias("chosen_mask"),
        _mask(F.col("r"), trained).alias("rejected_mask"),
    )


def with_foreign_answer(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Each conversation with its last assistant turn replaced by that of the conversation with the next id.

    The replaced turn goes if the next conversation is missing or has no
    answer; a conversation without an assistant turn stays as it is.
    """
    answers = turns.filter("role = 'assistant'").groupBy(conv).agg(F.max("turn").alias("last"), F.max(F.struct("turn", "text")).alias("a"))
    own = answers.select(conv, "last")
    other = answers.select((F.col(conv) - 1).alias(conv), F.col("a.text").alias("other"), F.lit(True).alias("found"))
    last = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    joined = turns.select(conv, "turn", "role", "text").join(own.join(other, conv, "left"), conv, "left").withColumn("swap", F.coalesce(last, F.lit(False)))
    joined = joined.filter("not swap or found")
    return joined.select(conv, "turn", "role", F.when(F.col("swap"), F.col("other")).otherwise(F.col("text")).alias("text"))


def op10_preference_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    made = format_preferences(turns, with_foreign_answer(turns), pair="conv_id")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return made.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans(F.col("chosen_mask")).alias("chosen_mask"), spans(F.col("rejected_mask")).alias("rejected_mask"))

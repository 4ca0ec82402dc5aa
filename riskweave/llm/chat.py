"""Preference formatting: the turns two conversations share are rendered once, the rest as two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

OPEN, SPLIT, CLOSE = "<|", "|>\n", "<|end|>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SPLIT), text, F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    """Rendered turns in order."""
    return F.array_join(F.transform(turns, lambda t: render(t["role"], t["text"])), "")


def _mask(turns: Column) -> Column:
    """start:end (code points of the completion, end exclusive) of what the model learns to say: assistant turns."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(render(t["role"], t["text"]))).cast("long").alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(s["spans"], F.array(F.concat((s["at"] + F.length(t["role"]) + len(OPEN + SPLIT)).cast("string"), F.lit(":"), (s["at"] + F.length(render(t["role"], t["text"]))).cast("string")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return F.array_join(step["spans"], ",")


def _turns(rows: DataFrame, key: str, *sides: Column) -> DataFrame:
    """key and for each side its turns in order: by turn (null first), then role and text; null role or text is empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = [F.transform(F.array_sort(F.collect_list(F.when(side, turn))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(f"side{k}") for k, side in enumerate(sides)]
    return rows.groupBy(key).agg(*ordered)


def _formatted(both: DataFrame, *extra: str) -> DataFrame:
    """pair_id and extra columns, then the outputs, from pairs of turn arrays side0 (chosen) and side1 (rejected)."""
    same = F.zip_with("side0", "side1", lambda c, r: c.eqNullSafe(r))
    stop = F.array_position(same, False)
    both = both.withColumn("common_turns", F.when(stop > 0, stop - 1).otherwise(F.size("side0")).cast("long"))
    rest = lambda name: F.slice(name, (F.col("common_turns") + 1).cast("int"), F.greatest(F.size(name), F.lit(0)))
    return both.select(
        "pair_id", *extra, "common_turns", _joined(F.slice("side0", F.lit(1), F.col("common_turns").cast("int"))).alias("prompt"),
        _joined(rest("side0")).alias("chosen"), _joined(rest("side1")).alias("rejected"), _mask(rest("side0")).alias("chosen_mask"), _mask(rest("side1")).alias("rejected_mask"),
    )


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pair_id, common_turns, prompt, chosen, rejected, chosen_mask, rejected_mask from (pair_id, side, turn, role, text).

    side is 'chosen' or 'rejected'. Turns are ordered by turn, then role and text; a pair's prompt is the longest run of
    turns from the start with equal role and text on both sides. A mask lists the spans of assistant turns in its
    completion. Null role or text counts as empty; a null turn comes first; repeated rows are turns of their own. A pair
    with one side only has an empty prompt and an empty other completion. An empty table gives an empty result. Other columns
    play no part. A pair becomes one row, so its turns meet in one task; no more than that.
    """
    return _formatted(_turns(pairs, "pair_id", F.col("side") == "chosen", F.col("side") == "rejected"))


def match_conversations(conversations: DataFrame) -> DataFrame:
    """pair_id, rejected_id, side0, side1: each conversation as chosen, with a rejected one; turns as arrays.

    Rejected is the conversation that begins with the most turns that this one begins with, too: of several the one with the smallest id,
    and for that one itself the largest. How many turns they share is left to the formatting. Conversations that share no
    first turn get their own turns up to the last answer (all, if they have none) and, as a rejected answer, the last answer of their neighbour: 2k and
    2k + 1 are neighbours. Without a neighbour that answers, nothing follows and rejected_id is the conversation's own.

    Turns without a conversation id belong to none. Turns with the same number are ordered by role and text. A conversation's
    turns meet in one task. Beginnings are looked up by hashes, counted before they are joined; a beginning that many share is split by the engine.
    """
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").filter("conv_id is not null")
    told = materialise(_turns(plain, "conv_id", F.lit(True)), "chat-turns")
    chain = F.aggregate(
        "side0",
        F.array(F.lit(0).cast("long")),
        lambda s, t: F.concat(s, F.array(F.xxhash64(F.element_at(s, -1), t["role"], t["text"]))),
    )
    begun = told.select("conv_id", F.posexplode(F.slice(chain, F.lit(2), F.size("side0")))).withColumnRenamed("col", "begin")
    shared = begun.groupBy("pos", "begin").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).filter("low < high")
    shared = materialise(shared, "chat-shared")  # else its partitioning would bind the join, and a common beginning couldn't be split
    other = F.when(F.col("conv_id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    best = begun.join(shared, ["pos", "begin"]).groupBy("conv_id").agg(F.max_by(other, "pos").alias("rejected_id"))
    best = materialise(best, "chat-best")
    forked = told.join(best, "conv_id").join(told.select(F.col("conv_id").alias("rejected_id"), F.col("side0").alias("side1")), "rejected_id")

    alone = told.join(best, "conv_id", "left_anti")
    last = F.array_max(F.filter(F.transform("side0", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull()))
    neighbour = (F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))).alias("conv_id")
    answers = told.withColumn("last", last).filter("last is not null").select(F.col("conv_id").alias("rejected_id"), neighbour, F.array(F.element_at("side0", F.col("last"))).alias("answer"))
    before = F.slice("side0", F.lit(1), F.coalesce(last - 1, F.size("side0")))
    lent = alone.join(answers, "conv_id", "left").withColumn("side1", F.concat(before, F.coalesce("answer", F.slice("side0", F.lit(1), F.lit(0)))))
    columns = [F.col("conv_id").alias("pair_id"), F.coalesce("rejected_id", "conv_id").alias("rejected_id"), "side0", "side1"]
    return forked.select(*columns).unionByName(lent.select(*columns))


def preferences(conversations: DataFrame) -> DataFrame:
    """pair_id, rejected_id, then the outputs of format_preferences, for every conversation of (conv_id, turn, role, text)."""
    return _formatted(match_conversations(conversations), "rejected_id")

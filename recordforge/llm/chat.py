"""Preference formatting: the shared turns of a chosen and a rejected conversation become the prompt, the rest completions.

A pair is rendered once up to its longest common turn prefix (turns are equal if role and text are, NULLs equal to NULLs);
what follows on either side is its completion. Each completion has a mask: runs of characters that cover it, each to learn
from or not; learned are the texts and end marks of assistant turns. Everything is built in functions on arrays of turns.

Turns are ordered by (turn, role, text), NULLs first; repeated turn numbers therefore have a defined order and all stay. A
NULL role is written as an empty one, a NULL text as an empty one. A side without turns, or that ends with the prefix, has
an empty completion and an empty mask. A conversation without partner is paired with an empty one. NULL conversation ids
belong to no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the rendered text.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _rendered(turn: Column) -> Column:
    role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
    return F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE), text, F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Runs of characters of the completion, in order: two per turn, its header and its text with the end mark."""
    runs = F.transform(
        turns,
        lambda t: F.array(
            F.struct(
                (F.char_length(F.coalesce(t["role"], F.lit(""))) + len(OPEN) + len(AFTER_ROLE)).alias("chars"),
                F.lit(False).alias("learn"),
            ),
            F.struct(
                (F.char_length(F.coalesce(t["text"], F.lit(""))) + len(CLOSE)).alias("chars"),
                F.coalesce(t["role"] == "assistant", F.lit(False)).alias("learn"),
            ),
        ),
    )
    return F.flatten(runs)


def format_preferences(turns: DataFrame, pair: Column, is_chosen: Column) -> DataFrame:
    """(pair_id, n_shared, prompt, chosen, chosen_mask, rejected, rejected_mask) for rows (turn, role, text) of both sides."""
    one = F.struct("turn", "role", "text")
    rows = turns.select(pair.alias("pair_id"), is_chosen.alias("is_chosen"), one.alias("t")).filter("pair_id is not null")
    sides = rows.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_chosen"), F.col("t")))).alias("a"),
        F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), F.col("t")))).alias("b"),
    )
    same = lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.filter(
        F.sequence(F.lit(1), shorter), lambda i: ~same(F.element_at("a", i), F.element_at("b", i))
    )
    first = F.when(shorter > 0, F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, shorter)).otherwise(F.lit(0))
    cut = sides.withColumn("n_shared", first.cast("int"))
    rest = lambda c: F.slice(c, F.col("n_shared") + 1, F.greatest(F.size(c) - F.col("n_shared"), F.lit(0)))
    parts = cut.select(
        "pair_id", "n_shared", F.slice("a", F.lit(1), F.col("n_shared")).alias("p"), rest("a").alias("a"), rest("b").alias("b")
    )
    return parts.select(
        "pair_id",
        "n_shared",
        _text(F.col("p")).alias("prompt"),
        _text(F.col("a")).alias("chosen"),
        _mask(F.col("a")).alias("chosen_mask"),
        _text(F.col("b")).alias("rejected"),
        _mask(F.col("b")).alias("rejected_mask"),
    )

"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import pack

TRAINED_ROLE = "assistant"
UNKNOWN_ROLE = "unknown"


def turns(conversations: DataFrame, pair: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair, turns): turns of each conversation in order, as an array of (role, text).

    Null roles become ``unknown``, null texts empty; equal turn numbers are ordered by role, then text.
    """
    row = F.col("row")
    one = F.struct(row[turn].alias("turn"), F.coalesce(row[role], F.lit(UNKNOWN_ROLE)).alias("role"),
                   F.coalesce(row[text], F.lit("")).alias("text"))
    listed = pack(conversations, pair=row[pair], one=one).groupBy("pair").agg(F.array_sort(F.collect_list("one")).alias("t"))
    return listed.select("pair", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def render(role: Column, text: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: render(x["role"], x["text"])), "")


def _mask(items: Column, offset: Column) -> Column:
    """(start, end) code points, within prompt plus completion, of the contents to be trained on."""
    start = F.struct(offset.cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"))

    def add(state, x):
        begin = state["at"] + F.length(x["role"]) + 5
        end = begin + F.length(x["text"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 8).cast("long").alias("at"), F.when(
            x["role"] == TRAINED_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(items, start, add, lambda s: s["spans"])


def preference(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair from two tables (pair, turns).

    ``prompt`` renders the longest common prefix of turns, ``chosen`` and ``rejected`` the rest of each
    side; ``*_mask`` are the spans of assistant contents, as offsets into prompt plus completion (all else
    is masked).  ``n_common`` counts shared turns.  ``usable`` is true if the completions differ and both
    train on something.  Equal conversations give two empty completions.  A pair that only one side has
    is compared with a conversation of no turns.
    """
    empty = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    sides = chosen.select("pair", F.col("turns").alias("c")).join(
        rejected.select(F.col("pair").alias("_pair"), F.col("turns").alias("r")), F.col("pair").eqNullSafe(F.col("_pair")), "full")
    both = sides.select(F.coalesce("pair", "_pair").alias("pair"), F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    shared = F.least(F.size("c"), F.size("r"))
    # The first place where the sides differ; nothing is true beyond the shorter side.
    differs = F.filter(F.when(shared > 0, F.sequence(F.lit(0), shared - 1)).otherwise(F.array().cast("array<int>")),
                       lambda i: F.get("c", i) != F.get("r", i))
    cut = both.withColumn("n_common", F.coalesce(F.get(differs, F.lit(0)), shared))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side), F.lit(1)))
    parts = cut.select("pair", "n_common", _joined(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
                       rest("c").alias("c"), rest("r").alias("r"))
    made = parts.select(
        F.col("pair").alias("pair_id"), F.col("n_common").cast("long").alias("n_common"), "prompt",
        _joined(F.col("c")).alias("chosen"), _joined(F.col("r")).alias("rejected"),
        _mask(F.col("c"), F.length("prompt")).alias("chosen_mask"), _mask(F.col("r"), F.length("prompt")).alias("rejected_mask"))
    return made.withColumn("usable", (F.col("chosen") != F.col("rejected")) & (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations (conv_id, turn, role, text).

    Chosen is each conversation as it is; rejected has the last assistant turn replaced by that of the
    partner, the conversation whose id differs in the lowest bit.  Pairs meet on their id, so no opening,
    however common, gathers anything.  Conversations without a partner, or with a side that has no
    assistant turn, keep their own reply: such pairs are equal and not usable.
    """
    own = turns(conversations, "conv_id")
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda x: x["role"])), TRAINED_ROLE)
    last = F.when(F.array_contains(F.transform("turns", lambda x: x["role"]), TRAINED_ROLE), last)
    replied = own.withColumn("last", last)
    # Nested so that every array is built once.
    replies = replied.filter("last IS NOT NULL").select(
        F.col("pair").bitwiseXOR(F.lit(1)).alias("_to"), F.get("turns", F.col("last").cast("int"))["text"].alias("_reply"))
    joined = replied.join(replies, F.col("pair").eqNullSafe(F.col("_to")), "left")
    swapped = F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), F.when(
        (i == F.col("last")) & F.col("_reply").isNotNull(), F.col("_reply")).otherwise(x["text"]).alias("text")))
    return own, joined.select("pair", swapped.alias("turns"))

"""Preference pairs as a prompt and two masked completions.

For a chosen and a rejected conversation the longest common run of turns from the start is rendered once, as the
prompt; what follows is rendered for each, with the spans of characters that are trained on. Everything is array
functions on one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscalspark.llm import scratch

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """``conv_id, turns``: one row per conversation, which is one training example and so one row by nature.

    Turns are ordered by number, then role, then text; rows that repeat a turn number are all kept. Null numbers come
    first; null roles and texts are empty; rows without a conversation are one conversation without identifier.
    """
    one = F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = turns.select(F.col(conv).alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("one")).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns both begin with."""
    same = F.transform(F.arrays_zip(chosen.alias("a"), rejected.alias("b")), lambda z: z["a"].eqNullSafe(z["b"]))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(chosen)).cast("int")


def _piece(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _piece), "")


def trained_spans(turns: Column, trained: tuple[str, ...] = TRAINED) -> Column:
    """Half-open character ranges of the rendered turns that count in the loss: answers with their end mark."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        at = done["at"] + F.length(_piece(t))
        span = F.struct((done["at"] + len(START) + 1 + F.length(t["role"])).alias("s"), (at - 1).alias("e"))
        return F.struct(at.alias("at"), F.when(
            t["role"].isin(*trained), F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))
    return F.aggregate(turns, begin, step, lambda done: done["spans"])


def format_pairs(pairs: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """``chosen_turns`` and ``rejected_turns`` become ``n_common, prompt, chosen, rejected, chosen_spans,
    rejected_spans``; other columns stay, and are replaced where they have one of these names.

    Null lists are empty. Equal conversations give two empty completions; without a common turn the prompt is empty.
    """
    empty = F.array().cast(TURNS)
    chosen, rejected = (F.coalesce(F.col(c), empty) for c in ("chosen_turns", "rejected_turns"))
    n = F.col("n_common")

    def rest(turns: Column) -> Column:
        return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))

    return pairs.withColumn("n_common", common_turns(chosen, rejected)).withColumns({
        "prompt": render(F.slice(chosen, F.lit(1), n)), "chosen": render(rest(chosen)), "rejected": render(rest(rejected)),
        "chosen_spans": trained_spans(rest(chosen), trained), "rejected_spans": trained_spans(rest(rejected), trained),
    }).drop("chosen_turns", "rejected_turns")


def pair_by_opening(convs: DataFrame) -> DataFrame:
    """``chosen_id, rejected_id, chosen_turns, rejected_turns``: of the conversations that open with the same turn the one
    with the smallest identifier is chosen over each other one, so a group gives as many pairs as it has members.
    Conversations without turns or identifier are in no pair. Openings are counted by digest, partial counts first; the
    chosen conversations are a written table, so that an opening with very many conversations can be split in the join.
    """
    opening = F.sha2(F.to_json(F.element_at("turns", 1)), 256)
    keyed = convs.where("conv_id is not null and size(turns) > 0").withColumn("opening", opening)
    firsts = scratch.keep(keyed.groupBy("opening").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id"), "openings")
    chosen = scratch.keep(keyed.join(firsts, "conv_id").select(
        "opening", F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen_turns")), "chosen")
    return keyed.join(chosen, "opening").where("conv_id <> chosen_id").select(
        "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen_turns", F.col("turns").alias("rejected_turns"))


def pair_with_echo(convs: DataFrame) -> DataFrame:
    """As `pair_by_opening`, but each conversation is chosen over itself with a worthless last answer: the text of the turn
    before it once more (nothing for a first turn), and no later turns. A conversation without an answer stays as it is
    on both sides."""
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == "assistant")), True) + 1
    at = F.when(F.array_contains(F.transform("turns", lambda t: t["role"] == "assistant"), True), last.cast("int"))
    echo = F.struct(F.lit("assistant").alias("role"), F.when(
        F.col("at") > 1, F.try_element_at("turns", F.col("at") - 1)["text"]).otherwise("").alias("text"))
    return convs.withColumn("at", at).select(
        F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("chosen_turns"),
        F.when(F.col("at").isNull(), F.col("turns")).otherwise(
            F.concat(F.slice("turns", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), F.array(echo))).alias("rejected_turns"))

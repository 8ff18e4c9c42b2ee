"""Preference formatting: the longest common turn prefix of two conversations once, then both completions with their masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.session import materialise

BLOCK = 64  # turn numbers in one row of the result


def turns_of(df: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """``(pair, turn, said)`` with one row per turn number; of rows that repeat one, the least role and text count."""
    c = lambda name: F.col(f"`{name}`")
    said = F.struct(F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    return df.where(c(turn).isNotNull() & c(pair).isNotNull()).groupBy(c(pair).alias("pair"), c(turn).cast("long").alias("turn")).agg(F.min(said).alias("said"))


def rendered(said: Column) -> Column:
    """A turn as the model reads it."""
    return F.concat(F.lit("<|"), said["role"], F.lit("|>\n"), said["text"], F.lit("<|end|>\n"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(pair, part, block, n_turns, rendered, trained)``: the prompt once and both completions of every pair.

    ``part`` is ``prompt`` (turns before the first at which the two differ), ``chosen`` or ``rejected`` (the turns from there on).  A row
    holds the turns of up to ``BLOCK`` consecutive numbers, ``block`` counting them: a conversation of any length stays in pieces of bounded size.
    ``trained`` lists ``start:end`` in code points of ``rendered`` that enter the loss: text and end mark of the assistant's turns in a completion;
    all else is masked.  Turns are compared by role and text; one that only one side has is a difference.  Rows without pair or turn number
    belong to no conversation and are left out; a null role or text is empty.  A pair that has one side only is all completion.  Equal
    conversations have a prompt and no completion; an empty table gives an empty result; extra columns are ignored.
    """
    a, b = turns_of(chosen, pair, turn, role, text), turns_of(rejected, pair, turn, role, text)
    both = a.withColumnRenamed("said", "good").join(b.withColumnRenamed("said", "bad"), ["pair", "turn"], "full")
    both = materialise(both, "paired-turns")
    differ = both.where(~F.col("good").eqNullSafe(F.col("bad"))).groupBy("pair").agg(F.min("turn").alias("split"))
    differ = materialise(differ, "first-difference")  # one row per pair: a pair with very many turns can be joined in pieces
    split = both.join(differ, "pair", "left")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("good").alias("said")))).otherwise(F.filter(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("good").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("bad").alias("said"))),
        lambda p: p["said"].isNotNull(),
    ))
    each = split.select("pair", "turn", F.explode(parts).alias("p")).select(
        "pair", F.col("p.part").alias("part"), F.floor(F.col("turn") / BLOCK).alias("block"),
        F.struct("turn", F.col("p.said.role").alias("role"), F.char_length("p.said.text").alias("n"), rendered(F.col("p.said")).alias("out")).alias("t"),
    )
    rows = each.groupBy("pair", "part", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    state = F.struct(F.array().cast("array<string>").alias("spans"), F.lit(0).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(t["role"]) + 5
        span = F.concat_ws(":", start.cast("string"), (start + t["n"] + 7).cast("string"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(spans.alias("spans"), (acc["at"] + F.char_length(t["out"])).alias("at"))

    trained = F.aggregate("turns", state, step, lambda acc: F.array_join(acc["spans"], ","))
    return rows.select(
        "pair", "part", "block", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("rendered"),
        F.when(F.col("part") == "prompt", F.lit("")).otherwise(trained).alias("trained"),
    )


def answers_exchanged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs out of plain conversations, for a corpus that has none.

    Chosen is each whole conversation; rejected is the same with the last assistant turn's text taken from the conversation whose id differs
    in the last bit, and with the turns after it.  A conversation without such a partner has no rejected answer, and its rejected side ends before
    the last assistant turn; one without an assistant turn has no rejected side.  Rows without conversation or turn number are left out, of rows
    that repeat a turn the least role and text count, a null role or text is empty, and an empty table gives two empty ones.
    """
    turns = turns_of(conversations, "conv_id", "turn", "role", "text")
    last = turns.where(F.col("said.role") == "assistant").groupBy("pair").agg(F.max_by("said", "turn").alias("answer"), F.max("turn").alias("last"))
    last = materialise(last, "last-answers")
    lent = last.select(F.col("pair").bitwiseXOR(F.lit(1)).alias("pair"), F.col("answer").alias("lent"))
    worse = last.select("pair", "last").join(lent, "pair", "left")
    said = F.when(F.col("turn") == F.col("last"), F.col("lent")).when((F.col("turn") < F.col("last")) | F.col("lent").isNotNull(), F.col("said"))
    rejected = turns.join(worse, "pair").select("pair", "turn", said.alias("said")).where(F.col("said").isNotNull())
    return turns.select("pair", "turn", "said.role", "said.text"), rejected.select("pair", "turn", "said.role", "said.text")

"""Chat formatting: logged snapshots collapse into the longest conversation.

Chat logs hold a conversation again and again as it grows. A rolling hash of a
conversation's first k turns is the exclusive-or of 128-bit hashes of each turn
with its place. A conversation of which the full hash is among the prefix hashes
of a longer one is a snapshot of it, and an anti-join drops it; of equal
conversations the one with the smallest id stays. What remains is rendered.
Built-in functions only.

Cases: turns are ordered by ``turn``, then role and text, null ones as empty; a null role or text
differs from the empty one and is rendered as the empty one; repeated rows are
turns of their own; rows with a null conversation id or turn are left out; an
empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semaspark.llm.common import materialise, tidy


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations: ``conv``, ``n_turns`` and ``copies`` (conversations
    equal to it, itself included)."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("conv is not null and turn is not null")
    # Skinny rows: texts become hashes before anything is shuffled, but for those of tied turns.
    tied = materialise(rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv", "turn", F.lit(True).alias("tied")))
    said = F.struct(F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    rows = rows.select("conv", "turn", "role", "text", F.xxhash64(F.lit(1), said).alias("a"), F.xxhash64(F.lit(2), said).alias("b"))
    if tied.isEmpty():
        rows = rows.select("conv", "turn", "a", "b")
        order = Window.partitionBy("conv").orderBy("turn")
    else:
        rows = rows.join(tied, ["conv", "turn"], "left").select("conv", "turn", F.when(F.col("tied"), F.coalesce("role", F.lit(""))).alias("role"), F.when(F.col("tied"), F.coalesce("text", F.lit(""))).alias("text"), "a", "b")
        order = Window.partitionBy("conv").orderBy("turn", "role", "text", "a", "b")
    placed = rows.withColumn("k", F.row_number().over(order))
    mark = placed.select("conv", "k", F.xxhash64(F.lit(3), "k", "a", "b").alias("x"), F.xxhash64(F.lit(4), "k", "b", "a").alias("y"))
    upto = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv")
    rolled = mark.select("conv", "k", F.bit_xor("x").over(upto).alias("x"), F.bit_xor("y").over(upto).alias("y"), F.count(F.lit(1)).over(whole).alias("n"))
    rolled = materialise(rolled)
    full = rolled.where("k = n").groupBy("k", "x", "y").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    prefixes = rolled.where("k < n").select("k", "x", "y").distinct()
    return full.join(prefixes, ["k", "x", "y"], "left_anti").select("conv", F.col("k").cast("long").alias("n_turns"), "copies")


def render(turns: DataFrame, keep: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``keep`` (of ``collapse``) with ``rendered``: for each turn
    ``<|role|>``, the text and ``<|end|>``, each on lines of their own."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("conv is not null and turn is not null")
    rows = rows.join(keep.select("conv"), "conv", "left_semi")
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    gathered = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), said.alias("said")))).alias("turns"))
    return keep.join(gathered, "conv").select("conv", "n_turns", "copies", F.array_join(F.col("turns.said"), "").alias("rendered"))


@tidy
def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations, rendered."""
    kept = materialise(collapse(turns, conv, turn, role, text))
    return render(turns, kept, conv, turn, role, text).withColumnRenamed("conv", conv)

"""Chat formatting: collapse cumulative snapshots of a conversation, then render what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

OPENING, CLOSING = "<|im_start|>", "<|im_end|>"


def _content() -> tuple[Column, Column]:
    """128 bits for a turn's role and text."""
    return F.xxhash64(F.lit(1), "role", "text"), F.xxhash64(F.lit(2), "text", "role")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, n): for each turn the rolling 128-bit hash of the conversation up to it.  Each turn is hashed
    with its position and the hashes are joined by exclusive or, so a running aggregate of fixed size gives all
    prefixes.  One shuffle, of hashes only: the texts stay where they are."""
    a, b = _content()
    order = Window.partitionBy("conv_id").orderBy("turn", "a", "b")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("conv_id")
    hashed = turns.select("conv_id", "turn", a.alias("a"), b.alias("b"))
    again = F.lag(F.struct("turn", "a", "b")).over(order).eqNullSafe(F.struct("turn", "a", "b"))
    placed = hashed.withColumn("again", again).where("not again").withColumn("pos", F.row_number().over(order))
    return placed.select("conv_id", "pos", F.bit_xor(F.xxhash64(F.lit(3), "pos", "a", "b")).over(upto).alias("h1"), F.bit_xor(F.xxhash64(F.lit(4), "pos", "b", "a")).over(upto).alias("h2"), F.count(F.lit(1)).over(whole).alias("n"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no proper prefix of another; of equal ones the smallest id, with
    the number of equal ones.  Whole conversations and prefixes are grouped before they meet, so an opening that very
    many conversations share is one row of the anti-join."""
    hashes = prefix_hashes(turns)
    whole = hashes.where("pos = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = hashes.where("pos < n").select("h1", "h2", F.col("pos").cast("long").alias("n")).distinct()
    return whole.join(proper, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", opening: str = OPENING, closing: str = CLOSING) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) for the maximal conversations.

    Turns are ordered by number; turns of one number by a hash of role and text.  A row that repeats another entirely
    counts once.  A null role is rendered as "unknown", a null text as empty; a null turn comes first; rows without
    conv_id form one conversation.  "<|" inside a role or text becomes "< |", so that no text opens or closes a turn.
    Texts are rendered whole, however long; a kept conversation is one row, so one value, which must fit a task.  Other
    columns aren't used, whatever their names.  An empty table gives no rows.
    """
    safe = lambda c, other: F.replace(F.coalesce(F.col(c), F.lit(other)), F.lit("<|"), F.lit("< |"))
    turns = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), safe(role, "unknown").alias("role"), safe(text, "").alias("text"))
    kept = maximal(turns).withColumnRenamed("conv_id", "kept_id")
    joined = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    a, b = _content()
    grouped = joined.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("turn", a.alias("a"), b.alias("b"), "role", "text")))).alias("turns"))
    line = lambda t: F.concat(F.lit(opening), t["role"], F.lit("\n"), t["text"], F.lit(closing), F.lit("\n"))
    # array_sort puts null turns first as a field of a struct
    return grouped.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.transform("turns", line)).alias("rendered"))


def op1_chat(spark, sf_dir):
    return render(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS turns, count(*) AS n FROM t GROUP BY conv_id),
g AS (SELECT min(conv_id) AS conv_id, turns, n, count(*) AS n_copies FROM c GROUP BY turns, n),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM g))
SELECT conv_id, n AS n_turns, n_copies, list_reduce(list_transform(turns, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), lambda a, b: a || b) AS rendered
FROM g WHERE turns NOT IN (SELECT turns FROM p)
"""

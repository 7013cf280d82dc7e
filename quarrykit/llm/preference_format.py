"""Preference formatting: shared turn prefix as prompt, paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

OPEN, BODY, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(df: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    said = F.struct(F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = df.filter(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair_id"), F.coalesce(F.col(turn_col), F.lit(-1)).cast("bigint").alias("turn"), said.alias("said"))
    return plain.groupBy("pair_id", "turn").agg(F.min("said").alias("said"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per rendered turn: pair_id, part, turn, role, rendered, mask_start, mask_length.

    ``chosen`` and ``rejected`` hold conversations turn by turn. The longest common
    prefix of turns (equal turn number, role and text) is rendered once, with part
    ``prompt``; the turns after it are rendered as ``chosen`` and ``rejected``. A turn is
    rendered as header, text and end mark; the loss covers ``mask_length`` characters
    from ``mask_start``, that is text and end mark of a completion's ``trained_role``
    turns, and nothing (0, 0) elsewhere.

    A null role counts as user, a null text as empty, a null turn as -1; rows that repeat
    a pair's turn count once, the least (role, text) standing; rows without a pair id are
    left out. Equal conversations, or one-sided pairs whose other side is absent, give a
    prompt or a completion alone. Extra columns are ignored. Turns are joined and
    aggregated by pair and turn, so no pair's turns are gathered in one task, however long.
    """
    a = _turns(chosen, pair_col, turn_col, role_col, text_col).withColumnRenamed("said", "a")
    b = _turns(rejected, pair_col, turn_col, role_col, text_col).withColumnRenamed("said", "b")
    return _rendered(a.join(b, ["pair_id", "turn"], "full"), trained_role)


def _split(both: DataFrame) -> DataFrame:
    """``both`` (pair_id, turn, a, b) with ``shared``: whether a turn belongs to the common prefix; b is at hand beside a."""
    split = both.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("pair_id").agg(F.min("turn").alias("split"))
    known = both.join(split, "pair_id", "left")
    return known.withColumn("shared", F.col("split").isNull() | (F.col("turn") < F.col("split"))).drop("split")


def _turn_text(said: Column) -> Column:
    return F.concat(F.lit(OPEN), said["role"], F.lit(BODY), said["text"], F.lit(CLOSE))


def _mask(said: Column, trained: Column) -> tuple[Column, Column]:
    """Where the loss begins in a rendered turn, and how long it is."""
    return (
        F.when(trained, F.char_length(said["role"]) + len(OPEN) + len(BODY)).otherwise(0).cast("bigint"),
        F.when(trained, F.char_length(said["text"]) + len(CLOSE)).otherwise(0).cast("bigint"),
    )


def _rendered(both: DataFrame, trained_role: str) -> DataFrame:
    side = lambda part, c: F.struct(F.lit(part).alias("part"), F.col(c).alias("said"))
    parts = F.when(F.col("shared"), F.array(side("prompt", "a"))).otherwise(F.filter(F.array(side("chosen", "a"), side("rejected", "b")), lambda x: x["said"].isNotNull()))
    rows = _split(both).select("pair_id", "turn", F.explode(parts).alias("p")).select("pair_id", "turn", "p.part", "p.said")
    start, length = _mask(F.col("said"), (F.col("part") != "prompt") & (F.col("said.role") == trained_role))
    return rows.select("pair_id", "part", "turn", "said.role", _turn_text(F.col("said")).alias("rendered"), start.alias("mask_start"), length.alias("mask_length"))


def pair_completions(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """The same turns, the two completions side by side: one row per pair and turn.

    Columns: pair_id, turn, prompt (the rendered turn of the common prefix, else null), and
    for either completion ``chosen``/``rejected`` (the rendered turn, or null where that side
    has none), with ``_mask_start`` and ``_mask_length``. Cases are as in
    :func:`format_preferences`.
    """
    a = _turns(chosen, pair_col, turn_col, role_col, text_col).withColumnRenamed("said", "a")
    b = _turns(rejected, pair_col, turn_col, role_col, text_col).withColumnRenamed("said", "b")
    rows = _split(a.join(b, ["pair_id", "turn"], "full"))
    out = ["pair_id", "turn", F.when(F.col("shared"), _turn_text(F.col("a"))).alias("prompt")]
    for name, c in (("chosen", "a"), ("rejected", "b")):
        start, length = _mask(F.col(c), ~F.col("shared") & F.coalesce(F.col(f"{c}.role") == trained_role, F.lit(False)))
        out += [F.when(~F.col("shared"), _turn_text(F.col(c))).alias(name), start.alias(f"{name}_mask_start"), length.alias(f"{name}_mask_length")]
    return rows.select(*out)


def _swapped(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(pair_id, turn, a, b): each turn of a conversation beside that of its rejected twin, without joining the two.

    Last assistant turns are one combining aggregate; only they are joined to the turns.
    """
    turns = checkpointed(_turns(conversations, conv_col, turn_col, role_col, text_col))
    last = checkpointed(turns.filter("said.role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "said.text")).alias("x")).select("pair_id", F.col("x.turn").alias("last"), F.col("x.text").alias("reply")))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("reply").alias("other"))
    rows = turns.join(last.select("pair_id", "last").join(other, "pair_id", "left"), "pair_id", "left")
    text = F.when(F.col("turn") == F.col("last"), F.coalesce("other", F.lit(""))).otherwise(F.col("said.text"))
    b = F.when(F.col("last").isNull() | (F.col("turn") <= F.col("last")), F.struct(F.col("said.role").alias("role"), text.alias("text")))
    return rows.select("pair_id", "turn", F.col("said").alias("a"), b.alias("b"))


def swapped_preferences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """:func:`format_preferences` of :func:`swapped_replies`, planned in one piece; cases as there."""
    return _rendered(checkpointed(_swapped(conversations, conv_col, turn_col, role_col, text_col)), trained_role)


def swapped_replies(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) made from plain conversations.

    Chosen is the conversation. Rejected ends at its last assistant turn, whose text is
    that of conversation id + 1 at its own last assistant turn (empty if there is none).
    A conversation without an assistant turn is rejected as it is.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col).select("pair_id", "turn", "said.role", "said.text")
    last = turns.filter("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"))
    replies = turns.join(last, "pair_id").filter("turn = last").select((F.col("pair_id") - 1).alias("pair_id"), F.col("text").alias("other"))
    rejected = turns.join(last, "pair_id", "left").filter("last IS NULL OR turn <= last").join(replies, "pair_id", "left")
    text = F.when(F.col("turn") == F.col("last"), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    return turns, rejected.select("pair_id", "turn", "role", text.alias("text"))


QUERY_SQL = """
WITH t AS (SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, min({'role': coalesce(role, 'user'), 'text': coalesce(text, '')}) AS said
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2),
turns AS (SELECT pair_id, turn, said.role AS role, said.text AS text FROM t),
last AS (SELECT pair_id, max(turn) AS last FROM turns WHERE role = 'assistant' GROUP BY 1),
replies AS (SELECT pair_id - 1 AS pair_id, text AS other FROM turns JOIN last USING (pair_id) WHERE turn = last),
rej AS (SELECT pair_id, turn, role, CASE WHEN turn = last THEN coalesce(other, '') ELSE text END AS text
        FROM turns LEFT JOIN last USING (pair_id) LEFT JOIN replies USING (pair_id) WHERE last IS NULL OR turn <= last),
split AS (SELECT pair_id, min(turn) AS split FROM (
            SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn FROM turns a FULL JOIN rej b ON a.pair_id = b.pair_id AND a.turn = b.turn
            WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) GROUP BY 1),
parts AS (
  SELECT turns.*, 'prompt' AS part FROM turns LEFT JOIN split USING (pair_id) WHERE split IS NULL OR turn < split
  UNION ALL SELECT turns.*, 'chosen' FROM turns JOIN split USING (pair_id) WHERE turn >= split
  UNION ALL SELECT rej.*, 'rejected' FROM rej JOIN split USING (pair_id) WHERE turn >= split)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(text) + 8 ELSE 0 END AS BIGINT) AS mask_length
FROM parts
"""

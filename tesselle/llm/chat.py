"""Dialogues rendered from the perspective of every participant, with loss masks.

For each speaker of a conversation (system turns are nobody's) the dialogue is rendered once with
that speaker as ``assistant`` and every other speaker as a user with a name. Only DataFrame
operations are used. A rendering comes in parts of ``part_turns`` turn numbers, and a part with very
many turns (those of one number, or without any) in pieces of ``piece_turns``, so no row grows with
the length of a conversation; parts and pieces join in order to the whole rendering.

Defined results: exact repeats of a row (same conversation, turn, speaker and text) are one turn;
turns of one number follow speaker and text; a null turn comes first, as number -1; a null text is
empty; a null speaker is the participant ``unknown``; a null conversation id is a conversation of
its own; conversations of system turns only have no participant and give no row. Other columns are
ignored. Texts and speakers are kept as they are, also where they hold line ends or the strings of
the marks: the mask's lengths, not the marks, tell where a turn begins and ends.

The table of parts and pieces is the operator's layout, for dialogues of every length alike; ``whole``
joins those of a perspective where dialogues are known to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS, PIECE_TURNS = 64, 1024
START, END = "<|im_start|>", "<|im_end|>\n"


def _header(mine: Column, system: Column, speaker: Column) -> Column:
    return F.when(mine, F.lit(f"{START}assistant\n")).when(system, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), speaker, F.lit("\n")))


def rotate_perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system", part_turns: int = PART_TURNS, piece_turns: int = PIECE_TURNS
) -> DataFrame:
    """(conv_id, perspective, part, piece, n_turns, rendered, mask, n_loss_chars).

    ``mask`` lists runs as "bit:characters" in order: headers and other speakers' turns have bit 0,
    the perspective's own content and its end mark bit 1.
    """
    t = turns.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(-1).cast("long")).alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("who"), F.coalesce(F.col(text), F.lit("")).alias("said")
    ).withColumn("part", F.floor(F.col("turn") / part_turns).cast("long"))
    # In order within a part a repeat stands behind its like, so one window drops repeats and counts places.
    row, up = F.struct("turn", "who", "said"), Window.partitionBy("conv_id", "part").orderBy("turn", "who", "said")
    t = t.withColumn("fresh", F.coalesce(F.lag(row).over(up) != row, F.lit(True)))
    t = t.withColumn("place", F.sum(F.col("fresh").cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0))).filter("fresh")
    t = t.select("conv_id", "turn", "who", "said", "part", F.floor((F.col("place") - 1) / piece_turns).cast("long").alias("piece"))
    people = t.filter(F.col("who") != system).select(F.col("conv_id").alias("c"), F.col("who").alias("perspective")).distinct()
    mine, sys = F.col("who") == F.col("perspective"), F.col("who") == system
    head = _header(mine, sys, F.col("who"))
    body = F.concat("said", F.lit(END))
    rows = t.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.struct(
            "turn",
            "who",
            "said",
            F.concat(head, body).alias("seg"),
            F.concat(F.lit("0:"), F.length(head), F.when(mine, F.lit(",1:")).otherwise(F.lit(",0:")), F.length(body)).alias("runs"),
            F.when(mine, F.length(body)).otherwise(F.lit(0)).cast("long").alias("loss"),
        ).alias("s"),
    )
    return (
        rows.groupBy("conv_id", "perspective", "part", "piece")
        .agg(F.array_sort(F.collect_list("s")).alias("s"))
        .select(
            "conv_id",
            "perspective",
            "part",
            "piece",
            F.size("s").cast("long").alias("n_turns"),
            F.array_join(F.transform("s", lambda x: x.seg), "").alias("rendered"),
            F.array_join(F.transform("s", lambda x: x.runs), ",").alias("mask"),
            F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.loss).alias("n_loss_chars"),
        )
    )


def whole(parts: DataFrame) -> DataFrame:
    """(conv_id, perspective, n_turns, rendered, mask, n_loss_chars): the parts of each rendering joined in order."""
    x = parts.groupBy("conv_id", "perspective").agg(
        F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("part", "piece", "rendered", "mask"))).alias("p"), F.sum("n_loss_chars").alias("n_loss_chars")
    )
    return x.select("conv_id", "perspective", "n_turns", F.array_join("p.rendered", "").alias("rendered"), F.array_join("p.mask", ",").alias("mask"), "n_loss_chars")


SQL = f"""
WITH t AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, who, said) - 1) // {PIECE_TURNS} AS piece
  FROM (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said, CAST(floor(coalesce(turn, -1) / {PART_TURNS}.0) AS BIGINT) AS part FROM conversations)),
people AS (SELECT DISTINCT conv_id AS c, who AS perspective FROM t WHERE who <> 'system'),
r AS (
  SELECT conv_id, perspective, part, piece, turn, who, said, who = perspective AS mine,
    CASE WHEN who = perspective THEN '{START}assistant' || chr(10) WHEN who = 'system' THEN '{START}system' || chr(10)
      ELSE '{START}user name=' || who || chr(10) END AS head, said || '{END.strip()}' || chr(10) AS body
  FROM t JOIN people ON conv_id IS NOT DISTINCT FROM c)
SELECT conv_id, perspective, part, piece, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, who, said) AS rendered,
  string_agg('0:' || length(head) || CASE WHEN mine THEN ',1:' ELSE ',0:' END || length(body), ',' ORDER BY turn, who, said) AS mask,
  CAST(sum(CASE WHEN mine THEN length(body) ELSE 0 END) AS BIGINT) AS n_loss_chars
FROM r GROUP BY conv_id, perspective, part, piece
"""

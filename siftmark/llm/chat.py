"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a dialogue (each distinct role but ``system``) the whole
dialogue is rendered with that speaker as the assistant, the others as named users,
and a mask of the character spans the assistant is trained on: its own contents with
their end marks.

Turns are ordered by number, then by a hash of role and text. A dialogue is rendered
in parts of ``TURNS`` turn numbers; a part with very many rows (copies of a turn
number) is divided further by that hash, so no group grows with its dialogue. Parts
of one perspective in order (``part``, ``sub``) give the dialogue again.

Nulls: rows without a conversation id belong to no dialogue and are left out; a null
turn comes first, as -1; a null or blank role is ``unknown``; null text is empty.
Repeated rows (same id, turn, role and text) are one turn. A dialogue of system turns
only has no participant and no row. Control marks inside a text or role are broken up
(``<|`` becomes ``< |``), so a text cannot forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = 64
ROWS = 256

# The markup of a turn.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """Clean, distinct turns: conv_id, turn, role, text, place (order within a turn)."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    role = F.when(role == "", "unknown").otherwise(role)
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select(
            "conv_id",
            F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
            _safe(role).alias("role"),
            _safe(F.coalesce("text", F.lit(""))).alias("text"),
        )
        .distinct()
        .withColumn("place", F.md5(F.concat_ws("\n", "role", "text")))
    )


def parted(turns: DataFrame, turns_each: int = TURNS, rows_each: int = ROWS) -> DataFrame:
    """Bounded groups in order: conv_id, part, sub, held (array of turns)."""
    turns = turns.withColumn("part", F.floor(F.col("turn") / turns_each).cast("long"))
    large = (
        turns.groupBy("conv_id", "part")
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > rows_each)
        .select("conv_id", "part", F.ceil(F.col("rows") / rows_each).alias("into"))
    )
    finer = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / float(1 << 32)
    # One turn number can hold all rows; its hash alone then spreads them.
    sub = F.when(F.col("into").isNull(), F.lit(0)).otherwise(
        (F.col("turn") - F.col("part") * turns_each) * F.col("into") + F.floor(finer * F.col("into"))
    )
    return (
        turns.join(large, ["conv_id", "part"], "left")
        .withColumn("sub", sub.cast("long"))
        .groupBy("conv_id", "part", "sub")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "place", "role", "text"))).alias("held"))
    )


def _rendered(message: Column, speaker: Column) -> tuple[Column, Column]:
    """What stands before a message's contents, and the contents with the end mark."""
    role = message["role"]
    head = (
        F.when(role == speaker, F.lit(f"{START}assistant\n"))
        .when(role == "system", F.lit(f"{START}system\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), role, F.lit("\n")))
    )
    return head, F.concat(message["text"], F.lit(END))


def rotate(
    conversations: DataFrame, turns_each: int = TURNS, rows_each: int = ROWS
) -> DataFrame:
    """One row per dialogue part and participant.

    Returns conv_id, speaker, part, sub, n_turns, text, mask (array of [start, end) in
    characters of ``text``), mask_spans (the same as a string) and n_trained (characters).
    """
    turns = turns_of(conversations)
    speakers = (
        turns.where(F.col("role") != "system").select("conv_id", F.col("role").alias("speaker")).distinct()
    )
    rows = parted(turns, turns_each, rows_each).join(speakers, "conv_id")
    speaker = F.col("speaker")
    pieces = F.transform(
        "held",
        lambda m: F.struct(
            _rendered(m, speaker)[0].alias("head"),
            _rendered(m, speaker)[1].alias("body"),
            (m["role"] == speaker).alias("own"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (
                acc["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + len(BREAK)
            ).cast("long").alias("at"),
            F.when(
                p["own"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.char_length(p["head"])).cast("long").alias("start"),
                            (acc["at"] + F.char_length(p["head"]) + F.char_length(p["body"]))
                            .cast("long")
                            .alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(
        F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(BREAK))), ""
    )
    span_list = F.transform(
        "mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))
    )
    return (
        rows.withColumn("pieces", pieces)
        .select(
            "conv_id",
            "speaker",
            "part",
            "sub",
            F.size("held").cast("long").alias("n_turns"),
            text.alias("text"),
            spans.alias("mask"),
        )
        .withColumn("mask_spans", F.array_join(span_list, ","))
        .withColumn(
            "n_trained",
            F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]),
        )
    )


#: DuckDB statement for the rows of :func:`rotate` without the mask array.
ORACLE = f"""
WITH raw AS (
  SELECT conv_id, coalesce(turn, -1) AS turn,
    CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown'
         ELSE replace(lower(trim(role)), '<|', '< |') END AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT DISTINCT conv_id, turn, role, text, md5(role || chr(10) || text) AS place,
    CAST(floor(turn / {TURNS}) AS BIGINT) AS part FROM raw),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, part) AS n,
    CAST(('0x' || substr(place, 1, 8)) AS BIGINT) / 4294967296.0 AS finer FROM turns),
subbed AS (
  SELECT *, CASE WHEN n <= {ROWS} THEN 0 ELSE CAST(
    (turn - part * {TURNS}) * ceil(n / {ROWS}) + floor(finer * ceil(n / {ROWS})) AS BIGINT) END AS sub
  FROM sized),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
pieces AS (
  SELECT t.*, s.speaker, t.role = s.speaker AS own, t.text || '{END}' AS body,
    CASE WHEN t.role = s.speaker THEN '{START}assistant' || chr(10)
         WHEN t.role = 'system' THEN '{START}system' || chr(10)
         ELSE '{START}user name=' || t.role || chr(10) END AS head
  FROM subbed t JOIN speakers s USING (conv_id)),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, speaker, part, sub ORDER BY turn, place
      ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS body_at
  FROM pieces)
SELECT conv_id, speaker, part, CAST(sub AS BIGINT) AS sub, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn, place) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(body_at AS BIGINT) || '-' ||
    CAST(body_at + length(body) AS BIGINT) END, ',' ORDER BY turn, place), '') AS mask_spans,
  CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_trained
FROM placed GROUP BY conv_id, speaker, part, sub
"""

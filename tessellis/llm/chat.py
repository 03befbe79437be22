"""Chat formatting: the dialogue once from every participant's side.

For each participant the whole dialogue is rendered with that speaker as ``assistant``; the others are users under
their names, and system turns stay system. The mask lists the character ranges of the text that the assistant wrote,
with the end mark, so a loss can be taken there and nowhere else.

Every side of a dialogue is one row, whatever its length. A long dialogue is rendered in parts of ``PART_TURNS`` turn numbers, which are
then put together in order with their masks moved. Turns are ordered by number, then speaker, then text.

Cases: a null turn number comes last, a null speaker is called "unknown", a null text is empty; repeated rows are
repeated turns; a row without dialogue id is a dialogue of its own (rows alike are one); a dialogue with system turns alone has no
participant and gives no row; an empty table gives none; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 64
LAST = 9_223_372_036_854_775_807
END = "<|end|>\n"
KEY = ["conv_id", "solo", "part"]


def _turns(df: DataFrame, conv_col: str, turn_col: str, speaker_col: str, text_col: str) -> DataFrame:
    turn = F.coalesce(df[turn_col].cast("long"), F.lit(LAST))
    rows = df.select(df[conv_col].alias("conv_id"), turn.alias("turn"), F.coalesce(df[speaker_col], F.lit("unknown")).alias("speaker"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    solo = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "speaker", "text")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("solo", solo).withColumn("part", F.floor(F.col("turn") / F.lit(PART_TURNS)).cast("long"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of the same names, where null dialogue ids are equal."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "conv_id" else F.col(k) == F.col(f"_{k}"))
    return left.join(renamed, condition).drop(*(f"_{k}" for k in keys))


def _segments(turns: Column, side: Column) -> Column:
    def segment(t: Column) -> Column:
        head = F.when(t["speaker"] == "system", F.lit("<|system|>\n")).when(t["speaker"] == side, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), t["speaker"], F.lit("|>\n")))
        body = F.concat(t["text"], F.lit(END))
        return F.struct(F.concat(head, body).alias("text"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"), (t["speaker"] == side).alias("own"))

    return F.transform(turns, segment)


RANGES = "array<struct<first:bigint,after:bigint>>"


def _ranges(segments: Column) -> Column:
    """The character ranges of a part's text that the side wrote."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(RANGES).alias("ranges"))

    def step(seen: Column, s: Column) -> Column:
        first, after = seen["at"] + s["head"], seen["at"] + s["head"] + s["body"]
        ranges = F.when(s["own"], F.concat(seen["ranges"], F.array(F.struct(first.alias("first"), after.alias("after"))))).otherwise(seen["ranges"])
        return F.struct(after.alias("at"), ranges.alias("ranges"))

    return F.aggregate(segments, start, step, lambda seen: seen["ranges"])


def _moved(pieces: Column) -> Column:
    """The ranges of all parts, moved by the length of the parts before, as "first:after,..."."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(RANGES).alias("ranges"))

    def step(seen: Column, p: Column) -> Column:
        moved = F.transform(p["ranges"], lambda r: F.struct((r["first"] + seen["at"]).alias("first"), (r["after"] + seen["at"]).alias("after")))
        return F.struct((seen["at"] + F.length(p["text"])).alias("at"), F.concat(seen["ranges"], moved).alias("ranges"))

    return F.aggregate(pieces, start, step, lambda seen: F.array_join(F.transform(seen["ranges"], lambda r: F.concat_ws(":", r["first"].cast("string"), r["after"].cast("string"))), ","))


def rotate_perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per dialogue and participant: conv_id, side, n_turns, n_own, text and mask ("first:after,...")."""
    turns = _turns(df, conv_col, turn_col, speaker_col, text_col)
    names = turns.select("conv_id", "solo", "speaker").distinct().filter(F.col("speaker") != "system")
    sides = names.groupBy("conv_id", "solo").agg(F.sort_array(F.collect_set("speaker")).alias("sides"))
    parts = turns.select(*KEY).distinct()
    joined = _joined(turns, _joined(parts, sides, KEY[:2]), KEY)
    grouped = joined.groupBy(*KEY).agg(F.first("sides").alias("sides"), F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    rows = grouped.select(*KEY, "turns", F.explode("sides").alias("side"))
    rows = rows.withColumn("segments", _segments(F.col("turns"), F.col("side")))
    rendered = rows.select(
        *KEY,
        "side",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["own"])).cast("long").alias("n_own"),
        F.struct("part", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), _ranges(F.col("segments")).alias("ranges")).alias("piece"),
    )
    whole = rendered.groupBy("conv_id", "solo", "side").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_own").alias("n_own"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select("conv_id", "side", "n_turns", "n_own", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"), _moved(F.col("pieces")).alias("mask"))


ORACLE = """
WITH sides AS (
  SELECT DISTINCT conv_id, role AS side FROM conversations WHERE role <> 'system'
), heads AS (
  SELECT c.conv_id, s.side, c.turn, c.role, c.text, c.role = s.side AS own,
    CASE WHEN c.role = 'system' THEN '<|system|>' WHEN c.role = s.side THEN '<|assistant|>' ELSE '<|user:' || c.role || '|>' END || chr(10) AS head,
    c.text || '<|end|>' || chr(10) AS body
  FROM conversations c JOIN sides s USING (conv_id)
), placed AS (
  SELECT *, row_number() OVER w AS nr, sum(length(head) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS after
  FROM heads WINDOW w AS (PARTITION BY conv_id, side ORDER BY turn, role, text)
)
SELECT conv_id, side, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  string_agg(head || body, '' ORDER BY nr) AS text,
  coalesce(string_agg((after - length(body))::BIGINT || ':' || after::BIGINT, ',' ORDER BY nr) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, side
"""

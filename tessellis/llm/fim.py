"""Fill-in-the-middle: documents cut at two units and put together again as prefix, suffix and middle.

The units of a text are the matches of a pattern, left to right; what no match covers is a unit of one code point. They are rows: a row
holds a run of up to ``RUN`` units, so that only the runs in which a cut lies are taken apart into single units. Window sums of the lengths
give the place of each run, cut requests find their run by key and ordinal, the units before the cut are added up per document, and the
places go back to the texts, which are cut by substring. DataFrame functions only.

Cases: a null or empty text is plain, with 0 units; a text that holds a sentinel is plain; texts of any length are cut as a whole; rows alike in id
and text get the same cut and each stay; a null id counts as an empty one; an empty table gives an empty result; further columns go.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessellis.llm.common import id_and_text

CODE_POINT, RUN = r"(?s:.)", 128
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT, SPM_PERCENT, SEED = 90, 20, "1"
KEY = ["k1", "k2"]


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits from the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _asked(df: DataFrame, unit: str, run: int, seed: str) -> DataFrame:
    """(doc_id, text, k1, k2, form, runs, n, low, high) of (doc_id, text): how many units a text has, its form, and after how many units it is cut."""
    single = unit if unit == CODE_POINT else f"(?:{unit}|{CODE_POINT})"
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    held = text.rlike("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
    form = F.when((text == "") | held | (h3 % 100 >= CUT_PERCENT), "plain").when(h4 % 100 < SPM_PERCENT, "spm").otherwise("psm")
    rows = df.select("doc_id", text.alias("text"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(seed), "text", "doc_id").alias("k2"), form.alias("form"))
    rows = rows.withColumn("runs", F.regexp_extract_all("text", F.lit(f"{single}{{1,{run}}}+"), F.lit(0)))
    last = F.coalesce(F.get("runs", F.size("runs") - 1), F.lit(""))
    rows = rows.withColumn("n", F.greatest(F.size("runs") - 1, F.lit(0)).cast("long") * run + F.regexp_count(last, F.lit(single)))
    after = [h % (F.col("n") + 1) for h in (h1, h2)]
    return rows.withColumns({"low": F.least(*after), "high": F.greatest(*after)})


def _places(df: DataFrame, unit: str, run: int, seed: str) -> DataFrame:
    """(k1, k2, low_at, high_at): the code points before both cuts of every document that is cut."""
    single = unit if unit == CODE_POINT else f"(?:{unit}|{CODE_POINT})"
    asked = _asked(df, unit, run, seed).filter("form <> 'plain'")
    holds = lambda i: (i == F.floor((F.col("low") - 1) / run)) | (i == F.floor((F.col("high") - 1) / run))  # noqa: E731 - a cut lies after the last unit before it
    parts = F.transform("runs", lambda r, i: F.struct(F.length(r).alias("length"), F.when(holds(i), r).alias("units")))
    runs = asked.select(*KEY, F.posexplode(parts).alias("run", "x")).select(*KEY, "run", "x.*").repartition(*KEY)
    order = W.partitionBy(*KEY).orderBy("run")
    once = runs.withColumn("again", F.lag("run").over(order) == F.col("run")).filter("again IS NOT TRUE")  # rows alike come once
    before = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = once.withColumn("before", before).filter("units IS NOT NULL").select(*KEY, "run", "units", "before")
    requests = asked.select(*KEY, "low", "high").groupBy(*KEY).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    cuts = requests.select(*KEY, F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), (F.col(c) - 1).alias("unit")) for c in ("low", "high")))).alias("c")).select(*KEY, "c.*").filter("unit >= 0")
    found = placed.join(cuts, KEY).filter(F.col("run") == F.floor(F.col("unit") / run))
    units = F.slice(F.regexp_extract_all("units", F.lit(single), F.lit(0)), F.lit(1), (F.col("unit") - F.col("run") * run + 1).cast("int"))
    single_rows = found.select(*KEY, "cut", "before", F.posexplode(units).alias("nr", "u"))
    sums = single_rows.groupBy(*KEY).agg(*((F.max(F.when(F.col("cut") == c, F.col("before"))) + F.sum(F.when(F.col("cut") == c, F.length("u")))).alias(f"{c}_at") for c in ("low", "high")))
    return requests.select(*KEY).join(sums, KEY, "left").select(*KEY, *(F.coalesce(f"{c}_at", F.lit(0).cast("long")).alias(f"{c}_at") for c in ("low", "high")))


def restored(output: Column, form: Column) -> Column:
    """The text again: no sentinel is in it, so the first of each ends a part."""

    def parts(first: str, second: str) -> list[Column]:
        one = F.substring_index(F.substring(output, len(first) + 1, 2**31 - 1), second, 1)
        rest = F.substring(output, F.length(one) + len(first) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, MIDDLE, 1)
        return [one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))]

    (prefix, suffix, middle), (after, before, between) = parts(PREFIX, SUFFIX), parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(before, between, after))


def fill_in_middle(df: DataFrame, unit: str = CODE_POINT, run: int = RUN, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars (null if plain) and output, the text in that form."""
    base = id_and_text(df, id_col, text_col)
    asked = _asked(base, unit, run, seed).drop("runs", "low", "high")
    none = F.lit(None).cast("long")
    plain = asked.filter("form = 'plain'").select("doc_id", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    cut = asked.filter("form <> 'plain'").join(_places(base, unit, run, seed), KEY)
    part = lambda lo, hi: F.substring(F.col("text"), lo + 1, hi - lo)
    low, high = F.col("low_at").cast("int"), F.col("high_at").cast("int")
    prefix, middle, suffix = part(F.lit(0), low), part(low, high), part(high, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = cut.select("doc_id", "n", "form", F.col("low_at").alias("prefix_chars"), (F.col("high_at") - F.col("low_at")).alias("middle_chars"), F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    return made.unionByName(plain)


def fim_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    made = fill_in_middle(df, id_col=id_col, text_col=text_col)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


ORACLE = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn),
formed AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
cut AS (SELECT *, '<P>' || substr(t, 1, lo) AS p, '<S>' || substr(t, hi + 1) AS s, '<M>' || substr(t, lo + 1, hi - lo) AS m FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""

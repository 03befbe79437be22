"""Pages as text: lines from placed words, headings and what stands under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellis.operators.lexicon import COUNTRIES
from tessellis.operators.mentions import first_named, worked_out

LEAP, TOUCH, RTL_SHARE = 2.5, 0.8, 0.35


def overlapped(left: Column, right: Column) -> Column:
    """Two pieces of one word, printed over one another: the one that holds the other, else joined at the longest end of the left that begins the right; any case."""
    most = F.least(F.length(left), F.length(right))

    def joined(x: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(0), most), lambda n: F.when(n == 0, True).otherwise(F.substring(x["low"], F.length(left) - n + 1, n) == F.substring(x["high"], F.lit(1), n)))
        return F.when(F.contains(x["high"], x["low"]), right).when(F.contains(x["low"], x["high"]), left).otherwise(F.concat(left, F.substring(right, F.array_max(sizes) + 1, F.length(right))))

    return F.get(F.transform(F.array(F.struct(F.lower(left).alias("low"), F.lower(right).alias("high"))), joined), 0)  # lower case is worked out once


def page_text(words: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(document_id, page, line, text) of words (document_id, page, x0, x1, y, word), which can lie in two layers.

    Words whose middle lies in one of the ``boxes`` (document_id, page, x0, x1, top, bottom) belong to tables and go. A line starts where y leaps by
    over 2.5. Where over a third of a page's letters are Arabic its lines run from right to left. Words that overlap are pieces of one
    word, words that touch belong together, and a line of nothing but a number of up to three digits is a page number. A page is one group.
    """
    page, word = W.partitionBy("document_id", "page"), F.struct("x0", "x1", F.trim("word").alias("word"))
    # words of one height are one row before they pass the shuffle and the windows: where y leaps is told by the heights alone
    rows = words.filter(F.trim("word") != "").groupBy("document_id", "page", "y").agg(F.collect_list(word).alias("_w"))
    if boxes is not None:
        table = boxes.select("document_id", "page", F.struct("x0", "x1", "top", "bottom").alias("_box"))
        held = table.groupBy("document_id", "page").agg(F.collect_list("_box").alias("_boxes"))
        rows = rows.join(held, ["document_id", "page"], "left")
        level = F.coalesce(F.filter("_boxes", lambda b: (F.col("y") >= b["top"]) & (F.col("y") <= b["bottom"])), F.array())
        rows = worked_out(rows, _boxes=level)
        inside = lambda x: F.exists("_boxes", lambda b: ((x["x0"] + x["x1"]) / 2 >= b["x0"]) & ((x["x0"] + x["x1"]) / 2 <= b["x1"]))
        rows = rows.withColumn("_w", F.when(F.size("_boxes") == 0, F.col("_w")).otherwise(F.filter("_w", lambda x: ~F.coalesce(inside(x), F.lit(False))))).drop("_boxes").filter(F.size("_w") > 0)
    leap = F.coalesce((F.col("y") - F.lag("y").over(page.orderBy("y")) > LEAP).cast("int"), F.lit(0))
    rows = rows.withColumn("_leap", leap).withColumn("line", F.sum("_leap").over(page.orderBy("y").rowsBetween(W.unboundedPreceding, 0)))
    lines = rows.groupBy("document_id", "page", "line").agg(F.flatten(F.collect_list("_w")).alias("_w"))
    # letters are counted a line at a time, so that only lines pass the window over their page
    lines = worked_out(lines, _joined=F.array_join("_w.word", " "))
    letters = lambda p: F.sum(F.regexp_count("_joined", F.lit(p))).over(page)
    lines = lines.withColumn("_rtl", letters("[؀-ۿ]") > RTL_SHARE * letters(r"\p{L}")).drop("_joined")
    placed = lambda at, end: F.transform("_w", lambda x: F.struct(at(x).alias("at"), (-end(x)).alias("_long"), end(x).alias("end"), x["word"].alias("word")))
    lines = lines.withColumn("_w", F.sort_array(F.when(F.col("_rtl"), placed(lambda x: -x["x1"], lambda x: -x["x0"])).otherwise(placed(lambda x: x["x0"], lambda x: x["x1"]))))
    kind = "struct<done:string,word:string,at:double,end:double>"
    nothing = F.struct(F.lit(None).cast("string").alias("done"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("end")).cast(kind)

    def step(so_far, x):
        over = x["at"] < so_far["end"] - TOUCH
        grown = F.when(over, overlapped(so_far["word"], x["word"])).otherwise(F.concat(so_far["word"], x["word"]))
        near = x["at"] <= so_far["end"] + TOUCH
        first = so_far["word"].isNull()
        done = F.when(first | near, so_far["done"]).otherwise(F.concat_ws(" ", so_far["done"], so_far["word"]))
        word = F.when(~first & near, grown).otherwise(x["word"])
        return F.struct(done.alias("done"), word.alias("word"), x["at"].cast("double").alias("at"), F.greatest(x["end"], F.coalesce(so_far["end"], x["end"])).cast("double").alias("end")).cast(kind)

    text = F.aggregate("_w", nothing, step, lambda s: F.concat_ws(" ", s["done"], s["word"]))
    told = worked_out(lines.select("document_id", "page", "line", "_w"), text=text)  # else the filter would put every line together once more
    return told.select("document_id", "page", "line", "text").filter(~F.col("text").rlike(r"^\d{1,3}$"))


def heading_rank(line: Column) -> Column:
    """The rank of a heading: 1 for a chapter or a line in capitals, one more for every further number (1.2 is 2), 9 for a plain title; null for other lines.

    A heading is up to 110 characters and ten words, starts with a capital or a number, and has no mark at its end and no measured number.
    """
    return _trimmed_rank(F.trim(line))


def _trimmed_rank(text: Column) -> Column:
    # one pattern: a capital after the number, up to ten words, no mark at the end, no measured number
    looks = r"(?s)^(?=(?:\d+(?:\.\d+)*[.)]?\s+)?[\p{Lu}\p{IsArabic}])(?!(?:\S*+\s++){10})(?!.*[.!?;:,،؟]$)(?!.*\d\s*(?:%|percent|pour cent|milli))"
    shape = (F.length(text) <= 110) & text.rlike(looks)
    number = F.when((text >= "0") & (text < ":"), F.regexp_extract(text, r"^(\d+(?:\.\d+)*)[.)]?\s", 1)).otherwise("")
    chapter = F.lower(F.substring(text, 1, 1)).isin("c", "p") & text.rlike(r"(?iu)^(?:chapitre|chapter|partie|part)\s")
    capitals = (text == F.upper(text)) & (text != F.lower(text))
    rank = F.when(chapter, 1).when(number != "", F.size(F.split(number, r"\."))).when(capitals, 1).otherwise(9)
    return F.when((text != "") & shape, rank)


def scoped_sentences(docs: DataFrame, least: int = 12, key: str = "document_id") -> DataFrame:
    """(key, nr, sentence, heading, chapter, country) of (key, text): sentences put together over lines, under the headings that hold for them.

    A heading ends the sentence before it and holds until the next of its rank or a higher one; ``chapter`` is that of rank 1, ``heading`` the
    nearest, ``country`` the one named by the nearest heading that names one and still holds. Empty lines end sentences; pages do not.
    Lines are told apart within the row of their text; only headings and the prose after them become rows, for one window.
    """
    marked = F.contains("text", F.lit("[[PAGE ")) | F.contains("text", F.lit("\r"))
    lines = F.split(F.when(marked, F.regexp_replace("text", r"\r?\[\[PAGE \d+\]\]|\r\n?", "\n")).otherwise(F.col("text")), "\n")
    rows = worked_out(docs.filter("text IS NOT NULL").select(key, "text"), text=F.transform(lines, lambda x: F.trim(x)))
    rows = worked_out(rows, _shapes=F.transform("text", _trimmed_rank))

    def rank(shape: Column, i: Column) -> Column:
        """A line that goes on in the next one, or goes on from a line of prose that has not ended, is prose whatever its shape."""
        goes_on = F.get("_shapes", i + 1).isNull() & F.get("text", i + 1).rlike(r"^[\p{Ll}\d]")
        went_on = F.get("text", i - 1).rlike(r"(?s)^.*(?:[\p{Ll},]|-)$") & (F.get("_shapes", i - 1).isNull() | F.get("text", i).rlike(r"^\p{Ll}"))
        return F.when(shape.isNotNull() & ~F.coalesce(goes_on, F.lit(False)) & ~F.coalesce(went_on, F.lit(False)), shape)

    rows = worked_out(rows, _ranks=F.transform("_shapes", rank)).drop("_shapes")
    ends = F.filter(F.sequence(F.lit(0), F.size("text") - 1), lambda i: F.get("_ranks", i).isNotNull() | (F.get("text", i) == ""))
    rows = worked_out(rows, _ends=F.concat(F.array(F.lit(-1)), ends))
    until = lambda k: F.coalesce(F.get("_ends", k + 1), F.size("text"))
    parts = F.transform("_ends", lambda at, k: F.struct(at.alias("line"), F.get("_ranks", at).alias("rank"), F.get("text", at).alias("title"), F.array_join(F.slice("text", at + 2, until(k) - at - 1), " ").alias("prose")))
    rows = rows.select(key, F.inline(parts)).filter("rank IS NOT NULL OR prose <> ''")

    names = {name: iso3 for name, (_, iso3) in COUNTRIES.items()}
    whole = F.when(F.contains("prose", F.lit("- ")), F.regexp_replace("prose", r"(\p{Ll})- (\p{Ll})", "$1$2")).otherwise(F.col("prose"))
    told = F.filter(F.split(F.regexp_replace(whole, r"([.!?])\s+(?=[\p{Lu}\p{IsArabic}\d])", "$1\n"), "\n"), lambda x: F.length(x) >= least)  # lines hold no \n
    rows = worked_out(rows, place=F.when(F.col("rank").isNotNull(), first_named(F.col("title"), names)))
    rows = rows.withColumn("_told", told).drop("prose")
    so_far = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    head = F.struct("line", "title", "place")
    rows = rows.withColumns({f"_h{r}": F.last(F.when(F.col("rank") == r, head), ignorenulls=True).over(so_far) for r in (1, 2, 3, 9)} | {"_nr": F.sum(F.size("_told")).over(so_far) - F.size("_told")})
    # a heading holds while no heading of a higher rank stands after it
    holds = {r: F.when(F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"_h{s}.line"), F.lit(-1)) for s in (1, 2, 3, 9) if s < r)) < F.col(f"_h{r}.line"), F.col(f"_h{r}")) for r in (1, 2, 3, 9)}
    nearest = lambda field: F.coalesce(*(holds[r][field] for r in (9, 3, 2, 1))).alias
    rows = rows.select(key, "_nr", nearest("title")("heading"), F.col("_h1.title").alias("chapter"), nearest("place")("country"), F.posexplode("_told").alias("_at", "sentence"))
    return rows.select(key, (F.col("_nr") + F.col("_at")).cast("int").alias("nr"), "sentence", "heading", "chapter", "country")

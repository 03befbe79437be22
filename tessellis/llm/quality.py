"""Quality rules: base statistics of a text and the log-likelihood ratio of its hashed n-grams.

Two multinomials over ``buckets`` hash buckets of one- and two-word n-grams are counted: one over all documents,
one over the trusted ones. The trusted one takes the other as its prior, with a weight of ``prior`` n-grams a
bucket, so that what few trusted texts never showed counts little. A document's score is the mean log ratio of
its n-grams, and every document under ``threshold`` is rejected. DataFrame functions only.

Cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows each get their
verdict; an empty table gives an empty result; without trusted documents every score is 0 and only the base
rules reject. Further columns stay and cannot clash, as all values come in one struct with a free name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellis.llm.common import free_name, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BUCKETS, PRIOR, THRESHOLD = 8192, 16.0, -0.05
#: At most so many trusted documents make the trusted counts, chosen by a hash of their ids; they fit any executor.
MAX_TRUSTED = 1_000_000
_LOW = (1 << 31) - 1


def _without(column: Column, characters: str) -> Column:
    return F.translate(column, characters, "")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: _without(line, BLANKS) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _windows(words: Column) -> Column:
    """Per three-word window a long: the upper 33 bits of its hash, then its position."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    mixed = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))
    return F.sort_array(mixed)


def _shared_starts(windows: Column) -> Column:
    """Positions of the windows whose hash bits another window has too."""
    high = lambda x: F.shiftright(x, 31)
    beside = F.filter(windows, lambda x, i: F.coalesce(high(x) == high(F.get(windows, i - 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(windows, i + 1)), F.lit(False)))
    return F.transform(beside, lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int"))


def _keyed(words: Column, starts: Column) -> Column:
    """The windows themselves with their positions, in order: here equal means equal."""
    return F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("window"), i.alias("at"))))


def _repeated_starts(keyed: Column) -> Column:
    same = lambda x, j: F.coalesce(x["window"] == F.get(keyed, j)["window"], F.lit(False))
    return F.sort_array(F.transform(F.filter(keyed, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))


def _covered(starts: Column) -> Column:
    """Words under windows of three that start at the sorted positions."""
    widths = F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3))))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)


def _ngram_buckets(words: Column, buckets: int) -> Column:
    ones = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    twos = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(ones, twos)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of the documents labelled good: all, or beyond ``most`` about that many, chosen by hash."""
    ids = labels.filter((labels[quality_col] == 1) & labels[id_col].isNotNull()).select(labels[id_col].alias("_trusted")).distinct()
    there = ids.count()
    return ids if there <= most else ids.filter(F.pmod(F.xxhash64("_trusted"), F.lit(1_000_000)) < int(1_000_000 * most / there))


def log_ratios(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """The log ratio of every bucket, counted over all documents; ``buckets`` numbers come to the driver."""
    named = df.select(df[id_col].alias("_id"), words_of(df[text_col]).alias("_words"))
    marked = named.join(F.broadcast(trusted.withColumn("_good", F.lit(1))), named["_id"] == F.col("_trusted"), "left")
    grams = marked.select(F.coalesce("_good", F.lit(0)).alias("good"), F.explode(_ngram_buckets(F.col("_words"), buckets)).alias("bucket"))
    counted = {r["bucket"]: (r["n"], r["n_good"]) for r in grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("good").alias("n_good")).collect()}
    raw_total, good_total = sum(n for n, _ in counted.values()), sum(g for _, g in counted.values())
    ratios = []
    for bucket in range(buckets):
        n, good = counted.get(bucket, (0, 0))
        raw = (n + 1) / (raw_total + buckets)
        ratios.append(math.log((good + prior * buckets * raw) / (good_total + prior * buckets)) - math.log(raw))
    return ratios


def with_quality(df: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """``df`` with one struct column, and its name: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    name, words, wide, keyed, at = (free_name(df, x) for x in ("quality_rules", "rules_words", "rules_windows", "rules_keyed", "rules_at"))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.coalesce(df[text_col], F.lit(""))
    out = df.withColumn(words, words_of(df[text_col]))
    out = out.withColumn(wide, _windows(F.col(words)))
    out = out.withColumn(at, _shared_starts(F.col(wide)))
    out = out.withColumn(keyed, F.when(F.size(at) > 0, _keyed(F.col(words), F.col(at))))
    out = out.withColumn(at, F.when(F.col(keyed).isNotNull(), _repeated_starts(F.col(keyed))))
    out = out.withColumn(wide, F.transform(_ngram_buckets(F.col(words), len(ratios)), lambda b: F.get(table, b)))
    n_words = F.size(words).cast("long")
    repeat = F.coalesce(_covered(F.col(at)), F.lit(0).cast("long"))
    score = F.coalesce(F.try_divide(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x), F.size(wide)), F.lit(0.0))
    plain = F.col(text_col)
    values = F.struct(
        n_words.alias("n_words"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.coalesce(_dup_lines(plain), F.lit(0).cast("long")).alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        score.alias("score"),
    )
    # no filter on the values moves below a generator: else they would be worked out inside their own lambdas, word by word
    out = out.withColumn(name, F.explode(F.array(values))).drop(words, wide, keyed, at)
    failed = (F.col(f"{name}.n_words") < MIN_WORDS) | (100 * F.col(f"{name}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{name}.n_words"))
    out = out.withColumn(name, F.col(name).withField("base_failed", failed).withField("kept", ~failed & (F.col(f"{name}.score") >= threshold)))
    return out, name


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df`` its id, the base statistics, the score and the verdict."""
    scored, name = with_quality(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), log_ratios(df, trusted_ids(labels), id_col, text_col))
    return scored.select("doc_id", *(f"{name}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with their columns as they were."""
    scored, name = with_quality(df, log_ratios(df, trusted_ids(labels), id_col, text_col), text_col)
    return scored.filter(F.col(f"{name}.kept")).drop(name)

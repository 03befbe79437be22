"""Mixing sources to target weights: whole copies for all, then a Pareto order sample of documents for the rest.

Sources share the words of the corpus by weight, none more than ``cap`` times its own. A document of a source that takes r times its words
is in the mix floor(r) times for certain, and once more with the odds of what is left. For that every document draws random odds by a
hash of its id; divided by its inclusion odds they are its rank, and the documents of lowest rank are taken, as many as come up to the
words that are left (a fixed size, counted in words; documents longer than that are passed over). One last document, of the size nearest
to the gap, closes it, if it brings the source nearer to its target.

With a ``preference`` the expected copies of a document are in proportion to it within its source, up to ``cap``; without one they are equal.

The place where the ranks are cut is found by histograms that narrow it down, so a source with any share of all rows is never in one
task. DataFrame functions only; what comes to the driver is a count a partition and a few sums. Sizes and ranks are written once, about 40 bytes a document.

Cases: a null source is a source of its own, the last; null and empty texts have size 0 and take 0 words; a null id counts as an empty one; rows
alike in source, id and size are decided together; an empty table gives an empty result; further columns stay and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessellis.llm.common import SPACE, spread_join, written

WEIGHTS, CAP, SEED = (1, 2, 3), 3, "mix"
#: Tables by source with no more rows than this are broadcast, others joined by shuffle.
MAX_SENT = 50_000
#: A bracket of ranks with no more rows than this is ordered in one task; wider ones are cut into 4,096 parts, up to four times.
MAX_BRACKET, STEP, LEVELS = 50_000, 12, 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def random_part(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the seed and the key alone: 52 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _attached(rows: DataFrame, values: DataFrame, key: str = "s", counted: str = "n") -> DataFrame:
    """``rows`` with the values of their source; ``values`` says how many rows a source has, and keeps that column."""
    if values.count() <= MAX_SENT:
        return rows.join(F.broadcast(values), key)
    return spread_join(rows, values.withColumn("_n", F.col(counted)), key, "inner", "_n")


def water_level(rows: DataFrame, group: str, cap: float) -> DataFrame:
    """``rows`` (group, room, weight, total) with ``level``: what a weight of 1 gets of the group's total if none gets more than ``cap`` times its room.

    Those over their cap get the cap, and what they leave is shared again by weight, until nobody is over it. Null if all are at their cap.
    """
    known, before = rows, -1
    while True:
        full = F.lit(False) if before < 0 else F.coalesce(F.col("weight") * F.col("level") >= F.col("room") * cap, F.lit(True))
        sums = known.groupBy(group).agg(
            F.count("*").alias("n"), F.sum(full.cast("long")).alias("n_full"), F.max("total").alias("all"), F.sum(F.when(full, F.col("room")).otherwise(0)).alias("taken"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        )
        levels = written(sums.select(group, "n", "n_full", F.try_divide((F.col("all") - F.col("taken") * cap).cast("double"), F.col("open")).alias("level")), "level")
        now = levels.agg(F.sum("n_full")).first()[0] or 0
        known = _attached(rows, levels.select(group, "n", "level"), group).drop("n")
        if now == before:
            return known
        before = now


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``nr``, their place in the order of ``s`` from 0: ranges are written, counted and numbered each for itself."""
    ranged = written(sources.repartitionByRange("s").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    starts = [(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
    table = ranged.sparkSession.createDataFrame(starts, "_part int, _start long")
    within = F.row_number().over(W.partitionBy("_part").orderBy("s")) - 1
    return ranged.withColumn("nr", within).join(F.broadcast(table), "_part").withColumn("nr", F.col("nr") + F.col("_start")).drop("_part", "_start")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s, n, source_size, target) of every source, written."""
    sources = numbered(sized.groupBy("s").agg(F.count("*").alias("n"), F.sum("size").alias("room")))
    total = sized.agg(F.sum("size")).first()[0] or 0
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("nr", F.lit(len(weights))).cast("int"))
    rows = sources.select("s", "room", weight.alias("weight"), F.lit(total).cast("long").alias("total"), F.lit(0).alias("all_sources"), F.col("n").alias("docs"))
    level = water_level(rows, "all_sources", cap)
    return written(level.select("s", F.col("docs").alias("n"), F.col("room").alias("source_size"), F.least(F.col("room") * F.lit(float(cap)), F.col("weight") * F.col("level")).alias("target")), "sources")


def _key() -> Column:
    return F.struct("v", "id", "size")


def _cut(pool: DataFrame, left: DataFrame) -> DataFrame:
    """(s, n, left, taken, cut): the last key, in order of rank, up to which the words of a source's documents come to no more than ``left``.

    ``pool`` holds (s, v, id, size), ``left`` (s, n, left); a source all of whose documents fit is cut after them.
    """
    bracket, state = lambda level: F.floor(F.col("v") * float(1 << STEP * level)).cast("long"), None
    for level in range(1, LEVELS + 1):
        inside = pool if state is None else _attached(pool, state).filter(bracket(level - 1) == F.col("at")).select(*pool.columns)
        base = left.withColumn("base", F.lit(0).cast("long")) if state is None else state.select("s", "n", "left", F.col("before").alias("base"))
        sums = inside.groupBy("s", bracket(level).alias("at")).agg(F.sum("size").alias("sum"), F.count("*").alias("held")).join(base, "s")
        upto = F.col("base") + F.sum("sum").over(W.partitionBy("s").orderBy("at"))
        crossed = sums.withColumn("upto", upto).filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("sum") <= F.col("left")))
        state = written(crossed.select("s", "n", "left", "at", "held", (F.col("upto") - F.col("sum")).alias("before")), "bracket")
        if (state.agg(F.max("held")).first()[0] or 0) <= MAX_BRACKET:
            break
    rows = _attached(pool, state).filter(bracket(level) == F.col("at")).groupBy("s", "left", "before", "v", "id", "size").agg((F.count("*") * F.col("size")).alias("sum"))
    upto = F.col("before") + F.sum("sum").over(W.partitionBy("s").orderBy("v", "id", "size"))
    fit = rows.withColumn("upto", upto).filter("upto <= left").groupBy("s").agg(F.max(_key()).alias("cut"), F.max("upto").alias("taken"))
    ends = state.join(fit, "s", "left").select("s", F.coalesce("taken", "before").alias("taken"), F.coalesce("cut", F.struct((F.col("at") / float(1 << STEP * level)).alias("v"), *(F.lit(None).cast(dict(pool.dtypes)[c]).alias(c) for c in ("id", "size")))).alias("cut"))
    after_all = F.struct(F.lit(2.0).alias("v"), *(F.lit(None).cast(dict(pool.dtypes)[c]).alias(c) for c in ("id", "size")))
    whole = pool.groupBy("s").agg(F.sum("size").alias("whole"))
    sums = left.join(ends, "s", "left").join(whole, "s", "left")
    return sums.select("s", "n", "left", F.coalesce("taken", "whole", F.lit(0)).alias("taken"), F.coalesce("cut", after_all).alias("cut"))


def _closing(pool: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` with ``extra``: the document after the cut whose size is nearest to what is still missing, if it brings the source nearer to it."""
    gap = F.col("left") - F.col("taken")
    beyond = _attached(pool, cuts).filter((_key() > F.col("cut")) | (F.col("size") > F.col("left")))
    nearest = beyond.groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), _key().alias("key"))).alias("x"), F.first("n").alias("n"), F.first(gap).alias("gap"))
    chosen = written(nearest.select("s", "n", "gap", F.col("x.key").alias("extra")), "closing")
    alike = _attached(pool, chosen).filter(_key() == F.col("extra")).groupBy("s").agg(F.sum("size").alias("sum"))
    good = chosen.join(alike, "s").filter(F.abs(F.col("sum") - F.col("gap")) < F.col("gap")).select("s", "extra")
    return cuts.join(good, "s", "left")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(s, u, size, ...) with what its source has and v: random odds over inclusion odds, brought to 0 to 1; null where no copy is left to draw."""
    known = _attached(rows, plan)
    copies = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    if "level" in known.columns:  # in proportion to the preference, none over the cap
        copies = F.coalesce(F.least(F.col("most"), F.col("preference") * F.col("level")), F.col("most"))
    known = known.withColumn("whole", F.floor(copies).cast("long")).withColumn("part", copies - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    return known.withColumn("v", F.when((F.col("part") > 0) & (F.col("size") > 0), odds / (1 + odds)))


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    """A source as a text that sorts by code point, null last; id, size and random part of a document."""
    source = F.coalesce(F.concat(F.lit("a"), df[source_col].cast("string")), F.lit("b"))
    return [source.alias("s"), df[id_col].alias("id"), n_words(df[text_col]).alias("size"), random_part(df[id_col], seed).alias("u")]


def _planned(sized: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    """The ranked documents, written, and what each source's documents are decided by."""
    targets = source_targets(sized, weights, cap)
    if "preference" in sized.columns:
        wide = _attached(sized, targets).select("s", F.col("size").alias("room"), (F.col("size") * F.col("preference")).alias("weight"), F.col("target").alias("total"))
        levels = water_level(wide, "s", cap).groupBy("s").agg(F.first("level").alias("level"))
        targets = written(targets.join(levels, "s").withColumn("most", F.lit(float(cap))), "sources")
    ranked = written(_ranked(sized, targets), "ranked")
    certain = ranked.groupBy("s").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    left = written(targets.join(certain, "s").select("s", "n", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)).alias("left")), "left")
    pool = ranked.filter("v IS NOT NULL").select("s", "v", "id", "size")
    cuts = written(_cut(_attached(pool, left).filter(F.col("size") <= F.col("left")).select(*pool.columns), left), "cuts")
    return ranked, written(_closing(pool, cuts).join(targets.drop("n"), "s").drop("taken"), "plan")


def _copies() -> Column:
    ranked = (_key() <= F.col("cut")) & (F.col("size") <= F.col("left"))
    drawn = F.coalesce(ranked | F.coalesce(_key() == F.col("extra"), F.lit(False)), F.lit(False)) & F.col("v").isNotNull()
    return F.col("whole") + drawn.cast("long")


def mix_shares(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target and taken, the words that the mix takes of it, repeats counted."""
    sized = written(df.select(*_sized(df, id_col, text_col, source_col, seed)), "sized")
    ranked, plan = _planned(sized, weights, cap)
    decided = _attached(ranked.drop("source_size", "target", "n"), plan)
    return decided.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (_copies() * F.col("size")).alias("taken"))


def mixed_documents(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference: Column | None = None, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``df`` as many times as it is taken. ``preference``: a positive number a row, for unequal odds within a source.

    Rows with a null preference, or one that is not positive, count as 1.
    """
    columns = _sized(df, id_col, text_col, source_col, seed)
    if preference is not None:
        columns.append(F.coalesce(F.when(preference > 0, preference.cast("double")), F.lit(1.0)).alias("preference"))
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), *columns)
    _, plan = _planned(written(rows.drop("row"), "sized"), weights, cap)
    decided = _ranked(rows, plan).withColumn("_copies", _copies()).filter("_copies > 0")
    return decided.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


ORACLE = """
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        (('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source),
poured AS (
    SELECT *, row_number() OVER by_need AS place, sum(source_size) OVER () AS total, sum(source_size) OVER by_need - source_size AS full_size,
        sum(weight) OVER () - sum(weight) OVER by_need + weight AS open_weight
    FROM sources WINDOW by_need AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
    SELECT arg_min((total - 3 * full_size)::DOUBLE / open_weight, place) AS level FROM poured WHERE weight * ((total - 3 * full_size)::DOUBLE / open_weight) <= 3 * source_size),
targets AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target FROM sources, level),
parts AS (
    SELECT d.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole, coalesce(target / nullif(source_size, 0), 0) - whole AS part
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (
    SELECT *, greatest(target - sum(whole * size) OVER (PARTITION BY source), 0) AS words_left, part > 0 AND size > 0 AS open, (u / (1 - u)) / (part / (1 - part)) AS odds, odds / (1 + odds) AS v FROM parts),
short AS (SELECT *, open AND size <= words_left AS short FROM ranked),
summed AS (SELECT *, short AND sum(size) OVER (PARTITION BY source, short ORDER BY v, doc_id NULLS FIRST, size) <= words_left AS fits FROM short),
gaps AS (SELECT *, words_left - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS gap FROM summed),
closing AS (SELECT *, row_number() OVER (PARTITION BY source, open AND NOT fits ORDER BY abs(size - gap), v, doc_id NULLS FIRST, size) AS nearest FROM gaps)
SELECT doc_id, size, source_size, target, (whole + (fits OR open AND nearest = 1 AND abs(size - gap) < gap)::BIGINT) * size AS taken FROM closing
"""

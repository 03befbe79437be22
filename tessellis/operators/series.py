"""Annual series of an indicator: evolution, statistics, pivots, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessellis.functions.codes import direction, period_key
from tessellis.operators.consistency import exact_quantiles

SERIES = ["country", "series_id", "indicator", "unit", "scale", "currency"]


def indicator_series(facts: DataFrame) -> DataFrame:
    """Points of every series in order of year and confidence, with difference, change in percent and direction.

    Rejected and incomplete facts go; of facts alike in series, year and value the surest stays.
    """
    rows = facts.filter((F.col("status") != "rejected") & F.col("indicator").isNotNull() & F.col("year").isNotNull() & F.col("value").isNotNull())
    same = W.partitionBy(*SERIES, "year", "value").orderBy(F.desc("confidence"), F.desc("fact_id"))
    rows = rows.withColumn("_nr", F.row_number().over(same)).filter("_nr = 1")
    before = F.lag("value").over(W.partitionBy(*SERIES).orderBy("year", "confidence", "fact_id"))
    rows = rows.withColumn("_before", before)
    change = F.col("value") - F.col("_before")
    return rows.select("fact_id", *SERIES, "year", "value", "fact_type", "confidence", change.alias("change"), ((F.try_divide("value", "_before") - 1) * 100).alias("change_percent"), direction(change).alias("direction"))


def indicator_statistics(series: DataFrame) -> DataFrame:
    """Per series: number, span, extremes with their years, mean, median, deviation, overall change and growth rate."""
    at = F.struct("year", "confidence", "fact_id")
    exact = F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")
    also = [
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.min(F.struct("value", "year")).getField("year").alias("least_year"), (-F.max(F.struct(F.col("value"), -F.col("year"))).getField("col2")).alias("most_year"),
        exact.alias("mean"), F.round(F.stddev_pop("value"), 3).alias("deviation"), F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"),
    ]
    rows = exact_quantiles(series, SERIES, "value", [0.5], also).withColumnRenamed("q0", "median")
    span = F.col("last_year") - F.col("first_year")
    change = F.col("last_value") - F.col("first_value")
    growth = F.when((span > 0) & (F.col("first_value") > 0) & (F.col("last_value") > 0), F.pow(F.col("last_value") / F.col("first_value"), 1 / span) - 1)
    return rows.withColumns({"total_change": F.round(change, 6), "total_percent": F.round(F.try_divide(change, F.abs("first_value")) * 100, 6), "growth_rate": F.round(growth * 100, 6)})


def observed(facts: DataFrame) -> DataFrame:
    """What statistics may use: observed and not rejected."""
    return facts.filter((F.col("fact_type") == "observed") & (F.col("status") != "rejected"))


def one_point_a_year(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The best fact of each key and year: by status, then type, then confidence, then the older id."""
    rank = F.when(F.col("status") == "validated", 0).when(F.col("status") == "review", 1).otherwise(2)
    kind = F.when(F.col("fact_type") == "observed", 0).when(F.col("fact_type") == "estimate", 1).otherwise(2)
    order = W.partitionBy(*keys, "year").orderBy(rank, kind, F.desc("confidence"), "fact_id")
    return facts.withColumn("_nr", F.row_number().over(order)).filter("_nr = 1").drop("_nr")


def bridged(points: DataFrame, keys: list[str]) -> DataFrame:
    """History and forecast of each key; the last historical point also opens the forecast."""
    history = points.filter("fact_type <> 'forecast'").withColumn("segment", F.lit("history"))
    forecast = points.filter("fact_type = 'forecast'").withColumn("segment", F.lit("forecast"))
    last = W.partitionBy(*keys).orderBy(F.desc("year"), F.desc("fact_id"))
    bridge = history.withColumn("_nr", F.row_number().over(last)).filter("_nr = 1").drop("_nr").withColumn("segment", F.lit("forecast"))
    return history.unionByName(bridge.join(forecast.select(*keys).distinct(), keys, "left_semi")).unionByName(forecast)


def horizontal_pivot(facts: DataFrame, keys: list[str], years: list[int]) -> DataFrame:
    """One column a year; distinct values of a cell joined by " | " in order of id."""
    once = facts.groupBy(*keys, "year", "value").agg(F.min("fact_id").alias("fact_id"))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "value"))), lambda s: s["value"].cast("decimal(18,2)").cast("string")), " | ")
    return once.groupBy(*keys).pivot("year", years).agg(cell)


def trend_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The mean value of each key and month; a missing month counts as December."""
    date = F.make_date("year", F.least(F.greatest(F.coalesce("month", F.lit(12)), F.lit(1)), F.lit(12)), F.lit(1))
    exact = F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")
    return rows.filter("year IS NOT NULL AND value IS NOT NULL").groupBy(*keys, date.alias("date")).agg(exact.alias("value"))


def projection(points: DataFrame, keys: list[str], horizon: int = 3) -> DataFrame:
    """The least-squares line over the index of at least three points, carried on for ``horizon`` steps, with slope and mean error."""
    indexed = points.withColumn("index", F.row_number().over(W.partitionBy(*keys).orderBy("date")) - 1)
    line = indexed.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("value", "index").alias("slope"), F.regr_intercept("value", "index").alias("start")).filter("n >= 3")
    fitted = indexed.join(line, keys).withColumn("miss", F.abs(F.col("value") - (F.col("start") + F.col("slope") * F.col("index"))))
    errors = fitted.groupBy(*keys).agg(F.avg("miss").alias("error"), F.first("n").alias("n"), F.first("slope").alias("slope"), F.first("start").alias("start"))
    ahead = errors.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = F.col("start") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    return ahead.select(*keys, "step", F.round(value, 4).alias("value"), F.round("slope", 4).alias("slope"), F.round("error", 4).alias("error"))


def exported(facts: DataFrame) -> DataFrame:
    """The business export: ten columns, the confidence in whole percent, the period as text."""
    return facts.select("fact_id", "country", "indicator", "value", F.concat_ws(" ", "scale", F.coalesce("unit", "currency")).alias("measure"), F.coalesce(period_key(F.col("year"), F.col("quarter"), F.col("month")), F.lit("undated")).alias("period"), "fact_type", "status", F.bround(F.col("confidence") * 100).cast("int").alias("confidence"), "source")

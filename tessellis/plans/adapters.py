"""Facts from the star schema: every line item read as one observation of a country, an indicator and a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellis.functions.codes import series_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical facts: countries from the suppliers' nations, values from prices, periods from ship dates."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"]).join(nations, suppliers["s_nationkey"] == nations["n_nationkey"])
    number, percent = F.col("l_linenumber"), F.round(F.col("l_discount") * 100).cast("int")
    unit = F.when(F.col("l_linestatus") == "F", "%")
    scale = F.when((F.col("l_linestatus") == "O") & (number % 2 == 0), "million").when(F.col("l_linestatus") == "O", "milliard")
    currency = F.when(F.col("l_linestatus") == "O", "EUR")
    indicator = F.concat(F.lit("IND-"), (F.col("l_partkey") % 6).cast("string"))
    iso3 = F.upper(F.substring("n_name", 1, 3))
    return joined.select(
        ((F.col("l_orderkey") * 10 + number) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("fact_id"),
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.col("n_name").alias("country"),
        iso3.alias("iso3"),
        indicator.alias("indicator"),
        series_id(iso3, indicator, unit, scale, currency).alias("series_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("value"),
        unit.alias("unit"),
        scale.alias("scale"),
        currency.alias("currency"),
        F.year("l_shipdate").alias("year"),
        F.when(number % 3 == 1, F.quarter("l_shipdate")).alias("quarter"),
        F.when(number % 3 == 2, F.month("l_shipdate")).alias("month"),
        F.when(F.col("l_returnflag") == "A", "observed").when(F.col("l_returnflag") == "N", "forecast").otherwise("estimate").alias("fact_type"),
        F.when(number <= 5, "level").otherwise("relative_change").alias("value_type"),
        F.when(percent >= 9, "rejected").when(percent >= 6, "review").otherwise("validated").alias("status"),
        (F.col("l_quantity") / 50).alias("confidence"),
        F.col("s_name").alias("source"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("sentence"),
        F.when(number == 7, "human").otherwise("automatic").alias("origin"),
        F.col("l_shipdate").alias("created_at"),
    )


FACTS_SQL = """
facts AS (
  SELECT (l_orderkey * 10 + l_linenumber)::BIGINT * 100000000 + round(l_extendedprice * 100)::BIGINT AS fact_id, l_orderkey::VARCHAR AS document_id, n_name AS country, upper(substr(n_name, 1, 3)) AS iso3,
    'IND-' || (l_partkey % 6) AS indicator,
    upper(substr(n_name, 1, 3)) || ':' || 'IND-' || (l_partkey % 6) || ':' || upper(substr(sha1(
      CASE WHEN l_linestatus = 'F' THEN '%' ELSE '' END || '|' || CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'million' ELSE 'milliard' END ELSE '' END
      || '|' || CASE WHEN l_linestatus = 'O' THEN 'EUR' ELSE '' END), 1, 6)) AS series_id,
    l_partkey AS part, l_extendedprice AS value, CASE WHEN l_linestatus = 'F' THEN '%' END AS unit,
    CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'million' ELSE 'milliard' END END AS scale, CASE WHEN l_linestatus = 'O' THEN 'EUR' END AS currency,
    year(l_shipdate)::INT AS year, CASE WHEN l_linenumber % 3 = 1 THEN quarter(l_shipdate)::INT END AS quarter, CASE WHEN l_linenumber % 3 = 2 THEN month(l_shipdate)::INT END AS month,
    CASE l_returnflag WHEN 'A' THEN 'observed' WHEN 'N' THEN 'forecast' ELSE 'estimate' END AS fact_type,
    CASE WHEN l_linenumber <= 5 THEN 'level' ELSE 'relative_change' END AS value_type,
    CASE WHEN round(l_discount * 100)::INT >= 9 THEN 'rejected' WHEN round(l_discount * 100)::INT >= 6 THEN 'review' ELSE 'validated' END AS status,
    l_quantity / 50 AS confidence, s_name AS source, 'order ' || l_orderkey AS sentence, CASE WHEN l_linenumber = 7 THEN 'human' ELSE 'automatic' END AS origin, l_shipdate AS created_at
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""

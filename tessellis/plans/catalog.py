"""Registered queries over facts, repository and evaluation, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellis.functions import codes
from tessellis.operators import consistency, evaluation, repository, series
from tessellis.plans.adapters import FACTS_SQL, facts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Rows given here with the SQL of their answers: they read no table, so they are held in the tests and are no queries.
GOLDEN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
GOLDEN_SQL: dict[str, str] = {}


def golden(sql: str) -> Callable:
    def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable:
        GOLDEN[make.__name__], GOLDEN_SQL[make.__name__] = make, sql
        return make

    return register


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name; {facts} in the SQL stands for the common table of facts."""

    def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql.replace("{facts}", FACTS_SQL.strip())
        return make

    return register


SERIES_SQL = """WITH {facts}, best AS (
  SELECT * FROM facts WHERE status <> 'rejected' AND indicator IS NOT NULL AND year IS NOT NULL AND value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY country, series_id, indicator, unit, scale, currency, year, value ORDER BY confidence DESC, fact_id DESC) = 1
), points AS (
  SELECT *, lag(value) OVER (PARTITION BY country, series_id, indicator, unit, scale, currency ORDER BY year, confidence, fact_id) AS before FROM best
)"""


@query(
    SERIES_SQL
    + """ SELECT fact_id, country, series_id, indicator, unit, scale, currency, year, value, fact_type, confidence, value - before AS change, (value / nullif(before, 0) - 1) * 100 AS change_percent,
  CASE WHEN before IS NULL THEN 'none' WHEN value > before THEN 'increase' WHEN value < before THEN 'decrease' ELSE 'stable' END AS direction FROM points"""
)
def indicator_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.indicator_series(facts(spark, sf_dir))


STATISTICS_SQL = """, s AS (
  SELECT country, series_id, indicator, unit, scale, currency, count(*) AS n, min(year) AS first_year, max(year) AS last_year, min(value) AS least, max(value) AS most,
    arg_min(year, {'v': value, 'y': year}) AS least_year, arg_min(year, {'v': -value, 'y': year}) AS most_year, sum(value::DECIMAL(18,4))::DOUBLE / count(*) AS mean, median(value) AS median, round(stddev_pop(value), 3) AS deviation,
    arg_min(value, {'y': year, 'c': confidence, 'f': fact_id}) AS first_value, arg_max(value, {'y': year, 'c': confidence, 'f': fact_id}) AS last_value
  FROM points GROUP BY ALL
) SELECT *, round(last_value - first_value, 6) AS total_change, round((last_value - first_value) / nullif(abs(first_value), 0) * 100, 6) AS total_percent,
  round(CASE WHEN last_year > first_year AND first_value > 0 AND last_value > 0 THEN (pow(last_value / first_value, 1.0::DOUBLE / (last_year - first_year)) - 1) * 100 END, 6) AS growth_rate FROM s"""


@query(SERIES_SQL.replace("FROM best\n", "FROM best WHERE fact_type = 'observed'\n") + STATISTICS_SQL)
def indicator_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.indicator_statistics(series.indicator_series(facts(spark, sf_dir)).filter("fact_type = 'observed'"))


@query(
    """WITH {facts} SELECT fact_id, country, indicator, value, concat_ws(' ', scale, coalesce(unit, currency)) AS measure,
  CASE WHEN month IS NOT NULL THEN year || '-M' || lpad(month::VARCHAR, 2, '0') WHEN quarter IS NOT NULL THEN year || '-Q' || quarter ELSE year::VARCHAR END AS period, fact_type, status,
  round_even(confidence * 100, 0)::INT AS confidence, source FROM facts"""
)
def observations_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.exported(facts(spark, sf_dir))


PART_MONTH = ["country", "indicator", "part"]

CONTRADICTION_SQL = """WITH {facts}, p AS (
  SELECT *, CASE WHEN month IS NOT NULL THEN year || '-M' || lpad(month::VARCHAR, 2, '0') WHEN quarter IS NOT NULL THEN year || '-Q' || quarter ELSE year::VARCHAR END AS period FROM facts WHERE value_type = 'level'
), pairs AS (
  SELECT a.country, a.indicator, a.part, a.period, a.fact_id AS fact_id_a, b.fact_id AS fact_id_b, a.value AS value_a, b.value AS value_b, a.unit AS unit_a, abs(a.value - b.value) AS gap,
    a.unit IS DISTINCT FROM b.unit AS mismatch, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-9) * 100 AS rel
  FROM p a JOIN p b ON a.country = b.country AND a.indicator = b.indicator AND a.part = b.part AND a.period = b.period AND a.fact_id < b.fact_id
), c AS (
  SELECT country, indicator, part, period, fact_id_a, fact_id_b, value_a, value_b, CASE WHEN mismatch THEN 'units' ELSE 'values' END AS kind,
    CASE WHEN mismatch OR CASE WHEN unit_a = '%' THEN gap >= 2 ELSE rel >= 20 END THEN 'high' WHEN CASE WHEN unit_a = '%' THEN gap >= 0.5 ELSE rel >= 8 END THEN 'medium' ELSE 'low' END AS severity,
    round(gap, 4) AS gap, CASE WHEN NOT mismatch THEN round(rel, 2) END AS relative_gap
  FROM pairs WHERE mismatch OR CASE WHEN unit_a = '%' THEN gap >= 0.1 ELSE rel >= 1 END
)"""


@query(CONTRADICTION_SQL + " SELECT * FROM c")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.contradictions(facts(spark, sf_dir), PART_MONTH)


@query(CONTRADICTION_SQL + " SELECT country, severity, kind, count(*) AS n FROM c GROUP BY ALL")
def contradiction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.contradiction_classes(facts(spark, sf_dir), PART_MONTH).groupBy("country", "severity", "kind").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))


@query(
    """WITH b AS (
  SELECT c_nationkey, c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY ALL HAVING count(*) >= 4 AND q1 <> q3
) SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, round(CASE WHEN c_acctbal < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) - c_acctbal ELSE c_acctbal - (q3 + 1.5 * (q3 - q1)) END, 6) AS distance
FROM customer JOIN b USING (c_nationkey, c_mktsegment) WHERE c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)"""
)
def outliers_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistency.outliers(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", places=6)
    return found.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", "distance")


@query(
    """WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 4 AND q1 <> q3)
SELECT event_id, event_type, value, round(CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) - value ELSE value - (q3 + 1.5 * (q3 - q1)) END, 6) AS distance
FROM events JOIN b USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
)
def outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.outliers(table(spark, sf_dir, "events"), ["event_type"], places=6).select("event_id", "event_type", "value", "distance")


CANONICAL_KEY = ["country", "indicator", "value", "unit", "scale", "currency", "year", "quarter", "month", "fact_type"]


@query(
    """WITH {facts}, alive AS (SELECT * FROM facts WHERE status <> 'rejected'), human AS (SELECT DISTINCT document_id, sentence FROM alive WHERE origin = 'human')
SELECT fact_id, country, indicator, value, year, origin FROM alive a WHERE origin = 'human' OR NOT EXISTS (SELECT 1 FROM human h WHERE h.document_id = a.document_id AND h.sentence = a.sentence)
QUALIFY row_number() OVER (PARTITION BY country, indicator, value, unit, scale, currency, year, quarter, month, fact_type ORDER BY CASE WHEN origin = 'human' THEN 0 ELSE 1 END, created_at, fact_id DESC) = 1"""
)
def canonical_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.canonical_observations(facts(spark, sf_dir), CANONICAL_KEY).select("fact_id", "country", "indicator", "value", "year", "origin")


@query(
    """WITH {facts} SELECT country, indicator, part, year, quarter, month, unit, scale, currency, fact_type, count(*) AS n_facts, count(DISTINCT value) AS n_values, min(fact_id) AS first_fact
FROM facts WHERE status <> 'rejected' AND year IS NOT NULL AND value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1"""
)
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.conflict_groups(facts(spark, sf_dir), ["part", *consistency.CONFLICT_KEY])


@query(
    """WITH {facts}, e AS (SELECT *, status <> 'rejected' AS ok FROM facts)
SELECT fact_id, status, ok AND min(value) FILTER (WHERE ok) OVER w < max(value) FILTER (WHERE ok) OVER w AS conflict FROM e WINDOW w AS (PARTITION BY part, country, indicator, year, unit, scale, currency)"""
)
def conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.flag_conflicts(facts(spark, sf_dir), ["part", "country", "indicator", "year", "unit", "scale", "currency"]).select("fact_id", "status", "conflict")


@query(
    """WITH {facts} SELECT fact_id, country, value, scale FROM facts QUALIFY row_number() OVER (PARTITION BY country, indicator, year, unit, currency, CASE WHEN currency IS NOT NULL AND scale IS NOT NULL THEN 'money' ELSE scale END,
  CASE WHEN currency IS NOT NULL THEN value::DECIMAL(28,8) * CASE scale WHEN 'million' THEN 1000000 ELSE 1000000000 END ELSE value::DECIMAL(28,8) END ORDER BY fact_id) = 1"""
)
def money_scale_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.deduplicated(facts(spark, sf_dir), ["country", "indicator", "year"]).select("fact_id", "country", "value", "scale")


ROUNDING_ROWS = [(1, "3.2"), (1, "3.24"), (2, "3.2"), (2, "3.27"), (3, "10"), (3, "9.5"), (3, "10.4"), (4, "7"), (5, "-1.25"), (5, "-1.3"), (6, "2,5"), (6, "2,50")]


@golden(
    "WITH r(k, raw) AS (VALUES "
    + ", ".join(f"({k}, '{v}')" for k, v in ROUNDING_ROWS)
    + """), p AS (SELECT k, replace(raw, ',', '.')::DECIMAL(28,8) AS v, min(length(regexp_extract(raw, '[.,](\\d+)$', 1))) OVER (PARTITION BY k) AS d FROM r)
SELECT k, count(DISTINCT v) AS n_values, count(DISTINCT round(v * pow(10, d)::DECIMAL(18,0), 0)) <= 1 AS equivalent FROM p GROUP BY k"""
)
def rounding_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.rounding_groups(spark.createDataFrame(ROUNDING_ROWS, "k int, raw string"), ["k"])


@query(
    """WITH y AS (SELECT o_custkey, year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY ALL), r AS (
  SELECT *, lag(value) OVER w AS reference_value, lag(year) OVER w AS reference_year FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY year)
) SELECT o_custkey, year, value, reference_value, reference_year, round_even(value - reference_value, 4) AS absolute_change, round_even(round_even(value - reference_value, 4) / nullif(abs(reference_value), 0) * 100, 2) AS relative_change,
  CASE WHEN reference_value IS NULL THEN 'none' WHEN value > reference_value THEN 'increase' WHEN value < reference_value THEN 'decrease' ELSE 'stable' END AS direction FROM r"""
)
def fact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return consistency.changes(yearly, ["o_custkey"], ["value"])


PIVOT_YEARS = list(range(1995, 2002))


@query(
    "WITH {facts}, o AS (SELECT country, indicator, unit, part, year, value, min(fact_id) AS fact_id FROM facts GROUP BY ALL) SELECT country, indicator, unit, part, "
    + ", ".join(f"""coalesce(string_agg(value::DECIMAL(18,2)::VARCHAR, ' | ' ORDER BY fact_id) FILTER (WHERE year = {y}), '') AS y{y}""" for y in PIVOT_YEARS)
    + " FROM o GROUP BY country, indicator, unit, part"
)
def horizontal_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = series.horizontal_pivot(facts(spark, sf_dir), ["country", "indicator", "unit", "part"], PIVOT_YEARS)
    return wide.select("country", "indicator", "unit", "part", *(F.coalesce(F.col(str(y)), F.lit("")).alias(f"y{y}") for y in PIVOT_YEARS))


@query("WITH {facts} SELECT source, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'review') AS review, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM facts GROUP BY source")
def status_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.status_crosstab(facts(spark, sf_dir), "source", ["validated", "review", "rejected"])


@query("WITH {facts} SELECT source, count(*) AS n FROM facts GROUP BY source ORDER BY n DESC, source LIMIT 12")
def value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.top_counts(facts(spark, sf_dir), "source")


@query(
    """WITH {facts} SELECT count(*) AS facts, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'review') AS review, count(*) FILTER (WHERE status = 'rejected') AS rejected,
  count(DISTINCT indicator) AS indicators, count(DISTINCT country) AS countries, count(DISTINCT year) AS years, count(*) FILTER (WHERE fact_type = 'forecast') AS forecasts FROM facts"""
)
def overview_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.key_figures(facts(spark, sf_dir))


@query("WITH {facts} SELECT country, indicator, count(*) AS n FROM facts GROUP BY ALL")
def indicator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("country", "indicator").agg(F.count("*").alias("n"))


CHOICE_SQL = """WITH {facts}, best AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY country, indicator, year
  ORDER BY CASE status WHEN 'validated' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, CASE fact_type WHEN 'observed' THEN 0 WHEN 'estimate' THEN 1 ELSE 2 END, confidence DESC, fact_id) = 1)"""


@query(CHOICE_SQL + " SELECT country, indicator, year, fact_id, value, status, fact_type FROM best")
def default_year_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.one_point_a_year(facts(spark, sf_dir), ["country", "indicator"]).select("country", "indicator", "year", "fact_id", "value", "status", "fact_type")


@query(
    CHOICE_SQL.replace("PARTITION BY country, indicator, year", "PARTITION BY country, indicator, currency, year")
    + """, h AS (SELECT * FROM best WHERE fact_type <> 'forecast'), f AS (SELECT * FROM best WHERE fact_type = 'forecast'), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY country, indicator ORDER BY year DESC, fact_id DESC) = 1)
SELECT fact_id, country, indicator, year, value, 'history' AS segment FROM h UNION ALL SELECT fact_id, country, indicator, year, value, 'forecast' FROM f
UNION ALL SELECT fact_id, country, indicator, year, value, 'forecast' FROM b WHERE (country, indicator) IN (SELECT country, indicator FROM f)"""
)
def series_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = series.one_point_a_year(facts(spark, sf_dir), ["country", "indicator", "currency"])
    return series.bridged(points, ["country", "indicator"]).select("fact_id", "country", "indicator", "year", "value", "segment")


@query("WITH {facts} SELECT country, indicator, year, fact_id, value FROM facts WHERE indicator = 'IND-3' AND status <> 'rejected' AND country IN (SELECT n_name FROM nation WHERE n_nationkey < 3)")
def compare_geographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").filter("n_nationkey < 3").select(F.col("n_name").alias("country"))
    return facts(spark, sf_dir).filter("indicator = 'IND-3' AND status <> 'rejected'").join(names, "country", "left_semi").select("country", "indicator", "year", "fact_id", "value")


TREND_SQL = """WITH m AS (SELECT event_type, date_trunc('month', ts)::DATE AS date, sum(value::DECIMAL(18,4))::DOUBLE / count(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL)"""


@query(TREND_SQL + " SELECT event_type, date::VARCHAR AS date, value FROM m")
def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.year("ts").alias("year"), F.month("ts").alias("month"), "value")
    return series.trend_points(rows, ["event_type"]).withColumn("date", F.col("date").cast("string"))


@query(
    """WITH d AS (SELECT event_type, ts::DATE AS date, sum(value::DECIMAL(18,4))::DOUBLE / count(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date) - 1 AS x FROM d),
l AS (SELECT event_type, count(*) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS start FROM i GROUP BY event_type HAVING count(*) >= 3),
e AS (SELECT event_type, any_value(n) AS n, any_value(slope) AS slope, any_value(start) AS start, avg(abs(value - (start + slope * x))) AS error FROM i JOIN l USING (event_type) GROUP BY event_type)
SELECT event_type, step::INT AS step, round(start + slope * (n - 1 + step), 4) AS value, round(slope, 4) AS slope, round(error, 4) AS error FROM e, range(1, 4) t(step)"""
)
def trend_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")
    daily = table(spark, sf_dir, "events").filter("value IS NOT NULL").groupBy("event_type", F.to_date("ts").alias("date")).agg(exact.alias("value"))
    return series.projection(daily, ["event_type"])


@query("WITH {facts}, a AS (SELECT fact_id AS annotated_id, created_at AS annotated_at, sentence AS note FROM facts WHERE status = 'review') SELECT annotated_at, note, fact_id, country, value FROM a JOIN facts ON annotated_id = fact_id")
def annotations_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    notes = rows.filter("status = 'review'").select(F.col("fact_id").alias("annotated_id"), F.col("created_at").alias("annotated_at"), F.col("sentence").alias("note"))
    return repository.annotations_with_facts(notes, rows.select("fact_id", "country", "value"))


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction for every pending order: it is filled, and an urgent one costs 100 more."""
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice"))
    return rows.select("o_orderkey", F.lit("F").alias("o_orderstatus"), price.alias("o_totalprice"))


@query(
    """WITH c AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 100 ELSE o_totalprice END AS p FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS old_value, 'F' AS new_value FROM c
UNION ALL SELECT o_orderkey, 'o_totalprice', o_totalprice::DECIMAL(18,2)::VARCHAR, p::DECIMAL(18,2)::VARCHAR FROM c WHERE p::DECIMAL(18,2) <> o_totalprice::DECIMAL(18,2)"""
)
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.audit(table(spark, sf_dir, "orders"), _corrections(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(
    """WITH {facts} SELECT fact_id, CASE WHEN status = 'review' THEN value + 1 ELSE value END AS value, CASE WHEN status = 'review' THEN 'human' ELSE origin END AS origin, CASE WHEN status = 'review' THEN 'validated' ELSE status END AS status FROM facts"""
)
def corrected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    fixes = rows.filter("status = 'review'").select("fact_id", (F.col("value") + 1).alias("value"))
    return repository.corrected(rows, fixes, "fact_id", ["value"]).select("fact_id", "value", "origin", "status")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM (SELECT event_id, user_id, event_type, coalesce(value, -1) AS value FROM events) GROUP BY user_id")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.coalesce("value", F.lit(-1.0)).alias("value"))
    return repository.current(rows, "user_id", "event_id")


@query("SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def payload_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return repository.overlaid(rows, "props", "event_type string, k bigint", ["event_type"])


@query("SELECT 'OBS-' || lpad(row_number() OVER (ORDER BY o_orderdate, o_orderkey)::VARCHAR, 6, '0') AS observation_id, o_orderkey FROM orders")
def numbered_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return repository.numbered(rows, ["o_orderdate", "o_orderkey"], "OBS").select("observation_id", "o_orderkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return repository.new_documents(table(spark, sf_dir, "orders").select("o_custkey"), stored, "o_custkey")


@query("SELECT doc_id, source, n_chars, length(text) AS text_length FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.length("text").cast("long").alias("text_length"))
    return repository.newest(rows, [F.desc("n_chars"), F.asc("doc_id")], 50)


@query(
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT DISTINCT l_orderkey, 'N' FROM lineitem WHERE l_quantity > 45"""
)
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    incoming = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("N").alias("o_orderstatus")).distinct()
    return repository.replace_documents(stored, incoming, "o_orderkey")


MATCH_SQL = """WITH g AS (SELECT lang, quality AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), p AS (
  SELECT lang, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), m AS (
  SELECT coalesce(g.lang, p.lang) AS lang, sum(least(coalesce(g.n, 0), coalesce(p.n, 0))) AS tp, sum(greatest(coalesce(p.n, 0) - coalesce(g.n, 0), 0)) AS fp, sum(greatest(coalesce(g.n, 0) - coalesce(p.n, 0), 0)) AS fn
  FROM g FULL JOIN p ON g.lang = p.lang AND g.label = p.label GROUP BY 1)"""


@query(MATCH_SQL + " SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) AS f1 FROM m")
def gold_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    gold = rows.select("lang", F.col("quality").alias("label"))
    found = rows.select("lang", (F.col("n_chars") > 400).cast("int").alias("label"))
    return evaluation.scored(evaluation.counted_matches(gold, found, ["lang", "label"], ["lang"]))


VERSIONS = [("v1", 0.70), ("v2", 0.75), ("v3", 0.72), ("v4", 0.9)]


@golden("WITH r(version, f1) AS (VALUES ('v1', 0.70::DOUBLE), ('v2', 0.75), ('v3', 0.72), ('v4', 0.9)) SELECT version, f1, round((f1 - lag(f1) OVER (ORDER BY version)) * 100, 4) AS gain_points, round((f1 - lag(f1) OVER (ORDER BY version)) / lag(f1) OVER (ORDER BY version) * 100, 4) AS gain_relative FROM r")
def benchmark_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gains(spark.createDataFrame(VERSIONS, "version string, f1 double"), "version")


@query("WITH {facts} SELECT fact_id, country, confidence FROM facts WHERE status IN ('validated', 'review') AND fact_type IN ('observed') AND confidence >= 0.5 AND lower(concat_ws(' ', country, source)) LIKE '%0001%'")
def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = {"status": ["validated", "review"], "fact_type": ["observed"]}
    return evaluation.filtered(facts(spark, sf_dir), inside, 0.5, "0001", ["country", "source"]).select("fact_id", "country", "confidence")


SCORE_COLUMNS = "k int, indicator double, amount double, measure double, period double, place double, association double, semantic double, context double, critical boolean, conflict boolean, review boolean, deterministic boolean"
SCORE_ROWS = [
    (1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, False, False, False, False), (2, 0.9, 0.8, None, 0.5, 1.0, 0.62, 0.7, 0.5, False, False, False, False),
    (3, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, True, False, False, True), (4, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, False, True, False, True),
    (5, 0.8, 0.8, 0.8, 0.8, 0.8, 0.8, 0.8, 0.8, False, False, True, False), (6, 0.1, 0.1, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, True, True, True, False), (7, 0.5, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, False, False, False, True),
]
_SCORE_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in SCORE_ROWS)


@golden(
    f"WITH r(k, i, a, m, p, l, s, t, c, critical, conflict, review, sure) AS (VALUES {_SCORE_VALUES}"
    + """), x AS (SELECT *, round(least(greatest(coalesce(i, 0) * 0.17 + coalesce(a, 0) * 0.16 + coalesce(m, 0) * 0.12 + coalesce(p, 0) * 0.17 + coalesce(l, 0) * 0.10 + coalesce(s, 0) * 0.16 + coalesce(t, 0) * 0.08 + coalesce(c, 0) * 0.04
  - CASE WHEN critical THEN 0.30 ELSE 0 END - CASE WHEN conflict THEN 0.15 ELSE 0 END - CASE WHEN review THEN 0.10 ELSE 0 END, 0.05), 0.98), 4) AS score,
  CASE WHEN critical THEN 'rejected' WHEN conflict OR review THEN 'review' WHEN sure OR least(coalesce(i, 0), coalesce(a, 0), coalesce(m, 0), coalesce(p, 0), coalesce(l, 0), coalesce(s, 0), coalesce(t, 0), coalesce(c, 0)) >= 0.78 THEN 'validated' ELSE 'review' END AS final_status FROM r)
SELECT k, score, CASE WHEN conflict THEN least(score, 0.80) ELSE score END AS final_score, final_status, final_status <> 'validated' AS needs_review FROM x"""
)
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consistency.final_status(consistency.evidence_score(spark.createDataFrame(SCORE_ROWS, SCORE_COLUMNS)))
    return rows.select("k", "score", "final_score", "final_status", "needs_review")


@query(
    """WITH {facts} SELECT fact_id, CASE WHEN quarter IS NOT NULL THEN year + (quarter - 1 - 2 - CASE WHEN quarter < 3 THEN 4 ELSE 0 END) // 4 + CASE WHEN quarter < 3 THEN 0 ELSE 0 END END AS q_year, CASE WHEN quarter IS NOT NULL THEN (quarter - 3 + 4) % 4 + 1 END AS q, CASE WHEN month IS NOT NULL THEN (year * 12 + month - 1 + 14) // 12 END AS m_year,
  CASE WHEN month IS NOT NULL THEN (month - 1 + 14) % 12 + 1 END AS m FROM facts""".replace("(quarter - 1 - 2 - CASE WHEN quarter < 3 THEN 4 ELSE 0 END) // 4 + CASE WHEN quarter < 3 THEN 0 ELSE 0 END", "CASE WHEN quarter < 3 THEN -1 ELSE 0 END")
)
def shifted_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two quarters earlier and fourteen months later."""
    rows = facts(spark, sf_dir)
    q_year, q = codes.shift(F.col("year"), F.col("quarter"), -2, 4)
    m_year, m = codes.shift(F.col("year"), F.col("month"), 14, 12)
    return rows.select("fact_id", q_year.alias("q_year"), q.alias("q"), m_year.alias("m_year"), m.alias("m"))


@query("WITH {facts} SELECT DISTINCT series_id, iso3, indicator, unit, scale, currency FROM facts")
def series_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("series_id", "iso3", "indicator", "unit", "scale", "currency").distinct()


@query(
    """WITH {facts}, p AS (SELECT country, indicator, part, year, value, CASE WHEN fact_id % 2 = 0 THEN 1 ELSE 0 END AS places FROM facts WHERE value IS NOT NULL AND year IS NOT NULL),
v AS (SELECT *, CASE WHEN places = 1 THEN round(value::DECIMAL(28,8), 1) ELSE round(value::DECIMAL(28,8), 0) END::DECIMAL(28,8) AS printed, min(places) OVER (PARTITION BY country, indicator, part, year) AS least FROM p)
SELECT country, indicator, part, year, count(DISTINCT printed) AS n_values, count(DISTINCT round(printed * pow(10, least)::DECIMAL(18,0), 0)) <= 1 AS equivalent FROM v GROUP BY ALL"""
)
def fact_rounding_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every fact printed with one decimal or none: whether those of a key and year agree at the coarser place."""
    rows = facts(spark, sf_dir).filter("value IS NOT NULL AND year IS NOT NULL")
    exact = F.col("value").cast("decimal(28,8)")
    printed = F.when(F.pmod("fact_id", F.lit(2)) == 0, F.round(exact, 1).cast("decimal(28,1)").cast("string")).otherwise(F.round(exact, 0).cast("decimal(28,0)").cast("string"))
    keys = ["country", "indicator", "part", "year"]
    return consistency.rounding_groups(rows.select(*keys, F.replace(printed, F.lit("."), F.lit(",")).alias("raw")), keys)


@query(
    """WITH {facts}, y AS (SELECT year, round(count(*) FILTER (WHERE status = 'validated') / count(*), 6) AS f1 FROM facts WHERE year IS NOT NULL GROUP BY year)
SELECT year, f1, round((f1 - lag(f1) OVER (ORDER BY year)) * 100, 4) AS gain_points, round((f1 - lag(f1) OVER (ORDER BY year)) / nullif(lag(f1) OVER (ORDER BY year), 0) * 100, 4) AS gain_relative FROM y"""
)
def yearly_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of validated facts a year, taken as the score of that year's version, and its gains."""
    rows = facts(spark, sf_dir).filter("year IS NOT NULL").groupBy("year").agg(F.round(F.count_if(F.col("status") == "validated") / F.count("*"), 6).alias("f1"))
    return evaluation.gains(rows, "year")

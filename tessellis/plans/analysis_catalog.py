"""Registered queries over sentences with several values, comparisons, display tables and evaluation, all made from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellis.functions import labels
from tessellis.operators import comparisons, consistency, evaluation, preparation, segment
from tessellis.plans.adapters import facts, table
from tessellis.plans.catalog import query

LINE = ["l_orderkey", "l_linenumber"]


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three figures and a year of every line: a, b and c as numbers and as printed with one decimal."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE, "l_linestatus", F.col("l_quantity").alias("a"), F.round(F.col("l_discount") * 100).alias("b"), F.round(F.col("l_tax") * 100).alias("c"), F.year("l_shipdate").alias("y"))
    return lines.withColumns({x.upper() + "_": F.format_string("%.1f", F.col(x)) for x in "abc"})


FIGURES_SQL = "f AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, round(l_discount * 100) AS b, round(l_tax * 100) AS c, year(l_shipdate)::INT AS y FROM lineitem)"


def _printed(shapes: list[str], by: str = "l_linenumber") -> Column:
    """One of the shapes, by line number, with {A} {B} {C} for the figures and {y}, {y+1}, ... for years."""
    out = None
    for k, shape in enumerate(shapes):
        parts = []
        for piece in shape.replace("{", "\x00{").replace("}", "\x00").split("\x00"):
            if not piece.startswith("{"):
                parts.append(F.lit(piece))
            elif piece[1] == "y":
                parts.append((F.col("y") + int(piece[2:] or 0)).cast("string"))
            else:
                parts.append(F.col(f"{piece[1]}_"))
        here = F.pmod(F.col(by), F.lit(len(shapes))) == k
        out = F.when(here, F.concat(*parts)) if out is None else out.when(here, F.concat(*parts))
    return out


BOUND = [
    "Inflation was {A} %, {B} % and {C} % in {y}, {y+1} and {y+2} respectively.",
    "Le taux est passé de {A} % à {B} % entre {y} et {y+3}.",
    "Exports rose to {A} million EUR in {y}, against {B} million EUR a year earlier.",
    "Prices in Morocco grew between {B} and {A} % in {y}.",
    "GDP in France, Italy and Spain grew {A} %, {B} % and {C} % respectively in {y}.",
]


def _row_sql(nr: int, value: str, unit: str | None, scale: str | None, currency: str | None, year: str, iso3: str | None, rule: str) -> str:
    text = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"
    return f"{{'nr': {nr}, 'value': {value}, 'unit': {text(unit)}, 'scale': {text(scale)}, 'currency': {text(currency)}, 'year': {year}, 'iso3': {text(iso3)}, 'rule': {text(rule)}}}"


@query(
    f"WITH {FIGURES_SQL}, r AS (SELECT l_orderkey, l_linenumber, unnest(CASE l_linenumber % 5 WHEN 0 THEN ["
    + ", ".join(_row_sql(k, v, "%", None, None, f"y + {k}", None, "respectively") for k, v in enumerate("abc"))
    + "] WHEN 1 THEN ["
    + ", ".join(_row_sql(k, v, "%", None, None, f"y + {3 * k}", None, "span") for k, v in enumerate("ab"))
    + "] WHEN 2 THEN ["
    + _row_sql(0, "a", None, "million", "EUR", "y", None, "after")
    + ", "
    + _row_sql(1, "b", None, "million", "EUR", "y - 1", None, "back")
    + "] WHEN 3 THEN ["
    + _row_sql(0, "b", "%", None, None, "y", "MAR", "only")
    + ", "
    + _row_sql(1, "a", "%", None, None, "y", "MAR", "after")
    + "] ELSE ["
    + ", ".join(_row_sql(k, v, "%", None, None, "y", ("FRA", "ITA", "ESP")[k], ("only", "only", "after")[k]) for k, v in enumerate("abc"))
    + "] END) AS x FROM f) SELECT l_orderkey, l_linenumber, x.nr AS nr, x.value AS value, x.unit AS unit, x.scale AS scale, x.currency AS currency, x.year AS year, x.iso3 AS iso3, x.rule AS rule FROM r"
)
def line_bound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence with two or three values printed from every line, and its values bound again to years and countries."""
    return comparisons.bound_values(_figures(spark, sf_dir).select(*LINE, _printed(BOUND).alias("clause")), LINE).drop("start", "back")


COMPARISONS = [
    "The rate reached {A} % in {y}, compared with {B} % in {y-1}.",
    "The rate was {A} % while {B} % of firms closed.",
    "Exports rose to {A} million EUR, against {B} million EUR (from {C} million EUR).",
    "Growth of {A} % after {C} %.",
]


@query(
    f"""WITH {FIGURES_SQL}, r AS (SELECT *, l_linenumber % 4 AS k, CASE l_linenumber % 4 WHEN 1 THEN NULL WHEN 3 THEN c ELSE b END AS reference_value FROM f)
SELECT l_orderkey, l_linenumber, a AS value, reference_value, CASE WHEN k IN (0, 2) THEN a - b END AS absolute_change, CASE WHEN k IN (0, 2) THEN round_even((a - b) / nullif(abs(b), 0) * 100, 2) END AS relative_change,
  CASE WHEN k IN (0, 2) THEN CASE WHEN a > b THEN 'increase' WHEN a < b THEN 'decrease' ELSE 'stable' END END AS direction, CASE WHEN k = 1 THEN 0 ELSE 1 END AS comparison_index, CASE WHEN k = 1 THEN 0 ELSE 1 END AS comparison_count FROM r"""
)
def line_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with a sentence printed from every line; a change that brings its reference along keeps it."""
    kind = F.pmod("l_linenumber", F.lit(4))
    rows = _figures(spark, sf_dir).select(
        *LINE, F.col("a").alias("value"), F.when(kind == 3, F.col("c")).alias("reference_value"), F.when(kind == 3, "relative_change").otherwise("level").alias("value_type"), _printed(COMPARISONS).alias("sentence")
    )
    return comparisons.expanded_comparisons(rows).drop("value_type", "sentence")


REASONS = ["Le taux a atteint {A} % en {y}.", "Tableau 3 : {A} {B} {C}", "Prices {A} {B} {C} here", "See (2011), vol. 3, for some prose with words that go on and on at length.", "No measure but {y} in this sentence.", "Only {A} %."]


@query("SELECT l_orderkey, l_linenumber, [NULL, 'no_prose', 'table_row', 'citations', 'no_measure', 'too_short'][l_linenumber % 6 + 1] AS reason, false AS ticks FROM lineitem")
def line_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _figures(spark, sf_dir).select(*LINE, _printed(REASONS).alias("s"))
    return rows.select(*LINE, segment.rejection_reason(F.col("s")).alias("reason"), segment.chart_ticks(F.col("s")).alias("ticks"))


RELATIONS = ["Le taux a atteint {A} %.", "Ce ratio était de {A} %.", "Le taux {A} % en {y}.", "Hausse sur douze mois : {A} %."]


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS k, CASE WHEN l_linestatus = 'F' THEN 'explicit' ELSE 'context' END AS source FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN 1.0 WHEN source = 'context' AND k IN (1, 3) THEN 0.9 WHEN source = 'explicit' THEN 0.82 ELSE 0.62 END::DOUBLE AS strength,
  CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 2 = 0 WHEN l_orderkey % 3 = 1 THEN l_linenumber % 2 = 1 END AS fits
FROM s"""
)
def line_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How firmly a sentence printed from every line binds its value, and whether its measure fits the indicator."""
    rows = _figures(spark, sf_dir).select(*LINE, "l_linestatus", _printed(RELATIONS).alias("s"))
    source = F.when(F.col("l_linestatus") == "F", "explicit").otherwise("context")
    which, odd = F.pmod("l_orderkey", F.lit(3)), F.pmod("l_linenumber", F.lit(2)) == 1
    code = F.when(which == 0, "gdp_growth").when(which == 1, "exports").otherwise("population")
    fits = consistency.unit_compatible(code, F.when(~odd, "%"), F.when(odd, "million"), F.when(odd, "EUR"))
    return rows.select(*LINE, consistency.relation_strength(F.col("s"), source, F.lit("inflation_rate")).alias("strength"), fits.alias("fits"))


@query(
    """WITH {facts}, s AS (SELECT *, least(0.30 + CASE WHEN value IS NOT NULL THEN 0.18 ELSE 0 END + CASE WHEN unit IS NOT NULL OR currency IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN quarter IS NOT NULL OR month IS NOT NULL THEN 0.08 ELSE 0 END
  + CASE WHEN origin = 'human' THEN 0.08 ELSE 0 END + 0.07 + 0.04 + least(length(country) / 200, 0.08) + CASE WHEN fact_type = 'observed' THEN 0.07 ELSE 0 END, 0.96) AS raw_score FROM facts), m AS (SELECT *, round(raw_score * 1000)::INT AS m FROM s)
SELECT fact_id, (CASE WHEN m % 10 = 5 THEN m // 10 + (m // 10) % 2 ELSE round(m / 10) END / 100)::DOUBLE AS score, confidence < 0.64 AS blocked,
  nullif(concat_ws('; ', CASE WHEN confidence < 0.64 THEN 'low confidence' END, CASE WHEN quarter IS NULL AND month IS NULL THEN 'no period' END, CASE WHEN fact_type = 'forecast' THEN 'forecast' END), '') AS reasons FROM m"""
)
def fact_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = facts(spark, sf_dir), F.col
    dated = c("quarter").isNotNull() | c("month").isNotNull()
    found = {"value": c("value").isNotNull(), "unit": c("unit").isNotNull() | c("currency").isNotNull(), "period": dated, "reference": c("origin") == "human", "country": c("country").isNotNull(), "source": c("source").isNotNull()}
    blocked, reasons = consistency.review_reasons({"low confidence": c("confidence") < 0.64}, {"no period": ~dated, "forecast": c("fact_type") == "forecast"})
    return rows.select("fact_id", consistency.confidence_points(c("country"), found, c("fact_type") == "observed").alias("score"), blocked.alias("blocked"), reasons.alias("reasons"))


@query(
    """WITH {facts}, g AS (SELECT country, indicator, year, quarter, month, unit, scale, currency, fact_type FROM facts WHERE status <> 'rejected' AND year IS NOT NULL AND value IS NOT NULL
  GROUP BY ALL HAVING min(value::DECIMAL(28,8)) < max(value::DECIMAL(28,8))), n AS (SELECT country, count(*) AS conflict_groups FROM g GROUP BY country)
SELECT f.country, count(*) AS facts, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'review') AS review, count(*) FILTER (WHERE status = 'rejected') AS rejected,
  coalesce(any_value(n.conflict_groups), 0) AS conflict_groups FROM facts f LEFT JOIN n ON f.country = n.country GROUP BY f.country"""
)
def trace_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.trace_figures(facts(spark, sf_dir), ["country"])


def _displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with what a display asks for beside: variations, references, directions, a need of review."""
    old = F.when(F.col("year") % 2 == 0, F.col("value") - 1)
    return facts(spark, sf_dir).withColumns({
        "variation_value": F.col("confidence") * 100, "variation_unit": F.lit("%"), "reference_value": old, "reference_unit": F.col("unit"), "reference_year": F.when(old.isNotNull(), F.col("year") - 1),
        "reference_quarter": F.lit(None).cast("int"), "reference_month": F.when(old.isNotNull(), F.col("month")), "absolute_change": F.col("value") - old, "relative_change": F.lit(None).cast("double"),
        "comparison_type": F.when(F.col("quarter") == 1, "yoy"), "direction": F.when(old.isNotNull(), "increase"), "needs_review": F.col("status") == "review",
    })


MONTH_SQL = "['" + "', '".join(labels.MONTHS) + "']"
DISPLAY_SQL = (
    "WITH {facts}, o AS (SELECT *, CASE WHEN year % 2 = 0 THEN value - 1 END AS old FROM facts), d AS (SELECT *, "
    "CASE WHEN value_type = 'level' THEN value ELSE confidence * 100 END AS shown_value, CASE WHEN value_type = 'level' THEN unit ELSE '%' END AS shown_unit, "
    f"concat_ws(' ', {MONTH_SQL}[month], 'T' || quarter, year) AS period, coalesce(nullif(CASE WHEN old IS NOT NULL THEN concat_ws(' ', {MONTH_SQL}[month], year - 1) END, ''), 'Non détectée') AS reference_period FROM o)"
)


def _number_sql(value: str, unit: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'Non disponible' ELSE concat_ws(' ', replace(rtrim(rtrim(format('{{:,.2f}}', {value}), '0'), '.'), ',', ' '), {unit}) END"


@query(
    DISPLAY_SQL
    + f""" SELECT fact_id, country, indicator, CASE value_type WHEN 'level' THEN 'Niveau' ELSE 'Variation relative' END AS type, {_number_sql("shown_value", "shown_unit")} AS shown, period, {_number_sql("old", "unit")} AS reference, reference_period,
  CASE WHEN old IS NOT NULL THEN 'Hausse' ELSE 'Non déterminable' END AS direction, CASE WHEN status = 'review' THEN 'À vérifier' ELSE 'Validable' END AS validation, confidence * 100 AS confidence, source, sentence FROM d"""
)
def business_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.business_rows(preparation.prepared(_displayed(spark, sf_dir)), ["fact_id"])


@query(
    DISPLAY_SQL
    + f""" SELECT fact_id, country, indicator, {_number_sql("value", "unit")} AS shown, period, {_number_sql("old", "unit")} AS reference, reference_period, value - old AS absolute_change, NULL::DOUBLE AS relative_change,
  CASE WHEN old IS NOT NULL THEN 'Hausse' ELSE 'Non déterminable' END AS direction FROM d WHERE old IS NOT NULL OR quarter = 1"""
)
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.comparison_rows(preparation.prepared(_displayed(spark, sf_dir)), ["fact_id"])


@query(
    """WITH {facts} SELECT fact_id, CASE WHEN origin = 'human' THEN 'own ' || fact_id WHEN quarter IS NOT NULL THEN year || '-Q' || quarter WHEN month IS NOT NULL THEN year || '-M' || lpad(month::VARCHAR, 2, '0') ELSE year::VARCHAR END AS period FROM facts"""
)
def fact_period_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("origin") == "human", F.concat(F.lit(" own "), F.col("fact_id").cast("string"))).otherwise(" ")
    return facts(spark, sf_dir).select("fact_id", labels.period_code(given, F.col("year"), F.col("quarter"), F.col("month")).alias("period"))


@query(
    """WITH {facts} SELECT count(*) AS facts, count(DISTINCT country) AS countries, count(DISTINCT indicator) AS indicators, count(*) FILTER (WHERE year % 2 = 0) AS comparisons, count(*) FILTER (WHERE status = 'validated') AS validated,
  count(*) FILTER (WHERE year % 2 = 0) AS increase, 0::BIGINT AS decrease, 0::BIGINT AS stable, count(*) FILTER (WHERE year % 2 <> 0) AS unknown FROM facts WHERE status IN ('validated', 'review') AND fact_type IN ('observed', 'forecast') AND year IN (1995, 1996, 1997, 2022, 2023, 2024)"""
)
def dashboard_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preparation.dashboard_rows(_displayed(spark, sf_dir), {"status": ["validated", "review"], "fact_type": ["observed", "forecast"]}, [1995, 1996, 1997, 2022, 2023, 2024])
    return preparation.dashboard_figures(rows)


@query(
    """WITH {facts} SELECT 'all' AS scope, count(*) AS n, sum(fact_id::HUGEINT % 1000003)::BIGINT AS ids FROM facts UNION ALL SELECT 'current', count(*), sum(fact_id::HUGEINT % 1000003)::BIGINT FROM facts WHERE country = 'FRANCE'
UNION ALL SELECT 'filtered', count(*), sum(fact_id::HUGEINT % 1000003)::BIGINT FROM facts WHERE confidence >= 0.5"""
)
def export_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).withColumn("analysis_id", F.col("country"))
    made = [preparation.in_scope(rows, s, "FRANCE", F.col("confidence") >= 0.5).agg(F.lit(s).alias("scope"), F.count("*").alias("n"), F.sum(F.col("fact_id") % 1_000_003).alias("ids")) for s in ("all", "current", "filtered")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("WITH {facts} SELECT fact_id, country, indicator, value, unit, year FROM facts WHERE unit = '%'")
def pruned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).filter("unit = '%'").select("fact_id", "country", "indicator", "value", "unit", "scale", "currency", "year", F.lit(" NaN ").alias("note"), "source")
    return preparation.without_empty_columns(rows, ("source",))


GOLD_KEYS = "country, indicator, value, unit, scale, currency, year, quarter, month"


@query(
    f"""WITH {{facts}}, g AS (SELECT {GOLD_KEYS}, count(*) AS g FROM facts WHERE part % 3 <> 0 GROUP BY ALL), docs AS (SELECT DISTINCT document_id FROM facts WHERE part % 3 <> 0),
p AS (SELECT {GOLD_KEYS}, count(*) AS p FROM facts WHERE part % 4 <> 0 AND document_id IN (SELECT document_id FROM docs) GROUP BY ALL),
j AS (SELECT coalesce(g.country, p.country) AS country, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p ON (g.country, g.indicator, g.value) = (p.country, p.indicator, p.value)
  AND g.unit IS NOT DISTINCT FROM p.unit AND g.scale IS NOT DISTINCT FROM p.scale AND g.currency IS NOT DISTINCT FROM p.currency AND g.year IS NOT DISTINCT FROM p.year AND g.quarter IS NOT DISTINCT FROM p.quarter AND g.month IS NOT DISTINCT FROM p.month),
s AS (SELECT lower(country) AS country, sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM j GROUP BY ALL)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s"""
)
def compared_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows printed in another way (capitals, blanks, decimal commas, plurals) against predictions, for documents in the gold set."""
    rows = facts(spark, sf_dir)
    printed = F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(","))
    unit = F.concat_ws("  ", F.concat(F.initcap("scale"), F.lit("s")), F.col("currency"), F.col("unit"))
    gold = rows.filter("part % 3 <> 0").withColumns({"value": printed, "unit": F.nullif(unit, F.lit("")), "country": F.concat(F.lit(" "), F.col("country"), F.lit("  "))})
    found = evaluation.within_gold(gold, rows.filter("part % 4 <> 0"))
    keys = evaluation.COMPARED
    return evaluation.scored(evaluation.counted_matches(evaluation.compared_rows(gold, [], False), evaluation.compared_rows(found, [], True), keys, ["country"]))


@query(
    """WITH {facts} SELECT indicator, count(*) AS facts, count(*) FILTER (WHERE month = 12) AS december, 0::BIGINT AS no_source, count(*) FILTER (WHERE part % 5 = 0) AS nan_units, count(*) FILTER (WHERE part % 7 = 0) AS noise,
  count(*) FILTER (WHERE country = 'CHINA') AS no_country, count(DISTINCT document_id) AS documents FROM facts GROUP BY indicator"""
)
def regression_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).withColumns({
        "period": F.when(F.col("month").isNotNull(), F.concat(F.col("year").cast("string"), F.lit("-M"), F.lpad(F.col("month").cast("string"), 2, "0"))),
        "unit": F.when(F.col("part") % 5 == 0, "NaN").otherwise(F.col("unit")), "sentence": F.when(F.col("part") % 7 == 0, "le Coefficient estimé").otherwise(F.col("sentence")), "country": F.nullif("country", F.lit("CHINA")),
    })
    return evaluation.regression_figures(rows, ["indicator"])


@query(
    """WITH {facts}, e AS (SELECT * FROM facts WHERE fact_type <> 'estimate'), a AS (SELECT document_id, count(*) AS facts, count(*) FILTER (WHERE part % 2 = 0) AS table_facts, count(*) FILTER (WHERE part % 3 = 0) AS sector_facts, count(*) FILTER (WHERE status = 'validated') AS validated,
  count(*) FILTER (WHERE status = 'review') AS review, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM e GROUP BY ALL), c AS (SELECT document_id, count(*) AS numbers, count(*) FILTER (WHERE value_type <> 'level') AS unresolved FROM facts GROUP BY ALL)
SELECT document_id, coalesce(facts, 0) AS facts, coalesce(table_facts, 0) AS table_facts, coalesce(sector_facts, 0) AS sector_facts, coalesce(validated, 0) AS validated, coalesce(review, 0) AS review, coalesce(rejected, 0) AS rejected, numbers, unresolved FROM c LEFT JOIN a USING (document_id)"""
)
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    events = rows.filter("fact_type <> 'estimate'").withColumns({"table_source": F.when(F.col("part") % 2 == 0, "t"), "sector": F.when(F.col("part") % 3 == 0, "s")})
    coverage = rows.select("document_id", F.when(F.col("value_type") == "level", "extracted").otherwise("unresolved").alias("outcome"))
    return evaluation.document_summary(events, coverage)


PAGES = ["12\n \n  Rapport   annuel\nLe taux a atteint {A} %.", "7\nAnnexe 2\n{A}", "Sommaire\n{A}", "Bibliographie", "{A}. " + "Le texte du rapport. " * 5 + "Annexe A : tableau {B}", "Annexe technique : {A} est ici avant quatre-vingts."]


@query(
    f"""WITH {FIGURES_SQL}, s AS (SELECT *, l_linenumber % 6 AS k, format('{{:.1f}}', a) AS a_ FROM f) SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'Rapport annuel' WHEN 1 THEN 'Annexe 2' WHEN 2 THEN 'Sommaire' WHEN 3 THEN 'Bibliographie'
  WHEN 4 THEN a_ || '. ' || repeat('Le texte du rapport. ', 5) || 'Annexe A : tableau ' || format('{{:.1f}}', b) ELSE 'Annexe technique : ' || a_ || ' est ici avant quatre-vingts.' END AS heading,
  k = 2 AS front, k IN (1, 3, 5) AS back, CASE WHEN k = 4 THEN length(a_ || '. ') + 104 END AS cut_at FROM s"""
)
def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page printed from every line: its heading, whether it is front or back matter, and where an annex within it is cut off."""
    rows, page = _figures(spark, sf_dir).select(*LINE, _printed(PAGES).alias("p")), F.col("p")
    cut = segment.without_inline_annex(page)
    return rows.select(*LINE, segment.heading_of(page).alias("heading"), segment.is_front_matter(page).alias("front"), segment.is_back_matter(page).alias("back"), F.when(cut != page, F.length(cut)).cast("long").alias("cut_at"))


@query(
    """WITH {facts}, g AS (SELECT document_id, indicator, value, unit, year, row_number() OVER (PARTITION BY document_id, indicator ORDER BY value, unit NULLS FIRST, year) AS nr FROM facts),
p AS (SELECT document_id, indicator, value, unit, CASE WHEN part % 2 = 0 THEN year ELSE year + 1 END AS year, row_number() OVER (PARTITION BY document_id, indicator ORDER BY value, unit NULLS FIRST, CASE WHEN part % 2 = 0 THEN year ELSE year + 1 END) AS nr FROM facts WHERE part % 5 <> 0)
SELECT round(avg((p.nr IS NOT NULL AND g.value IS NOT DISTINCT FROM p.value)::INT), 6) AS value, round(avg((p.nr IS NOT NULL AND g.unit IS NOT DISTINCT FROM p.unit)::INT), 6) AS unit, round(avg((p.nr IS NOT NULL AND g.year IS NOT DISTINCT FROM p.year)::INT), 6) AS year FROM g LEFT JOIN p USING (document_id, indicator, nr)"""
)
def component_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of gold facts whose counterpart of the same document and indicator agrees in value, unit and year."""
    rows = facts(spark, sf_dir)
    found = rows.filter("part % 5 <> 0").withColumn("year", F.when(F.col("part") % 2 == 0, F.col("year")).otherwise(F.col("year") + 1))
    return evaluation.component_accuracy(rows, found, ["document_id", "indicator"], ["value", "unit", "year"])


_NEAR_KEYS, _NEAR = ["document_id", "indicator"], ["value", "unit", "year"]


def _nearest_sql() -> str:
    """The rounds of pairing as a chain of tables, one for each set of parts that agree."""
    keys, parts = ", ".join(_NEAR_KEYS), ", ".join(_NEAR)
    steps, last = [], "r8"
    for mask in range(7, -1, -1):
        group = ", ".join([*_NEAR_KEYS, *(p for k, p in enumerate(_NEAR) if mask >> (2 - k) & 1)])
        order = ", ".join(f"{p} NULLS FIRST" for p in _NEAR)
        before = f"OVER (PARTITION BY {group} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        both = f"least(sum(g) OVER (PARTITION BY {group}), sum(p) OVER (PARTITION BY {group}))"
        steps.append(f"s{mask} AS (SELECT *, greatest(least(g, {both} - coalesce(sum(g) {before}, 0)), 0) AS n{mask}, greatest(least(p, {both} - coalesce(sum(p) {before}, 0)), 0) AS q{mask} FROM {last}), r{mask} AS (SELECT * REPLACE (g - n{mask} AS g, p - q{mask} AS p) FROM s{mask})")
        last = f"r{mask}"
    shares = ", ".join(f"round(({' + '.join(f'sum(n{m})' for m in range(8) if m >> (2 - k) & 1)}) / (sum(g) + {' + '.join(f'sum(n{m})' for m in range(8))}), 6) AS {p}" for k, p in enumerate(_NEAR))
    sides = f"SELECT {keys}, {parts}, 1 AS g, 0 AS p FROM facts UNION ALL SELECT {keys}, value, unit, CASE WHEN part % 2 = 0 THEN year ELSE year + 1 END, 0, 1 FROM facts WHERE part % 5 <> 0"
    return f"WITH {{facts}}, r8 AS (SELECT {keys}, {parts}, sum(g)::DOUBLE AS g, sum(p)::DOUBLE AS p FROM ({sides}) GROUP BY ALL), " + ", ".join(steps) + f" SELECT {shares} FROM r0"


@query(_nearest_sql())
def nearest_component_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of gold facts whose nearest counterpart of the same document and indicator agrees, each counterpart used once."""
    rows = facts(spark, sf_dir)
    found = rows.filter("part % 5 <> 0").withColumn("year", F.when(F.col("part") % 2 == 0, F.col("year")).otherwise(F.col("year") + 1))
    return evaluation.nearest_accuracy(rows, found, _NEAR_KEYS, _NEAR)

"""Facts made ready for display: typed and labelled rows, business and comparison tables, filters with their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellis.functions import labels


def prepared(facts: DataFrame) -> DataFrame:
    """``facts`` with the value and unit that count for their type, and the labels of type, direction, periods and review.

    Needs value, unit, variation_value, variation_unit, value_type, direction, year, quarter, month, their reference_ counterparts,
    confidence and needs_review. A level counts by its value, anything else by its variation.
    """
    level = F.col("value_type") == "level"
    c = F.col
    return facts.withColumns({
        "effective_value": F.when(level, c("value")).otherwise(c("variation_value")), "effective_unit": F.when(level, c("unit")).otherwise(c("variation_unit")),
        "value_type_label": labels.labelled(c("value_type"), labels.VALUE_TYPES), "direction_label": labels.labelled(F.coalesce("direction", F.lit("unknown")), labels.DIRECTIONS),
        "period_label": labels.period_text(c("year"), c("quarter"), c("month")), "reference_period_label": labels.period_text(c("reference_year"), c("reference_quarter"), c("reference_month")),
        "confidence_percent": F.coalesce("confidence", F.lit(0.0)) * 100, "review_label": F.when(F.coalesce("needs_review", F.lit(False)), "À vérifier").otherwise("Validable"),
    })


def business_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of prepared rows: what a reader sees of each."""
    text = labels.number_text
    return rows.select(
        *keys, "country", "indicator", F.col("value_type_label").alias("type"), text(F.col("effective_value"), F.col("effective_unit")).alias("shown"), F.col("period_label").alias("period"),
        text(F.col("reference_value"), F.col("reference_unit")).alias("reference"), F.col("reference_period_label").alias("reference_period"), F.col("direction_label").alias("direction"),
        F.col("review_label").alias("validation"), F.col("confidence_percent").alias("confidence"), "source", "sentence",
    )


def comparison_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of prepared rows: those with a reference value or a kind of comparison, both sides beside each other."""
    text = labels.number_text
    compared = rows.filter(F.col("reference_value").isNotNull() | F.col("comparison_type").isNotNull())
    return compared.select(
        *keys, "country", "indicator", text(F.col("value"), F.col("unit")).alias("shown"), F.col("period_label").alias("period"), text(F.col("reference_value"), F.col("reference_unit")).alias("reference"),
        F.col("reference_period_label").alias("reference_period"), "absolute_change", "relative_change", F.col("direction_label").alias("direction"),
    )


def without_empty_columns(rows: DataFrame, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` without the named columns and those that show nothing in any row; an empty table keeps its columns."""
    seen = rows.agg(F.count("*").alias("n"), *(F.max((~labels.is_empty(rows[c])).cast("int")).alias(f"_{k}") for k, c in enumerate(rows.columns))).first()
    if not seen["n"]:
        return rows
    return rows.select(*(c for k, c in enumerate(rows.columns) if c not in dropped and seen[f"_{k}"]))


def in_scope(facts: DataFrame, scope: str, analysis: str | None = None, keep: Column | None = None) -> DataFrame:
    """The rows to export: "all", those of the "current" analysis, or the "filtered" ones."""
    if scope == "current":
        return facts.filter(F.col("analysis_id") == analysis)
    if scope == "filtered":
        return facts.filter(keep if keep is not None else F.lit(True))
    if scope != "all":
        raise ValueError(f"no such scope: {scope}")
    return facts


def dashboard_rows(facts: DataFrame, inside: dict[str, list], years: list[int] = ()) -> DataFrame:
    """Rows inside every list, of the given years or without a year."""
    for name, values in inside.items():
        facts = facts.filter(F.col(name).isin(values))
    return facts.filter(F.col("year").isNull() | F.col("year").isin(list(years))) if years else facts


def dashboard_figures(rows: DataFrame) -> DataFrame:
    """One row: facts, countries, indicators, comparisons, validated, and facts by direction."""
    by = lambda name: F.count_if(F.coalesce("direction", F.lit("unknown")) == name).alias(name)
    return rows.agg(
        F.count("*").alias("facts"), F.count_distinct("country").alias("countries"), F.count_distinct("indicator").alias("indicators"), F.count("reference_value").alias("comparisons"),
        F.count_if(F.col("status") == "validated").alias("validated"), *(by(name) for name in labels.DIRECTIONS),
    )

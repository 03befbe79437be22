"""What is shown of periods, numbers and codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels in use.
MONTHS = ("Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre")
VALUE_TYPES = {"level": "Niveau", "relative_change": "Variation relative", "absolute_change": "Variation absolue"}
DIRECTIONS = {"increase": "Hausse", "decrease": "Baisse", "stable": "Stable", "unknown": "Non déterminable"}
EMPTY = ("", "none", "nan", "null", "<na>")


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; an unknown code as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), code), code)


def period_text(year: Column, quarter: Column, month: Column) -> Column:
    """Month, quarter and year that are there, in words; zero counts as absent."""
    name = F.coalesce(F.get(F.array(*map(F.lit, MONTHS)), month - 1), F.concat(F.lit("M"), F.lpad(month.cast("string"), 2, "0")))
    parts = (F.when(month != 0, name), F.when(quarter != 0, F.concat(F.lit("T"), quarter.cast("string"))), F.when(year != 0, year.cast("string")))
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit("Non détectée"))


def period_code(provided: Column, year: Column, quarter: Column, month: Column) -> Column:
    """The label that a row brings along, else YYYY-Qn before YYYY-Mnn before YYYY, else a dash."""
    text = year.cast("string")
    made = F.when(quarter.isNotNull(), F.concat(text, F.lit("-Q"), quarter.cast("string"))).when(month.isNotNull(), F.concat(text, F.lit("-M"), F.lpad(month.cast("string"), 2, "0"))).otherwise(text)
    return F.coalesce(F.nullif(F.trim(provided), F.lit("")), made, F.lit("—"))


def number_text(value: Column, unit: Column) -> Column:
    """Two decimals at most, thousands by blanks, the unit behind."""
    digits = F.replace(F.regexp_replace(F.format_number(value, 2), r"\.?0+$", ""), F.lit(","), F.lit(" "))
    return F.when(value.isNull() | F.isnan(value), "Non disponible").otherwise(F.concat_ws(" ", digits, F.nullif(unit, F.lit(""))))


def is_empty(value: Column) -> Column:
    """Whether a cell shows nothing: null, NaN, blank or one of the words for it."""
    return value.isNull() | F.lower(F.trim(value.cast("string"))).isin(*EMPTY)

"""Series ids, period keys, unit and status codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_id(iso3: Column, indicator: Column, unit: Column, scale: Column, currency: Column) -> Column:
    """Country, indicator, and six hex digits that stand for unit, scale and currency."""
    parts = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (unit, scale, currency)))
    return F.concat_ws(":", iso3, indicator, F.upper(F.substring(F.sha1(parts.cast("binary")), 1, 6)))


def period_key(year: Column, quarter: Column, month: Column) -> Column:
    """YYYY-Mnn before YYYY-Qn before YYYY; null without a year."""
    text = year.cast("string")
    by_month = F.concat(text, F.lit("-M"), F.lpad(month.cast("string"), 2, "0"))
    return F.when(month.isNotNull(), by_month).when(quarter.isNotNull(), F.concat(text, F.lit("-Q"), quarter.cast("string"))).otherwise(text)


def shift(year: Column, part: Column, by: Column | int, parts: int) -> tuple[Column, Column]:
    """Year and quarter (parts = 4) or month (parts = 12) moved by so many parts; a null year stays null."""
    index = part - 1 + by
    return year + F.floor(index / parts).cast("int"), (F.pmod(index, F.lit(parts)) + 1).cast("int")


# Unit names and what they stand for.
UNITS = {
    "pour cent": "%", "pourcent": "%", "percent": "%", "per cent": "%", "percentage": "%", "بالمئة": "%", "percentage_point": "percentage_point", "points de pourcentage": "percentage_point",
    "tnd": "TND", "dt": "TND", "dinar": "TND", "dinars": "TND", "eur": "EUR", "euro": "EUR", "euros": "EUR", "usd": "USD", "dollar": "USD", "dollars": "USD",
    "million": "million", "millions": "million", "billion": "billion", "milliard": "billion", "milliards": "billion", "points": "point", "jours": "jour",
}


def normalize_unit(unit: Column) -> Column:
    """The canonical unit; an unknown one as it is, trimmed."""
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(unit))), F.trim(unit))


def parse_period(label: Column) -> dict[str, Column]:
    """first and last year, quarter and month of YYYY, YYYY-YYYY, YYYY-Qn and YYYY-Mnn; nulls for anything else."""
    number = lambda pattern, group=1: F.regexp_extract(label, pattern, group).try_cast("int")
    month = number(r"^(?:\d{4})-M(0[1-9]|1[0-2])$")
    quarter = number(r"^(?:\d{4})-Q([1-4])$")
    last = number(r"^(?:\d{4})-(\d{4})$")
    known = label.rlike(r"^\d{4}(-(\d{4}|Q[1-4]|M(0[1-9]|1[0-2])))?$")
    return {"year": F.when(known, F.substring(label, 1, 4).try_cast("int")), "last_year": last, "quarter": quarter, "month": month}


def status_of(text: Column, needs_review: Column) -> Column:
    """validated, review or rejected from any of the labels in use; unknown ones by whether a review is needed."""
    label = F.lower(F.trim(text))
    return (
        F.when(label.isin("validé", "validated", "valid"), "validated").when(label.isin("à vérifier", "pending", "review"), "review")
        .when(label.isin("rejeté", "rejected"), "rejected").when(needs_review, "review").otherwise("validated")
    )


def direction(change: Column) -> Column:
    return F.when(change.isNull(), "none").when(change > 0, "increase").when(change < 0, "decrease").otherwise("stable")

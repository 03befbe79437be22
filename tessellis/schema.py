"""The canonical schema of facts, and how looser tables are brought to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = {
    "fact_id": "bigint", "document_id": "string", "country": "string", "iso3": "string", "indicator": "string", "series_id": "string",
    "value": "double", "unit": "string", "scale": "string", "currency": "string", "year": "int", "quarter": "int", "month": "int",
    "fact_type": "string", "value_type": "string", "status": "string", "confidence": "double", "source": "string", "sentence": "string",
    "origin": "string", "created_at": "timestamp",
}

#: Texts that stand for a missing value.
MISSING = ["", "nan", "none", "null", "<na>"]


def ensure_facts(df: DataFrame) -> DataFrame:
    """All canonical columns, typed; absent ones are null, textual sentinels and NaN become null, others stay."""
    out = {}
    for name, kind in FACTS.items():
        column = F.col(name) if name in df.columns else F.lit(None)
        if kind == "string":
            column = F.when(~F.lower(F.trim(column.cast("string"))).isin(MISSING), column.cast("string"))
        elif kind == "double":
            column = F.when(~F.isnan(column.cast("double")), column.cast("double"))
        else:
            column = column.cast(kind)
        out[name] = column
    return df.withColumns(out)

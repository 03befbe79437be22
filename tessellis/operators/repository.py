"""The repository of analyses and observations: ids, overlays, corrections with an audit, annotations.

Tables are versioned by appending: a correction is a new row of the changed fields plus one audit row a field, and the
current state is the latest version. Nothing is updated in place, so lost executors cost only the write in progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(rows: DataFrame, order: list[str], prefix: str, after: int = 0, name: str = "observation_id") -> DataFrame:
    """Ids PREFIX-nnnnnn that go on from ``after`` in the given order, numbered range by range without one big window."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_place", place).join(F.broadcast(offsets), "_part")  # a row a partition
    number = F.lit(after) + F.col("_before") + F.col("_place")
    return out.withColumn(name, F.concat(F.lit(f"{prefix}-"), F.lpad(number.cast("string"), 6, "0"))).drop("_part", "_place", "_before")


def new_documents(incoming: DataFrame, stored: DataFrame, key: str = "document_id") -> DataFrame:
    """The incoming rows whose id is not stored, one an id."""
    return incoming.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def newest(rows: DataFrame, by: list[Column], limit: int) -> DataFrame:
    """The report of the newest rows: the limit is the feature."""
    return rows.orderBy(*by).limit(limit)


def annotations_with_facts(annotations: DataFrame, facts: DataFrame) -> DataFrame:
    return annotations.join(facts, annotations["annotated_id"] == facts["fact_id"]).drop("annotated_id")


def audit(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for every field that a correction changed: key, field, old and new value as text."""
    kinds = dict(before.dtypes)
    text = lambda df, c: (df[c].cast("decimal(18,2)") if kinds[c] == "double" else df[c]).cast("string")
    cells = F.array(*(F.struct(F.lit(c).alias("field"), text(before, c).alias("old_value"), text(after, c).alias("new_value")) for c in fields))
    joined = before.join(after, before[key] == after[key])
    return joined.select(before[key], F.explode(cells).alias("_c")).select(key, "_c.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def corrected(facts: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``facts`` with the non-null fields of their correction, then of human origin and without need of review."""
    new = corrections.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in fields))
    joined = facts.join(new, facts[key] == F.col("_key"), "left")
    touched = F.col("_key").isNotNull()
    out = joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields} | {"origin": F.when(touched, "human").otherwise(F.col("origin")), "status": F.when(touched, "validated").otherwise(F.col("status"))})
    return out.drop("_key", *(f"_{c}" for c in fields))


def current(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of every key."""
    latest = versions.groupBy(key).agg(F.max_by(F.struct(*(c for c in versions.columns if c != key)), version).alias("_row"))
    return latest.select(key, "_row.*")


def overlaid(rows: DataFrame, payload: str, schema: str, indexed: list[str]) -> DataFrame:
    """The fields of a JSON payload with the indexed columns over them; an indexed column counts even where it is null."""
    parsed = rows.withColumn("_p", F.from_json(payload, schema))
    names = [part.split()[0] for part in schema.split(",")]
    return parsed.withColumns({n: F.col(n) if n in indexed else F.col(f"_p.{n}") for n in names}).drop("_p", payload)


def replace_documents(stored: DataFrame, incoming: DataFrame, key: str = "document_id") -> DataFrame:
    """``stored`` with all rows of the incoming documents replaced by the incoming ones."""
    kept = stored.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)

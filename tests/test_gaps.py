"""Table parsers and detection that the survey names: column matrix, date column."""

from tessellis.operators import tables
from tessellis.sources import ingest


def test_period_rows_by_indicator_columns(spark):
    grid = [["Année", "Inflation", "Chômage", ""], ["2019", "6,7", "15.2", "1"], ["2020 - 2021", "", "17,4", ""], ["Note", "1", "2", ""], ["2020-Q2", "5", "n.d.", ""]]
    got = tables.column_matrix(tables.cells(spark.createDataFrame([(1, grid)], "id int, rows array<array<string>>"), ["id"]), ["id"])
    rows = sorted((r.indicator, r.value, r.year, r.last_year or 0, r.quarter or 0) for r in got.collect())
    assert rows == [("Chômage", 15.2, 2019, 0, 0), ("Chômage", 17.4, 2020, 2021, 0), ("Inflation", 5.0, 2020, 0, 2), ("Inflation", 6.7, 2019, 0, 0)]


def test_date_column_by_its_values(spark):
    body = "Prices rose by 3% in 2020. " * 8
    rows = spark.createDataFrame([("a", "31/12/2020", "12", body), ("b", "2021-01-05", "x", body), ("c", "3 March 2021", "y", body), ("d", "soon", "z", body)], "name string, quand string, k string, corps string")
    assert ingest.date_column(rows) == "quand" and ingest.detected_columns(rows)["publication_date"] == "quand"
    assert ingest.date_column(rows.drop("quand")) is None and ingest.date_column(rows.limit(0)) is None
    assert ingest.date_column(rows.withColumnRenamed("k", "Date")) == "Date"

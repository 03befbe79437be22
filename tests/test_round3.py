"""Findings of round 3: what they found wrong, on small inputs."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellis.functions import text
from tessellis.operators import comparisons, segment
from tessellis.plans import catalog, text_catalog  # noqa: F401
from tests.test_catalog import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    """The smallest scale with every line twice, the second time of the next part, so that no key of a line is unique."""
    at = str(tmp_path_factory.mktemp("sf"))
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    items.unionByName(items.withColumn("l_partkey", F.col("l_partkey") + 1)).write.parquet(f"{at}/lineitem.parquet")
    for name in ("supplier", "nation", "orders"):
        os.symlink(f"{SF}/{name}.parquet", f"{at}/{name}.parquet")
    return at


def by_sql(folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}{'/*.parquet' if os.path.isdir(f'{folder}/{t}') else ''}')")
    return plain(con.execute(catalog.ORACLE_SQL[name]).df())


def test_sentences_keep_their_digits_and_lose_their_blanks(spark):
    rows = spark.createDataFrame([(1, "169.122.221.182 is where it was.  169 of them were there. \n\n  2020 was the year of it  ")], "k int, t string")
    got = [r.sentence for r in segment.sentences(rows, "k", "t").orderBy("nr").collect()]
    assert got == ["169.122.221.182 is where it was.", "169 of them were there.", "2020 was the year of it"]


def test_a_title_keeps_its_digits_and_loses_its_blanks(spark):
    rows = spark.createDataFrame([("  \n 1 report of the year \nmore",), ("short\nshort\n2 short 222222222222\n",)], "t string")
    assert [r.t for r in rows.select(text.title_line(F.col("t")).alias("t")).collect()] == ["1 report of the year", "2 short 222222222222"]


def test_facts_with_the_same_id_stay_apart(spark, doubled):
    got = plain(catalog.QUERIES["fact_long_tables"](spark, doubled).toPandas())
    assert len(got) == 12_000 and got == by_sql(doubled, "fact_long_tables")


def test_values_of_a_clause_are_read_once_a_row(spark):
    """No expression that reads a clause stands twice in the plan, where each step of a lambda would work it out again."""
    rows = spark.createDataFrame([("Growth was 3 % in 2020, 4\ufffe % \uffffand 5 % later.",)], "clause string")
    bound = comparisons.bound_values(rows, [])
    assert bound._jdf.queryExecution().optimizedPlan().toString().count("per cent") == 1
    assert [(r.start, r.value, r.year) for r in bound.orderBy("nr").collect()] == [(11, 3.0, 2020), (34, 5.0, 2020)]
    facts = spark.createDataFrame([("level", 5.0, None, "It rose to 5 % from 3 %.")], "value_type string, value double, reference_value double, sentence string")
    assert comparisons.expanded_comparisons(facts)._jdf.queryExecution().optimizedPlan().toString().count("per cent") == 1

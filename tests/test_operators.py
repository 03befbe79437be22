"""Operators on small inputs of our own."""

import pytest
from pyspark.sql import functions as F

from tessellis.functions import text
from tessellis.operators import consistency, extraction, repository, segment, series, topics
from tessellis.schema import FACTS, ensure_facts
from tessellis.sources import ingest
from tessellis.streaming import ingest as streaming


def docs(spark, *rows):
    return spark.createDataFrame([(f"d{k}", *r) for k, r in enumerate(rows)], "document_id string, title string, text string")


def test_facts_of_several_languages_and_periods(spark):
    got = {(r.document_id, r.indicator, r.value): r for r in extraction.extract_facts(spark.createDataFrame(extraction.EXAMPLES, "document_id string, title string, text string")).collect()}
    assert len(got) == 8
    assert (got["d1", "INFLATION", 5.7].year, got["d1", "INFLATION", 5.6].year) == (2021, 2020)
    assert got["d2", "GDP_GROWTH", 3.2].fact_type == "forecast"
    assert (got["d2", "EXPORTS", 430.0].currency, got["d2", "EXPORTS", 430.0].scale) == ("MAD", "milliard")
    assert (got["d3", "PUBLIC_DEBT", 58.9].year, got["d3", "PUBLIC_DEBT", 58.9].period_source) == (2019, "context")


def test_country_and_indicator_are_carried_within_a_document_only(spark):
    rows = docs(spark, ("Tunisia", "Inflation was high in the spring. It reached 5% in 2020."), ("Nothing", "It reached 6% in 2020 as told."))
    assert [(r.document_id, r.country, r.indicator_source) for r in extraction.extract_facts(rows).collect()] == [("d0", "Tunisia", "context")]


def test_every_number_is_accounted_for(spark):
    rows = docs(spark, ("Egypt", "Inflation was 7% in 2019 with 12 months of data. Some 30% of nothing."))
    got = sorted((r.value, r.outcome) for r in extraction.numeric_coverage(rows).collect())
    assert got == [(7.0, "extracted"), (12.0, "unresolved"), (30.0, "extracted"), (2019.0, "excluded")]


def test_no_documents_give_no_facts(spark):
    assert extraction.extract_facts(docs(spark, ("t", "x")).limit(0)).count() == 0


def test_schema_is_completed_and_sentinels_become_null(spark):
    row = ensure_facts(spark.createDataFrame([("nan", float("nan"), "2020")], "country string, value double, year string")).first()
    assert set(FACTS) <= set(row.asDict()) and row.country is None and row.value is None and row.year == 2020


def test_series_of_rejected_facts_is_empty_with_its_schema(spark):
    rows = ensure_facts(spark.createDataFrame([(1, "IND", 2020, 1.0, "rejected")], "fact_id long, indicator string, year int, value double, status string"))
    got = series.indicator_series(rows)
    assert got.count() == 0 and {"change", "change_percent", "direction"} <= set(got.columns)


def test_a_change_from_zero_has_no_percentage(spark):
    rows = ensure_facts(spark.createDataFrame([(1, "I", 2020, 0.0, "validated"), (2, "I", 2021, 3.0, "validated")], "fact_id long, indicator string, year int, value double, status string"))
    last = series.indicator_series(rows).orderBy("year").collect()[-1]
    assert (last.change, last.change_percent, last.direction) == (3.0, None, "increase")


def test_undated_rows_have_and_are_no_reference(spark):
    rows = spark.createDataFrame([(1, None, 9.0), (1, 2019, 1.0), (1, 2020, 2.0)], "k int, year int, value double")
    got = {(r.year, r.value): r.reference_value for r in consistency.changes(rows, ["k"], ["value"]).collect()}
    assert got == {(2019, 1.0): None, (2020, 2.0): 1.0, (None, 9.0): None}


def test_scales_of_money_agree(spark):
    rows = spark.createDataFrame([(1, 1000.0, "million", "EUR", None), (2, 1.0, "milliard", "EUR", None), (3, 1.1, "milliard", "EUR", None)], "fact_id int, value double, scale string, currency string, unit string")
    assert sorted(r.fact_id for r in consistency.deduplicated(rows, []).collect()) == [1, 3]


def test_outliers_need_four_values_and_a_spread(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 1.0)] * 5 + [(None, 1.0), (None, 9.0)], "k string, value double")
    assert [(r.k, r.value) for r in consistency.outliers(rows, ["k"]).collect()] == [("a", 100.0)]


def test_quantiles_are_exact_with_ties_and_many_values(spark):
    import random

    import numpy as np

    r = random.Random(4)
    groups = {"many": [r.gauss(0, 1) for _ in range(30_000)], "ties": [1.0] * 9_000 + [2.0] * 9_001 + [0.5], "two": [3.0, 1.0], "one": [7.0], None: [2.0, None, 4.0, 9.0], "six": [6.0, 5.0, 4.0, 3.0, 2.0, 1.0]}
    rows = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values] + [("none", None)], "k string, v double")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {x.k: [x[f"q{k}"] for k in range(len(shares))] for x in consistency.exact_quantiles(rows, ["k"], "v", shares).collect()}
    want = {k: np.quantile([v for v in values if v is not None], shares).tolist() for k, values in groups.items()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


def test_numbers_follow_the_order_over_many_partitions(spark):
    rows = spark.range(500).select((500 - F.col("id")).alias("k")).repartition(7)
    got = repository.numbered(rows, ["k"], "OBS", after=10).collect()
    assert sorted((r.k, r.observation_id) for r in got) == [(k, f"OBS-{k + 10:06d}") for k in range(1, 501)]


def test_pages_and_back_matter(spark):
    rows = spark.createDataFrame([(1, "[[PAGE 1]] one [[PAGE 2]] Annex [[PAGE 3]] three"), (2, "no marks")], "id int, text string")
    got = segment.before_back_matter(segment.pages(rows, "id", "text"), "id", "nr", "body")
    assert [(r.id, r.page, r.body) for r in got.orderBy("id", "nr").collect() if r.body] == [(1, 1, "one"), (2, None, "no marks")]


def test_pages_without_text_stay(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "one"), (1, 2, " Références"), (1, 3, "after"), (2, 0, "")], "id int, nr int, body string")
    assert sorted((r.id, r.nr) for r in segment.before_back_matter(rows, "id", "nr", "body").collect()) == [(1, 0), (1, 1), (2, 0)]


def test_text_helpers(spark):
    row = spark.createDataFrame([("Le 3-03-2021, voir https://www.Example.org/x\nUn titre assez long pour compter",)], "t string").select(
        text.first_date(F.col("t")).alias("d"), text.url_host(F.col("t")).alias("h"), text.language(F.col("t")).alias("l"), text.arabic_share(F.lit("مرحبا abc")).alias("a")
    ).first()
    assert (row.d, row.h, row.a, row.l) == ("3-03-2021", "example.org", 0.625, "fr")


def test_csv_with_bom_and_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    body = "Prices rose by 3% in 2020. " * 8
    path.write_text('﻿id;titre;texte\n7;A title of some length;"' + body + '\nand more; of it"\n8;none;\n', encoding="utf-8")
    rows = ingest.read_csv(spark, str(path))
    got = ingest.documents(rows, ingest.detected_columns(rows)).collect()
    assert [(r.document_id, r.title) for r in got] == [("7", "A title of some length")]
    with pytest.raises(ValueError):
        ingest.manual_document(spark, "short")


def test_words_become_lines(spark):
    words = [("d", 1, 0.0, 9.0, 10.0, "Hel"), ("d", 1, 9.5, 20.0, 10.5, "lo"), ("d", 1, 25.0, 40.0, 10.1, "world"), ("d", 1, 0.0, 5.0, 30.0, "12"), ("d", 1, 0.0, 9.0, 50.0, "End")]
    got = ingest.page_lines(spark.createDataFrame(words, "document_id string, page int, x0 double, x1 double, y double, word string"))
    assert [r.text for r in got.orderBy("line").collect()] == ["Hello world", "End"]


SEVERAL = {
    "In France, exports rose by 3% and 4% in 2020 and 2021, respectively.": [("FRA", 3.0, "%", 2020), ("FRA", 4.0, "%", 2021)],
    "Unemployment reached 8% , 9% and 10% in France, Spain and Italy respectively in 2022.": [("FRA", 8.0, "%", 2022), ("ESP", 9.0, "%", 2022), ("ITA", 10.0, "%", 2022)],
    "In Tunisia inflation reached 5.7% in 2021, against 5.0% a year earlier.": [("TUN", 5.7, "%", 2021), ("TUN", 5.0, "%", 2020)],
    "En Tunisie, le chômage était de 15% en 2021. Il était de 14.2% deux ans auparavant.": [("TUN", 15.0, "%", 2021), ("TUN", 14.2, "%", 2019)],
    "In Morocco the public debt went from 70% to 80% between 2019 and 2020.": [("MAR", 70.0, "%", 2019), ("MAR", 80.0, "%", 2020)],
    "In Egypt growth of between 2 and 3% is expected in 2023.": [("EGY", 2.0, "%", 2023), ("EGY", 3.0, "%", 2023)],
    "In Algeria growth was -1.5% in 2020.": [("DZA", -1.5, "%", 2020)],
}


def test_several_values_of_a_sentence(spark):
    rows = spark.createDataFrame([(t, "", t) for t in SEVERAL], "document_id string, title string, text string")
    got = {t: [] for t in SEVERAL}
    for r in extraction.extract_facts(rows).orderBy("sentence_nr", "clause_nr", "at").collect():
        got[r.document_id].append((r.iso3, r.value, r.unit, r.year))
    assert got == SEVERAL


def test_topics_of_their_own_seeds(spark):
    model = topics.train(topics.seeds(spark))
    first = topics.predict(model, topics.seeds(spark), ["label", "text"], best=1)
    assert first.filter("label = topic").count() >= 0.9 * first.count()


def test_stream_gives_the_facts_of_the_batch_run(spark, tmp_path):
    rows = spark.createDataFrame(extraction.EXAMPLES, "document_id string, title string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streaming.stream_facts(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == extraction.extract_facts(rows).count()

"""Findings of round 4: what they found wrong, on small inputs."""

from tessellis.operators import extraction, pages


def test_a_title_gives_its_first_country_and_year(spark):
    titles = [("a", "Royaume-Uni et Maroc 2021, 2022"), ("b", "Report of 1999"), ("c", None), ("d", "Saudi Arabia"), ("e", "xMali 12021"), ("f", "")]
    rows = extraction.title_rows(spark.createDataFrame(titles, "document_id string, title string"))
    got = {r.document_id: (r.title_year, r.title_country) for r in rows.collect()}
    assert got == {"a": (2021, "GBR"), "b": (1999, None), "c": (None, None), "d": (None, "SAU"), "e": (None, None), "f": (None, None)}


def test_facts_and_coverage_of_a_document_start_from_its_title(spark):
    docs = spark.createDataFrame([("a", "Egypt 2020", "Inflation was 3 % then.")], "document_id string, title string, text string")
    assert [(r.iso3, r.period, r.value) for r in extraction.extract_facts(docs).collect()] == [("EGY", "2020", 3.0)]
    assert [(r.value, r.outcome) for r in extraction.numeric_coverage(docs).collect()] == [(3.0, "extracted")]


def test_words_of_one_height_are_one_row_before_they_pass_a_window(spark):
    kind = "document_id string, page int, x0 double, x1 double, y double, word string"
    words = [("d", 1, 40.0, 45.0, 3.0, "here"), ("d", 1, 0.0, 5.5, 1.0, "Infl"), ("d", 1, 4.0, 9.0, 1.0, "FLATION"), ("d", 1, 12.0, 14.0, None, "no"), ("d", 1, 20.0, 25.0, 3.0, "was"), ("d", 1, -9.0, -5.0, 9.0, "cell"), ("d", 1, None, None, 9.0, "nowhere")]
    boxes = spark.createDataFrame([("d", 1, -20.0, -2.0, 8.0, 10.0), ("d", 1, -20.0, 50.0, 50.0, 60.0)], "document_id string, page int, x0 double, x1 double, top double, bottom double")
    rows = pages.page_text(spark.createDataFrame(words, kind), boxes)
    assert [(r.line, r.text) for r in rows.orderBy("line").collect()] == [(0, "InflATION no was here"), (1, "nowhere")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [document_id" in plan[plan.rindex("Window [") :]  # the lowest window is over heights
    assert plan.count("lower(") == 2  # words that overlap are lowered once, however long they are

"""Words to lines, headings and scopes, and grids of several shapes."""

from tessellis.operators import pages, tables


def test_pieces_of_a_word_are_joined_where_they_overlap(spark):
    cases = {("p", "publique"): "publique", ("l'en", "nsemble"): "l'ensemble", ("dette", "ette"): "dette", ("ab", "cd"): "abcd", ("PUB", "ublique"): "PUBlique", ("aaa", "aab"): "aaab", ("x", "x"): "x"}
    rows = spark.createDataFrame([(a, b) for a, b in cases], "a string, b string")
    from pyspark.sql import functions as F

    assert {(r.a, r.b): r.c for r in rows.withColumn("c", pages.overlapped(F.col("a"), F.col("b"))).collect()} == cases


def test_lines_of_layers_tables_and_both_directions(spark):
    words = [
        ("d", 1, 0.0, 4.0, 10.0, "La"), ("d", 1, 6.0, 12.0, 10.5, "p"), ("d", 1, 10.0, 40.0, 10.0, "publique"), ("d", 1, 0.0, 5.0, 30.0, "7"), ("d", 1, 0.0, 9.0, 50.0, "fin"), ("d", 1, 9.2, 10.0, 50.0, "."),
        ("d", 1, 200.0, 210.0, 12.0, "12,5"), ("d", 2, 80.0, 100.0, 10.0, "بلغ"), ("d", 2, 40.0, 70.0, 10.0, "التضخم"), ("d", 2, 20.0, 30.0, 10.0, "%5"), ("d", 3, 0.0, 1.0, 1.0, " "),
    ]
    boxes = spark.createDataFrame([("d", 1, 190.0, 220.0, 0.0, 40.0), ("e", 1, 0.0, 1.0, 0.0, 1.0)], "document_id string, page int, x0 double, x1 double, top double, bottom double")
    table = spark.createDataFrame(words, "document_id string, page int, x0 double, x1 double, y double, word string")
    got = [(r.page, r.text) for r in pages.page_text(table, boxes).orderBy("page", "line").collect()]
    assert got == [(1, "La publique"), (1, "fin."), (2, "بلغ التضخم %5")]
    assert pages.page_text(table.limit(0)).count() == 0


def test_sentences_stand_under_headings(spark):
    text = (
        "CHAPITRE 1 Tunisie\n\nInflation was 5 % in\n2020. Growth fell to 2 %.\nPrices and wages\nWages rose by 3 % a year and\nNobody knows why.\n1.1 Outlook of Morocco\nIt will be 4 %.\n"
        "1.2 Risks\nThey are many and large.\n[[PAGE 2]]\nCHAPTER 2 The world\nAll is well here, it\nseems to be."
    )
    rows = pages.scoped_sentences(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string")).orderBy("nr").collect()
    assert [(r.sentence, r.heading, r.country) for r in rows] == [
        ("Inflation was 5 % in 2020.", "CHAPITRE 1 Tunisie", "TUN"), ("Growth fell to 2 %.", "CHAPITRE 1 Tunisie", "TUN"), ("Wages rose by 3 % a year and Nobody knows why.", "Prices and wages", "TUN"),
        ("It will be 4 %.", "1.1 Outlook of Morocco", "MAR"), ("They are many and large.", "1.2 Risks", "TUN"), ("All is well here, it seems to be.", "CHAPTER 2 The world", None),
    ]
    assert {r.chapter for r in rows} == {"CHAPITRE 1 Tunisie", "CHAPTER 2 The world"}


GRIDS = {
    "long": [["Pays", "Période", "Indicateur", "Valeur", "Unité"], ["Thaïlande", "2025-M02", "Taux directeur", "2,00", "%"], ["Portugal", "2025-Q2", "Chômage", "3,1", "%"]],
    "grouped_columns": [[None, "PIB", None, "Prix"], [None, "2019", "2020", "2020"], ["Industrie", None, None, None], [None, "1,5", "2,5", "3,5"], ["Services", "4", "n.d.", "6"], ["marchands", None, None, None]],
    "sector_blocks": [[None, "2019", "2020"], ["Énergie", None, None], ["Prix", "1", "2"], ["Coûts", "3", None], ["Eau", None, None], ["Prix", "5", "6"]],
    "column_matrix": [[None, "Croissance", "Inflation"], ["2019", "1,1", "2,2"], ["2018–2020", "3,3", None], ["Note", None, None]],
    "sector_average": [["Secteur", "Moyenne (2000-2010)"], ["Textile et", None], [None, "0,5"], ["Mines", "0,7"]],
    "none": [["a", "b"], ["c", "d"]],
}


def test_grids_are_recognised_repaired_and_read(spark):
    cells = tables.cells(spark.createDataFrame([(k, g) for k, g in GRIDS.items()], "id string, rows array<array<string>>"), ["id"])
    got = {}
    for r in tables.structured_facts(cells, ["id"]).collect():
        assert r.id == r.parser
        got.setdefault(r.id, set()).add((r.sector, r.country, r.indicator, r.value, r.year, r.last_year, r.quarter, r.month))
    n = None
    assert got == {
        "long": {(n, "Thaïlande", "Taux directeur", 2.0, 2025, n, n, 2), (n, "Portugal", "Chômage", 3.1, 2025, n, 2, n)},
        "grouped_columns": {("Industrie", n, "PIB", 1.5, 2019, n, n, n), ("Industrie", n, "PIB", 2.5, 2020, n, n, n), ("Industrie", n, "Prix", 3.5, 2020, n, n, n), ("Services marchands", n, "PIB", 4.0, 2019, n, n, n), ("Services marchands", n, "Prix", 6.0, 2020, n, n, n)},
        "sector_blocks": {("Énergie", n, "Prix", 1.0, 2019, n, n, n), ("Énergie", n, "Prix", 2.0, 2020, n, n, n), ("Énergie", n, "Coûts", 3.0, 2019, n, n, n), ("Eau", n, "Prix", 5.0, 2019, n, n, n), ("Eau", n, "Prix", 6.0, 2020, n, n, n)},
        "column_matrix": {(n, n, "Croissance", 1.1, 2019, n, n, n), (n, n, "Inflation", 2.2, 2019, n, n, n), (n, n, "Croissance", 3.3, 2018, 2020, n, n)},
        "sector_average": {("Textile et", n, n, 0.5, 2000, 2010, n, n), ("Mines", n, n, 0.7, 2000, 2010, n, n)},
    }
    assert tables.structured_facts(cells.limit(0), ["id"]).count() == 0


def test_a_header_is_the_longest_name_in_it(spark):
    from pyspark.sql import functions as F

    from tessellis.operators.lexicon import INDICATORS

    heads = {"Dette publique (% PIB)": "PUBLIC_DEBT", "Déficit budgétaire": "BUDGET_DEFICIT", "Taux d'inflation, moyenne": "INFLATION", "Pays": None, None: None}
    rows = spark.createDataFrame([(h,) for h in heads], "h string").withColumn("c", tables.concept(F.col("h"), INDICATORS)).collect()
    assert {r.h: r.c for r in rows} == heads


def test_headings_take_one_shuffle_and_windows_over_parts_only(spark):
    text = "1. Overview\nThe year was good\nfor all. [[PAGE 2]]\r\n\r\nPART TWO\r[[PAGE 3]]Chapter France\nPrices -\nrose by 5. They eased in\nMay. It\nPrices in Morocco\n1.2 Outlook of Tunisia\nIt goes up- ward here.\n"
    docs = spark.createDataFrame([(k, text) for k in range(3)] + [(3, None), (4, "")], "id long, text string")
    got = pages.scoped_sentences(docs, key="id")
    want = [
        (0, "The year was good for all.", "1. Overview", "1. Overview", None), (1, "Prices - rose by 5.", "Chapter France", "Chapter France", "FRA"),
        (2, "They eased in May.", "Chapter France", "Chapter France", "FRA"), (3, "It goes upward here.", "1.2 Outlook of Tunisia", "Chapter France", "TUN"),
    ]
    assert sorted(map(tuple, got.collect())) == [(k, *row) for k in range(3) for row in want]
    plan = docs.transform(pages.scoped_sentences, key="id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1


def test_letters_of_pages_are_not_counted_by_windows_over_words(spark):
    from tessellis.plans import page_catalog

    plan = page_catalog.document_page_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 4  # leap, line, letters by line, number; words were counted in two more, one of them for the boxes
    words = [("d", 1, 80.0, 100.0, 10.0, "بلغ"), ("d", 1, 40.0, 70.0, 10.0, "التضخم"), ("d", 1, 0.0, 9.0, 50.0, "abc"), ("d", 1, 10.0, 19.0, 50.0, "de"), ("e", 1, 0.0, 9.0, 1.0, "بلغ"), ("e", 1, 9.0, 90.0, 9.0, "abcdefgh")]
    got = pages.page_text(spark.createDataFrame(words, "document_id string, page int, x0 double, x1 double, y double, word string")).orderBy("document_id", "line")
    assert [r.text for r in got.collect()] == ["بلغ التضخم", "de abc", "بلغ", "abcdefgh"]

"""Several values in one sentence, comparisons, display and evaluation helpers: golden rows and odd input."""

from pyspark.sql import functions as F

from tessellis.functions import labels, text
from tessellis.operators import comparisons, consistency, evaluation, preparation, segment

CLAUSES = {
    1: ("L'inflation a été de 5,1 %, 4,2 % et 3,3 % en 2019, 2020 et 2021 respectivement.", [(5.1, 2019, "respectively"), (4.2, 2020, "respectively"), (3.3, 2021, "respectively")]),
    2: ("بلغ التضخم 5.1 % و 4.2 % في 2019 و 2020 على التوالي", [(5.1, 2019, "respectively"), (4.2, 2020, "respectively")]),
    3: ("En 2018, le chômage a atteint 15,4 % contre 14,2 % deux ans auparavant.", [(15.4, 2018, "before"), (14.2, 2016, "back")]),
    4: ("Three values of 1 %, 2 % and 3 % in 2019 and 2020 respectively.", [(1.0, None, None), (2.0, None, None), (3.0, 2019, "after")]),
    5: ("Growth was 3 %.", [(3.0, None, None)]),
    6: ("Some 12 firms in 2020.", []),
    7: ("", []),
    8: (None, []),
}


def test_values_of_a_clause(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in CLAUSES.items()], "k int, clause string")
    got = {}
    for r in comparisons.bound_values(rows, ["k"]).orderBy("k", "nr").collect():
        got.setdefault(r.k, []).append((r.value, r.year, r.rule))
    assert got == {k: want for k, (_, want) in CLAUSES.items() if want}
    assert comparisons.bound_values(rows.limit(0), ["k"]).count() == 0


def test_placed_numbers_are_where_they_say(spark):
    t = "De 1 234,5 millions de dinars à 3 % (€ 2.5 milliards d'euros) en 2020, -4 points."
    got = spark.createDataFrame([(t,), (None,)], "t string").select(F.inline_outer(text.placed_numbers(F.col("t")))).collect()
    found = [(t[r.start : r.stop], r.value, r.unit, r.scale, r.currency, r.is_year) for r in got if r.nr is not None]
    assert found == [
        ("1 234,5 millions de dinars", 1234.5, None, "million", "TND", False), ("3 %", 3.0, "%", None, None, False), ("2.5 milliards d'euros", 2.5, None, "milliard", "EUR", False),
        ("2020", 2020.0, None, None, None, True), ("-4 points", -4.0, "point", None, None, False),
    ]


def test_comparisons_keep_the_given_reference_first_and_units_apart(spark):
    facts = [
        (1, "level", 5.0, 4.0, "It rose to 5 % from 3 % and against 4 % with 7 million EUR."), (2, "level", 5.0, None, "It was 5 %."), (3, "level", 5.0, 4.0, "It was 5 %."),
        (4, "absolute_change", 1.0, None, "from 4 % to 5 %"), (5, "level", None, None, "from 4 % to 5 %"), (6, "level", 5.0, None, None), (7, "level", 5.0, None, "from here to there"),
    ]
    rows = spark.createDataFrame(facts, "k int, value_type string, value double, reference_value double, sentence string")
    got = sorted((r.k, r.comparison_index, r.comparison_count, r.reference_value or 0.0, r.relative_change or 0.0) for r in comparisons.expanded_comparisons(rows).collect())
    assert got == [(1, 1, 2, 4.0, 25.0), (1, 2, 2, 3.0, 66.67), (2, 0, 0, 0.0, 0.0), (3, 1, 1, 4.0, 0.0), (4, 0, 0, 0.0, 0.0), (5, 0, 0, 0.0, 0.0), (6, 0, 0, 0.0, 0.0), (7, 0, 0, 0.0, 0.0)]


def test_labels_of_odd_cells(spark):
    rows = spark.createDataFrame([(None, None, None, None, None, None), (2020, 0, 13, 1234567.5, "", " own "), (0, 2, 3, float("nan"), "%", "")], "y int, q int, m int, v double, u string, p string")
    c = F.col
    got = rows.select(labels.period_text(c("y"), c("q"), c("m")).alias("t"), labels.period_code(c("p"), c("y"), c("q"), c("m")).alias("k"), labels.number_text(c("v"), c("u")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("Non détectée", "—", "Non disponible"), ("M13 2020", "own", "1 234 567.5"), ("Mars T2", "0-Q2", "Non disponible")]


def test_columns_that_show_nothing_go(spark):
    rows = spark.createDataFrame([(1, None, "nan", " x"), (2, None, " NONE ", None)], "a int, b string, c string, d string")
    assert preparation.without_empty_columns(rows, ("a",)).columns == ["d"] and preparation.without_empty_columns(rows.limit(0)).columns == rows.columns


def test_reasons_and_strengths(spark):
    prose = ["Le taux a atteint 5 % et 6 % et 7 %.", "Page 3 of (2011) vol. 2 with 3 % reached", "R² = 0.9 dans cette phrase", "Figure 2: 1 2 3 4 5 6 7 8 9 10 11 12", "", None]
    rows = spark.createDataFrame(list(enumerate(prose)), "k int, s string").orderBy("k")
    got = rows.select("k", segment.rejection_reason(F.col("s")).alias("r"), segment.chart_ticks(F.col("s")).alias("t"), consistency.relation_strength(F.col("s"), F.lit("context"), F.lit("x")).alias("w")).orderBy("k").collect()
    assert [(r.r, r.t, r.w) for r in got] == [(None, False, 1.0), (None, False, 0.62), ("no_prose", False, 0.62), ("no_prose", True, 0.62), ("too_short", False, 0.62), ("too_short", None, 0.62)]


def test_gold_of_other_documents_is_no_gold(spark):
    gold = spark.createDataFrame([("d1",)], "document_id string")
    found = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, n int")
    assert [r.n for r in evaluation.within_gold(gold, found).collect()] == [1]
    assert evaluation.within_gold(gold, found.filter("n = 2")).count() == 1


def test_pages_by_their_headings(spark):
    pages = ["\r\n 3 \r\n Copyright 2020", "Annexes", "", None, "a" * 90 + " Appendix B: more", "exclusion des annexes " * 9]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, p string").orderBy("k")
    p = F.col("p")
    got = rows.select("k", segment.heading_of(p).alias("h"), segment.is_front_matter(p).alias("f"), segment.is_back_matter(p).alias("b"), segment.without_inline_annex(p).alias("c")).orderBy("k").collect()
    assert [(r.f, r.b) for r in got] == [(True, False), (False, True)] + [(False, False)] * 4
    assert got[0].h == "Copyright 2020" and got[3].c is None and got[4].c == "a" * 90 and [got[k].c for k in (0, 1, 2, 5)] == [pages[k] for k in (0, 1, 2, 5)]


def test_gold_without_counterpart_agrees_in_nothing(spark):
    gold = spark.createDataFrame([(1, "a", None), (2, "b", None)], "k int, v string, u string")
    row = evaluation.component_accuracy(gold, gold.filter("k = 1"), ["k"], ["v", "u"]).first()
    assert (row.v, row.u) == (0.5, 0.5)

"""One row of each group stays, whatever its ids are."""

from tessellis.llm import jaccard

TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
NEAR = f"zero {TEXT} last"  # 16 shingles of 18 are those of TEXT


def kept(spark, rows):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, other int")
    return sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()), key=str)


def test_one_of_rows_alike_in_id_and_text(spark):
    assert kept(spark, [(1, TEXT)] * 3 + [(2, NEAR), (5, "of its own")]) == [(1, TEXT), (5, "of its own")]


def test_one_of_rows_that_share_the_smallest_id(spark):
    assert [r[0] for r in kept(spark, [(1, TEXT), (1, NEAR), (2, TEXT)])] == [1]


def test_one_of_rows_without_ids_and_ids_before_nulls(spark):
    assert len(kept(spark, [(None, TEXT), (None, NEAR), (None, TEXT)])) == 1
    assert kept(spark, [(None, TEXT), (7, NEAR)]) == [(7, NEAR)]


def test_rows_without_a_set_stay(spark):
    assert len(kept(spark, [(1, ""), (1, ""), (2, None), (2, None)])) == 4

"""Registered queries over pages and tables printed from the given tables: words in boxes, headings, grids of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellis.operators import pages, tables
from tessellis.operators.mentions import worked_out
from tessellis.plans.adapters import table
from tessellis.plans.catalog import query
from tessellis.plans.discourse_catalog import LINES_SQL, _lines

_WORDS = r"[^\s]+"


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents),
w AS (SELECT doc_id, nr, array_to_string(regexp_extract_all(t, '[^ \t\n\r\x0B\f]+'), ' ') AS t FROM l)
SELECT doc_id::VARCHAR AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY nr) - 1)::INT AS line, t AS text FROM w WHERE t <> '' AND NOT regexp_full_match(t, '[0-9]{1,3}')"""
)
def document_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document printed as placed words, some of them in two overlapping layers, with a table beside each line, and read again."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    rtl = F.regexp_count("text", F.lit("[؀-ۿ]")) > pages.RTL_SHARE * F.regexp_count("text", F.lit(r"\p{L}"))  # blanks are no letters
    spread = documents.repartition("document_id")  # texts pass a shuffle before they become words: a table can be a single file
    lines = worked_out(spread, _rtl=rtl).select("document_id", "_rtl", F.posexplode(F.split("text", "\n")).alias("nr", "t"))
    words = lines.select("document_id", "nr", "_rtl", F.posexplode(F.filter(F.split("t", r"[ \t\n\r\x0B\f]+"), lambda w: w != "")).alias("at", "word"))
    start, size = F.col("at") * 1000.0, F.length("word")
    whole = F.struct(start.alias("x0"), (start + size).alias("x1"), F.col("word").alias("word"))
    cut = F.ceil(size / 2).cast("int")
    left = F.struct(start.alias("x0"), (start + cut + 1).alias("x1"), F.substring("word", F.lit(1), cut + 1).alias("word"))
    right = F.struct((start + cut - 1.0).alias("x0"), (start + size).alias("x1"), F.substring("word", cut, size).alias("word"))
    distinct = F.size(F.array_distinct(F.split(F.lower("word"), ""))) == size  # no two signs alike: one overlap only
    layered = F.when(~F.col("_rtl") & (F.pmod("at", F.lit(3)) == 1) & (size >= 4), distinct).otherwise(False)
    cell = F.struct(F.lit(-500.0).alias("x0"), F.lit(-400.0).alias("x1"), F.lit("12,5").alias("word"))
    parts = F.concat(F.when(layered, F.array(left, right)).otherwise(F.array(whole)), F.when(F.col("at") == 0, F.array(cell)).otherwise(F.array().cast("array<struct<x0:double,x1:double,word:string>>")))
    placed = words.select("document_id", F.lit(1).alias("page"), F.col("nr").cast("double").alias("_nr"), "_rtl", F.explode(parts).alias("p")).select("document_id", "page", (F.col("_nr") * 12).alias("y"), "_rtl", "p.*")
    turned = placed.withColumns({"x0": F.when(F.col("_rtl") & (F.col("x0") >= 0), -F.col("x1") - 1e9).otherwise(F.col("x0")), "x1": F.when(F.col("_rtl") & (F.col("x0") >= 0), -F.col("x0") - 1e9).otherwise(F.col("x1"))})
    boxes = documents.select("document_id", F.lit(1).alias("page")).distinct().select("*", F.lit(-600.0).alias("x0"), F.lit(-300.0).alias("x1"), F.lit(-1.0).alias("top"), F.lit(1e12).alias("bottom"))
    text = pages.page_text(turned.drop("_rtl"), boxes)
    return text.select("document_id", (F.row_number().over(W.partitionBy("document_id").orderBy("line")) - 1).alias("line"), "text")


_NAMES = ["Tunisia", "Morocco", "Algeria", "France"]


@query(
    f"""WITH {LINES_SQL}, h AS (SELECT *, nr // 4 AS block, row_number() OVER (PARTITION BY id ORDER BY nr) - 1 AS n FROM l)
SELECT id::VARCHAR AS document_id, n::INT AS nr, 'Figures reached ' || printf('%.2f', a) || ' % here.' AS sentence,
  CASE WHEN nr % 4 = 0 THEN 'Chapter ' || ['Tunisia', 'Morocco', 'Algeria', 'France'][(block % 4 + 1)::INT] WHEN nr % 4 = 3 THEN '1.1 Outlook of ' || ['Tunisia', 'Morocco', 'Algeria', 'France'][(s % 4 + 1)::INT] ELSE 'Prices and costs' END AS heading,
  'Chapter ' || ['Tunisia', 'Morocco', 'Algeria', 'France'][(block % 4 + 1)::INT] AS chapter,
  ['TUN', 'MAR', 'DZA', 'FRA'][(CASE WHEN nr % 4 = 3 THEN s % 4 ELSE block % 4 END + 1)::INT] AS country
FROM h"""
)
def order_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with chapters of countries, titles and sections, sentences broken over two lines: each sentence with what stands above it."""
    pick = lambda at: F.get(F.array(*map(F.lit, _NAMES)), F.pmod(at, F.lit(4)).cast("int"))
    sentence = F.concat(F.lit("Figures reached\n"), F.format_string("%.2f", "a"), F.lit(" % here."))
    form = F.pmod("nr", F.lit(4))
    block = F.floor(F.col("nr") / 4)
    head = F.when(form == 0, F.concat(F.lit("Chapter "), pick(block), F.lit("\n\n"))).when(form == 1, "Prices and costs\n").when(form == 3, F.concat(F.lit("1.1 Outlook of "), pick(F.col("s")), F.lit("\n"))).otherwise("")
    rows = _lines(spark, sf_dir).select("id", "nr", F.concat(head, sentence).alias("t"))
    docs = rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nr", "t"))), lambda x: x["t"]), "\n").alias("text"))
    told = pages.scoped_sentences(docs, key="id")  # by the number of the order: one shuffle for all steps
    return told.select(F.col("id").cast("string").alias("document_id"), "nr", "sentence", "heading", "chapter", "country")


_SHAPED_SQL = """WITH x AS (SELECT l_suppkey AS id, l_suppkey % 4 AS k, l_returnflag AS sector, l_linestatus AS indicator, year(l_shipdate)::INT AS year, l_quantity AS q FROM lineitem)
SELECT id, 'grouped_columns' AS parser, 'Sector ' || sector AS sector, indicator, sum(q) AS value, year, NULL::INT AS last_year FROM x WHERE k = 0 GROUP BY ALL
UNION ALL SELECT id, 'sector_blocks', sector, 'Line ' || indicator, sum(q), year, NULL FROM x WHERE k = 1 GROUP BY ALL
UNION ALL SELECT id, 'column_matrix', NULL, indicator, sum(q), year, NULL FROM x WHERE k = 2 GROUP BY ALL
UNION ALL SELECT id, 'sector_average', sector || ' goods', NULL, sum(q), 1995, 2001 FROM x WHERE k = 3 GROUP BY ALL"""


@query(_SHAPED_SQL)
def supplier_structured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid a supplier in one of four shapes, with labels wrapped over two rows: recognised, repaired and read."""
    base = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("sector"), F.col("l_linestatus").alias("indicator"), F.year("l_shipdate").cast("string").alias("period"), "l_quantity")
    shown = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    cell = lambda r, c, x: (r.cast("int").alias("r"), c.cast("int").alias("c"), x.alias("cell"))
    rank = lambda *order: F.dense_rank().over(W.partitionBy("id").orderBy(*order))
    none, zero = F.lit(None).cast("string"), F.lit(0)

    one = base.filter("id % 4 = 0").groupBy("id", "sector", "indicator", "period").agg(F.sum("l_quantity").alias("v")).withColumns({"c": rank("indicator", "period"), "k": rank("sector")})
    heads = one.groupBy("id", "indicator", "period", "c").agg(F.lit(0).alias("_"))
    again = F.lag("indicator").over(W.partitionBy("id").orderBy("c")).eqNullSafe(F.col("indicator"))
    grouped = heads.select("id", *cell(zero, F.col("c"), F.when(~again, F.col("indicator"))))
    grouped = grouped.unionByName(heads.select("id", *cell(F.lit(1), F.col("c"), F.col("period")))).unionByName(one.select("id", *cell(2 * F.col("k") + 1, F.col("c"), shown("v"))))
    labels = one.select("id", "sector", "k").distinct()  # the word "Sector" stands in a row above the letter's, which has no label
    grouped = grouped.unionByName(labels.select("id", *cell(2 * F.col("k"), zero, F.concat(F.lit("Sector "), F.col("sector")))))

    two = base.filter("id % 4 = 1").groupBy("id", "sector", "indicator", "period").agg(F.sum("l_quantity").alias("v")).withColumn("c", rank("period"))
    two = two.withColumn("k", 2 * rank("sector", "indicator") + 2 * rank("sector"))
    blocks = two.select("id", F.col("period"), "c").distinct().select("id", *cell(zero, F.col("c"), F.col("period")))
    blocks = blocks.unionByName(two.groupBy("id", "sector").agg(F.min("k").alias("k")).select("id", *cell(F.col("k") - 1, zero, F.col("sector"))))
    blocks = blocks.unionByName(two.select("id", "k", "indicator").distinct().select("id", *cell(F.col("k"), zero, F.concat(F.lit("Line "), F.col("indicator"))))).unionByName(two.select("id", *cell(F.col("k"), F.col("c"), shown("v"))))

    three = base.filter("id % 4 = 2").groupBy("id", "indicator", "period").agg(F.sum("l_quantity").alias("v")).withColumns({"c": rank("indicator"), "k": rank("period")})
    matrix = three.select("id", "indicator", "c").distinct().select("id", *cell(zero, F.col("c"), F.col("indicator")))
    matrix = matrix.unionByName(three.select("id", "period", "k").distinct().select("id", *cell(F.col("k"), zero, F.col("period")))).unionByName(three.select("id", *cell(F.col("k"), F.col("c"), shown("v"))))

    four = base.filter("id % 4 = 3").groupBy("id", "sector").agg(F.sum("l_quantity").alias("v")).withColumn("k", 2 * rank("sector"))
    average = four.select("id").distinct().select("id", *cell(zero, F.lit(1), F.lit("Moyenne (1995-2001)")))
    average = average.unionByName(four.select("id", *cell(F.col("k"), zero, F.col("sector")))).unionByName(four.select("id", *cell(F.col("k"), F.lit(1), shown("v")))).unionByName(four.select("id", *cell(F.col("k") + 1, zero, F.lit("goods"))))
    grid = grouped.unionByName(blocks).unionByName(matrix).unionByName(average)
    return tables.structured_facts(grid, ["id"]).select("id", "parser", "sector", "indicator", "value", "year", "last_year")

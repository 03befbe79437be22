"""Documents from CSV, pasted text and page layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessellis.functions import text as T
from tessellis.schema import MISSING

# Column names that say what a column holds.
NAMES = {
    "text": ["texte", "text", "contenu", "content", "article", "body"], "title": ["titre", "title", "headline"], "source": ["source", "journal", "publisher"],
    "publication_date": ["date", "publication_date", "published"], "country": ["pays", "country"], "source_url": ["url", "lien", "link"], "document_id": ["id", "document_id", "doc_id"],
}


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with header and quoted texts over several lines; the separator is the most frequent one of the first line."""
    first = spark.read.text(path).limit(1).first()
    line = (first[0] if first else "").lstrip("﻿")
    separator = max(",;\t|", key=line.count)
    rows = spark.read.csv(path, header=True, sep=separator, multiLine=True, quote='"', escape='"', encoding=encoding)
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def text_column_scores(df: DataFrame) -> DataFrame:
    """(name, score) of every string column: how much it looks like the text of articles. One pass over the table."""
    columns = [c for c, kind in df.dtypes if kind == "string"]
    parts = []
    for c in columns:
        bonus = 3.0 if c.lower() in NAMES["text"] else 0.0
        length = F.length(c)
        distinct = F.count_distinct(c) / F.count(c)
        score = F.lit(bonus) + F.least(F.avg(length) / 500, F.lit(2.5)) + 3 * F.avg((length >= 120).cast("int")) + 1.5 * F.avg(F.contains(c, F.lit(".")).cast("int")) + 0.5 * distinct
        parts.append(F.struct(F.lit(c).alias("name"), F.round(score, 6).alias("score")))
    return df.agg(F.array(*parts).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")


def date_column(df: DataFrame, least: float = 0.65) -> str | None:
    """The column named as a date, else the first of those with the largest share of values that are dates (day first), ``least`` at least."""
    named = next((c for c in df.columns if c.lower() in NAMES["publication_date"]), None)
    columns = [c for c, kind in df.dtypes if kind in ("string", "date", "timestamp")]
    if named or not columns:
        return named
    formats = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "d MMMM yyyy", "d MMM yyyy")
    day = lambda c: F.coalesce(*(F.try_to_timestamp(F.regexp_replace(F.trim(F.col(c).cast("string")), r"[T ]\d{1,2}:\d{2}.*$", ""), F.lit(f)) for f in formats))
    shares = df.agg(*(F.try_divide(F.count(day(c)), F.count(c)).alias(c) for c in columns)).first()
    best = max(columns, key=lambda c: shares[c] or 0.0)
    return best if (shares[best] or 0.0) >= least else None


def detected_columns(df: DataFrame) -> dict[str, str]:
    """Which column holds what: the text by score (1.0 at least), the others by name."""
    found = {kind: next((c for c in df.columns if c.lower() in names), None) for kind, names in NAMES.items()}
    found["publication_date"] = date_column(df)
    best = text_column_scores(df).orderBy(F.desc("score"), "name").first()
    if best is None or best["score"] < 1.0:
        raise ValueError("no column looks like text")
    return {k: v for k, v in (found | {"text": best["name"]}).items() if v}


def documents(rows: DataFrame, columns: dict[str, str], input_type: str = "csv") -> DataFrame:
    """Documents of a table; rows without text go, an id is kept or made from the content, metadata is read off the text."""
    column = lambda kind: F.trim(F.col(columns[kind]).cast("string")) if kind in columns else F.lit(None).cast("string")
    given = lambda kind: F.when(~F.lower(column(kind)).isin(MISSING), column(kind))
    body = T.clean_text(column("text"))
    made = F.sha2(F.concat_ws("\x01", *(F.coalesce(column(k), F.lit("")) for k in ("title", "source", "text"))), 256)
    out = rows.select(
        F.coalesce(given("document_id"), made).alias("document_id"), body.alias("text"), F.coalesce(given("title"), T.title_line(body)).alias("title"),
        F.coalesce(given("source"), T.url_host(body)).alias("source"), F.coalesce(given("publication_date"), T.first_date(body)).alias("publication_date"),
        given("country").alias("country"), given("source_url").alias("source_url"), T.language(body).alias("language"), F.lit(input_type).alias("input_type"),
    )
    return out.filter(F.length("text") > 0)


def manual_document(spark: SparkSession, text: str) -> DataFrame:
    """One pasted text of at least 30 characters."""
    if len(text.strip()) < 30:
        raise ValueError("a document needs at least 30 characters")
    return documents(spark.createDataFrame([(text,)], "text string"), {"text": "text"}, "manual")


def page_lines(words: DataFrame) -> DataFrame:
    """Lines of pages from words (document_id, page, x0, x1, y, word): a row starts where y leaps by over 2.5, words that touch are joined."""
    page = W.partitionBy("document_id", "page")
    leap = (F.col("y") - F.lag("y").over(page.orderBy("y", "x0")) > 2.5).cast("int")
    lined = words.withColumn("_leap", F.coalesce(leap, F.lit(0))).withColumn("line", F.sum("_leap").over(page.orderBy("y", "x0").rowsBetween(W.unboundedPreceding, 0)))
    row = W.partitionBy("document_id", "page", "line").orderBy("x0")
    touches = F.coalesce(F.col("x0") <= F.lag("x1").over(row) + 0.8, F.lit(False))
    parts = lined.withColumn("_part", F.concat(F.when(touches | (F.row_number().over(row) == 1), "").otherwise(" "), F.col("word")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "_part"))), lambda s: s["_part"]), "")
    return parts.groupBy("document_id", "page", "line").agg(text.alias("text")).filter(~F.col("text").rlike(r"^\d{1,3}$"))

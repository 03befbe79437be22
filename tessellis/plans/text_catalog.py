"""Registered queries over texts, tables of cells and lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessellis.functions import codes, text
from tessellis.operators import consistency, extraction, lexicon, segment, tables, topics
from tessellis.plans.adapters import facts, table
from tessellis.plans.catalog import golden, query
from tessellis.sources import ingest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as extraction reads it."""
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), text.title_line(F.col("text")).alias("title"), "text")


WORDS_ORACLE = r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_\x{200C}\x{200D}\x{0600}-\x{06FF}]+')) AS n_words FROM documents"


@query(WORDS_ORACLE)
def count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.count_words(F.col("text")).cast("long").alias("n_words"))


BLANKS_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(32) || chr(133) || chr(160) || chr(5760) || " + " || ".join(f"chr({8192 + k})" for k in range(11)) + " || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


@query(
    r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(translate(text, chr(8206) || chr(8207), ''), chr(65279), ' '), '([\p{L}\p{M}\p{N}_])-\n([\p{L}\p{M}\p{N}_])', '\1\2', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +([,.;:!?%])', '\1', 'g') AS t FROM documents)
SELECT doc_id, md5(trim(t, """
    + BLANKS_SQL
    + ")) AS cleaned FROM s"
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.clean_text(F.col("text")).cast("binary")).alias("cleaned"))


@query(r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\p{L}')) = 0 THEN 0.0::DOUBLE ELSE len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) / len(regexp_extract_all(text, '\p{L}')) END AS arabic FROM documents")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.arabic_share(F.col("text")).alias("arabic"))


LANGUAGE_SQL = r"""WITH s AS (SELECT doc_id, trim(text, {blanks}) AS t FROM documents), n AS (SELECT *, len(regexp_extract_all(t, '[\x{{0600}}-\x{{06FF}}]')) AS ar, len(regexp_extract_all(t, '[A-Za-z\x{{00C0}}-\x{{00FF}}\x{{0600}}-\x{{06FF}}]')) AS letters FROM s)
SELECT doc_id, CASE WHEN t IS NULL OR length(t) < 20 THEN 'unknown' WHEN ar * 4 > letters THEN 'ar' WHEN regexp_matches(lower(t), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(the|and|of|with|for|was|were)($|[^\p{{L}}\p{{M}}\p{{N}}_])') THEN 'en'
  WHEN regexp_matches(lower(t), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(le|la|les|des|de|du|en|avec|pour|est|sont)($|[^\p{{L}}\p{{M}}\p{{N}}_])') THEN 'fr' ELSE 'unknown' END AS language FROM n"""


@query(LANGUAGE_SQL.format(blanks=BLANKS_SQL))
def language_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.language(F.col("text")).alias("language"))


@query(r"SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '(?i)https?://([^/\s?#:]+)', 1)), '^www\.', ''), '') AS host FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))


@query(
    """SELECT doc_id, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1:8], lambda x: length(x) BETWEEN 15 AND 180 AND NOT regexp_matches(lower(x), '^https?://'))[1] AS title FROM documents"""
)
def title_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.title_line(F.col("text")).alias("title"))


@query(
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(h, '(?:^|[^\p{L}\p{M}\p{N}_])(\d{4}-\d{2}-\d{2})(?:$|[^\p{L}\p{M}\p{N}_])', 1), ''), nullif(regexp_extract(h, '(?:^|[^\p{L}\p{M}\p{N}_])(\d{1,2}/\d{1,2}/\d{4})(?:$|[^\p{L}\p{M}\p{N}_])', 1), ''),
  nullif(regexp_extract(h, '(?:^|[^\p{L}\p{M}\p{N}_])(\d{1,2}-\d{1,2}-\d{4})(?:$|[^\p{L}\p{M}\p{N}_])', 1), '')) AS date FROM (SELECT doc_id, substr(text, 1, 3000) AS h FROM documents)"""
)
def first_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.first_date(F.col("text")).alias("date"))


NUMBERS = {"1 234,5": 1234.5, "1.234,5": 1234.5, "1,234.5": 1234.5, "12": 12.0, "3,25": 3.25, "1.234.567": 1234567.0, "2.5": 2.5, "-7,1": -7.1, "45 %": 45.0, "abc": None, "٣٫٥": 3.5, "1.234": 1234.0}


@golden("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if v is None else v}::DOUBLE)" for k, v in NUMBERS.items()) + ") t(raw, value)")
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in NUMBERS], "raw string").select("raw", text.parse_number(F.col("raw")).alias("value"))


@query()
def numeric_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(text.numeric_mentions(F.col("text"))).alias("m"))
    return rows.select("doc_id", "m.*")


PERIODS = {"2020": (2020, None, None, None), "2015-2018": (2015, 2018, None, None), "2021-Q3": (2021, None, 3, None), "2019-M11": (2019, None, None, 11), "soon": (None,) * 4, "2020-Q9": (None,) * 4}


@golden("SELECT label, year::INT AS year, last_year::INT AS last_year, quarter::INT AS quarter, month::INT AS month FROM (VALUES " + ", ".join("('" + k + "', " + ", ".join("NULL" if x is None else str(x) for x in v) + ")" for k, v in PERIODS.items()) + ") t(label, year, last_year, quarter, month)")
def parse_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k,) for k in PERIODS], "label string")
    return rows.select("label", *(c.alias(n) for n, c in codes.parse_period(F.col("label")).items()))


UNITS = {"pour cent": "%", " Percent": "%", "dinars": "TND", "milliards": "billion", "points": "point", "tonnes": "tonnes", "euro": "EUR"}


@golden("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in UNITS.items()) + ") t(unit, canonical)")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in UNITS], "unit string").select("unit", codes.normalize_unit(F.col("unit")).alias("canonical"))


STATUSES = {("Validé", False): "validated", ("pending", False): "review", ("Rejeté", True): "rejected", ("", True): "review", ("other", False): "validated"}


@golden("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(r).lower()}, '{v}')" for (k, r), v in STATUSES.items()) + ") t(label, needs_review, status)")
def status_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(STATUSES), "label string, needs_review boolean")
    return rows.select("label", "needs_review", codes.status_of(F.col("label"), F.col("needs_review")).alias("status"))


SENTENCES_SQL = r"""WITH t AS (SELECT conv_id, turn, replace(replace(replace(text, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10)) AS t FROM conversations),
p AS (SELECT conv_id, turn, string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2) || '|\n\n+') AS parts FROM t),
s AS (SELECT conv_id, turn, unnest(range(len(parts)))::INT AS nr, trim(unnest(parts), ' ') AS sentence FROM p)"""


@query(SENTENCES_SQL + " SELECT * FROM s WHERE length(sentence) >= 12")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return segment.sentences(rows, "key", "text").select("key.conv_id", "key.turn", "nr", "sentence")


@query(
    SENTENCES_SQL
    + r""", squeezed AS (SELECT conv_id, turn, nr, trim(regexp_replace(sentence, '\s+', ' ', 'g')) AS x FROM s WHERE length(sentence) >= 12)
SELECT conv_id, turn, nr, CASE WHEN length(x) < 18 THEN 'too_short' WHEN regexp_matches(x, '(?i)^(tableau|graphique|figure|encadr[eé]) *\d+ *[:.-]|^sources? *: *[^.!?]{0,120}$|^(variable|coefficient)\b|\br *[²2]\b|\bp[- ]?value\b|([A-Za-z]{1,8} *= *){2,}') THEN 'no_prose'
  WHEN len(regexp_extract_all(x, '[-+]?\d+([.,]\d+)?')) >= 3 AND len(regexp_extract_all(x, '[A-Za-zÀ-ÿ]+')) <= 14 AND NOT regexp_matches(x, '(?i)\b(stood at|reached|rose to|fell to|increased to|decreased to|compared with|compared to|contre)\b') THEN 'table_row'
  WHEN NOT regexp_matches(x, '(?i)[-+]?\d+([.,]\d+)?\s*(%|pour cent|percent|points?|milliards?|millions?|md\b|tnd\b|usd\b|eur\b|jours?)') THEN 'no_measure' END AS reason FROM squeezed"""
)
def sentence_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return segment.sentences(rows, "key", "text").select("key.conv_id", "key.turn", "nr", segment.rejection_reason(F.col("sentence")).alias("reason"))


@query(
    SENTENCES_SQL.replace("conv_id, turn", "doc_id").replace("conversations", "documents")
    + r""", w AS (SELECT doc_id, nr, sentence, list_filter(string_split_regex(sentence, '(?i)\s*;\s*|,?\s+(?:tandis que|alors que|while|whereas|et que)\s+'), lambda x: length(x) >= 12) AS parts FROM s WHERE length(sentence) >= 12),
k AS (SELECT doc_id, nr, CASE WHEN regexp_matches(sentence, '(?i)respecti(vely|vement)') OR len(parts) = 0 THEN [sentence] ELSE parts END AS parts FROM w)
SELECT doc_id, nr, unnest(range(len(parts)))::INT AS clause_nr, unnest(parts) AS clause FROM k"""
)
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.sentences(_documents(spark, sf_dir), "doc_id", "text")
    return segment.clauses(rows, ["doc_id", "nr"])


@query(
    r"""SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN conv_id % 2 = 0 AND turn = 2 OR regexp_matches(coalesce(text, ''), '(?i)^\s*(annex|appendix|bibliograph|references|références)') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS stop
FROM conversations) WHERE stop = 0"""
)
def page_stop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read as documents, their turns as pages: the third turn of every other one stands for the annex."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") == 2), "Annex").otherwise(F.col("text")).alias("body"))
    return segment.before_back_matter(rows, "conv_id", "turn", "body").select("conv_id", "turn")


@query(
    """WITH c AS (SELECT count(*) AS n, avg(length(text)) AS m, avg((length(text) >= 120)::INT) AS long_share, avg(contains(text, '.')::INT) AS sentence_share, count(DISTINCT text) / count(text) AS distinct_share FROM documents),
s AS (SELECT count(*) AS n, avg(length(source)) AS m, avg((length(source) >= 120)::INT) AS long_share, avg(contains(source, '.')::INT) AS sentence_share, count(DISTINCT source) / count(source) AS distinct_share FROM documents),
u AS (SELECT 'text' AS name, 3.0 AS bonus, * FROM c UNION ALL SELECT 'source', 0.0, * FROM s)
SELECT name, round(bonus::DOUBLE + least(m / 500, 2.5::DOUBLE) + 3 * long_share + 1.5::DOUBLE * sentence_share + 0.5::DOUBLE * distinct_share, 6) AS score FROM u"""
)
def csv_schema_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.text_column_scores(_documents(spark, sf_dir).select("text", "source"))


WIDE = [("Tunisia", 2019, "6,7", "15.2"), ("Tunisia", 2020, "5.6", "n.d."), ("Morocco", 2019, "0,2", "9")]


@golden("SELECT * FROM (VALUES ('Tunisia', 2019::BIGINT, 'inflation', 6.7::DOUBLE), ('Tunisia', 2019, 'unemployment', 15.2), ('Tunisia', 2020, 'inflation', 5.6), ('Morocco', 2019, 'inflation', 0.2), ('Morocco', 2019, 'unemployment', 9)) t(country, year, indicator, value)")
def wide_table_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(WIDE, "country string, year bigint, inflation string, unemployment string")
    return tables.unpivoted(rows, ["country", "year"], ["inflation", "unemployment"])


LONG = [(1, [["Pays", "Période", "Indicateur", "Valeur", "Unité"], ["Tunisie", "2020-Q2", "PIB", "-21,6", "%"], ["Maroc", "2019", "Inflation", "0,2", "%"], ["Maroc", "x", "Inflation", "-", ""]])]
GROUPED = [(1, [["", "Exports", "", "Imports"], ["Sector", "2019", "2020", "2020"], ["Textile", "1,5", "2", "3"], ["Food", "4", "", "5,25"]])]
BLOCKS = [(1, [["", "2019", "2020"], ["Textile", "", ""], ["Exports", "1", "2"], ["Imports", "3,5", ""], ["Food", "", ""], ["Exports", "7", "8"]])]
GRID = "id int, rows array<array<string>>"


@golden("SELECT * FROM (VALUES (1, 1, 'Tunisie', 'PIB', -21.6::DOUBLE, '%', 2020, NULL::INT, 2, NULL::INT), (1, 2, 'Maroc', 'Inflation', 0.2, '%', 2019, NULL, NULL, NULL)) t(id, r, country, indicator, value, unit, year, last_year, quarter, month)")
def long_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.long_table(tables.cells(spark.createDataFrame(LONG, GRID), ["id"]), ["id"])


@golden("SELECT * FROM (VALUES (1, 'Textile', 'Exports', '2019', 1.5::DOUBLE), (1, 'Textile', 'Exports', '2020', 2), (1, 'Textile', 'Imports', '2020', 3), (1, 'Food', 'Exports', '2019', 4), (1, 'Food', 'Imports', '2020', 5.25)) t(id, sector, indicator, period, value)")
def grouped_columns_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grouped_columns(tables.cells(spark.createDataFrame(GROUPED, GRID), ["id"]), ["id"])


@golden("SELECT * FROM (VALUES (1, 'Textile', 'Exports', '2019', 1::DOUBLE), (1, 'Textile', 'Exports', '2020', 2), (1, 'Textile', 'Imports', '2019', 3.5), (1, 'Food', 'Exports', '2019', 7), (1, 'Food', 'Exports', '2020', 8)) t(id, sector, indicator, period, value)")
def sector_blocks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sector_blocks(tables.cells(spark.createDataFrame(BLOCKS, GRID), ["id"]), ["id"])


NAMES = [("de la", "DE LA", "C"), ("of the", "OF THE", "A")]


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS two FROM w)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE two = 'de la') AS de_la FROM g WHERE two IN ('de la', 'of the') GROUP BY doc_id"""
)
def name_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lexicon.aliases(spark, NAMES)
    found = lexicon.mentions(_documents(spark, sf_dir), ["doc_id"], "text", names)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("code") == "C").alias("de_la"))


CURRENCY_ROWS = [("le dinar a baissé", "TUN", "TND"), ("le dinar a baissé", "DZA", "DZD"), ("le dinar a baissé", None, None), ("100 EUR", "TUN", "EUR"), ("cinq dirhams", None, "MAD"), ("rien", "TUN", None)]


@golden("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::VARCHAR" if x is None else f"'{x}'" for x in row) + ")" for row in CURRENCY_ROWS) + ") t(sentence, iso3, currency)")
def currency_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in CURRENCY_ROWS], "sentence string, iso3 string")
    return rows.select("sentence", "iso3", lexicon.currency_of(F.col("sentence"), F.col("iso3")).alias("currency"))


@query()
def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_facts(_titled(spark, sf_dir))


@query()
def numeric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.numeric_coverage(_titled(spark, sf_dir))


@query()
def topic_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = topics.train(topics.seeds(spark))
    return topics.predict(model, _documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])


_SCORES_SQL = (
    "WITH described(code, text) AS (VALUES " + ", ".join("('%s', '%s')" % (c, t.replace("'", "''")) for c, t in topics.DESCRIPTIONS.items()) + r"""),
p AS (SELECT 'd' AS side, code, NULL::BIGINT AS doc_id, lower(text) AS t FROM described UNION ALL SELECT 'q', '', doc_id, lower(text) FROM documents WHERE length(trim(text, E' \t\n\r')) >= 5),
w AS (SELECT side, code, doc_id, regexp_extract_all(t, '[\p{L}\p{N}_]{2,}') AS ws FROM p),
wg AS (SELECT side, code, doc_id, 'w' AS kind, unnest(list_concat(ws, list_filter(list_transform(list_zip(ws, ws[2:]), lambda z: z[1] || ' ' || z[2]), lambda g: g IS NOT NULL))) AS gram FROM w),
x AS (SELECT side, code, doc_id, ' ' || unnest(string_split_regex(t, '\s+')) || ' ' AS x FROM p),
cg AS (SELECT side, code, doc_id, 'c' AS kind, unnest(list_transform(range(1, length(x) - n + 2), lambda i: substr(x, i, n))) AS gram FROM x, (VALUES (3), (4), (5)) l(n) WHERE length(x) > 2),
tf AS (SELECT side, code, doc_id, kind, gram, count(*) AS n FROM (FROM wg UNION ALL FROM cg) GROUP BY ALL),
idf AS (SELECT kind, gram, ln(17.0 / (1 + count(*))) + 1 AS idf FROM tf WHERE side = 'd' GROUP BY ALL),
raw AS (SELECT side, code, doc_id, kind, gram, (1 + ln(n)) * idf AS w FROM tf JOIN idf USING (kind, gram)),
unit AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY side, code, doc_id, kind)) AS u FROM raw),
kinds AS (SELECT doc_id, count(DISTINCT kind) AS n FROM raw WHERE side = 'q' GROUP BY doc_id),
dots AS (SELECT q.doc_id, d.code, sum(q.u * d.u) AS dot FROM unit q JOIN unit d USING (kind, gram) WHERE q.side = 'q' AND d.side = 'd' GROUP BY ALL)
SELECT p.doc_id, c.code, round(coalesce(dot / sqrt(2.0 * k.n), 0), 4) AS score FROM p JOIN described c ON p.side = 'q' LEFT JOIN kinds k ON k.doc_id = p.doc_id LEFT JOIN dots ON dots.doc_id = p.doc_id AND dots.code = c.code"""
)


@query(_SCORES_SQL)
def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.similarity(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id", topics.descriptions(spark))


# The operators of the literal rows above, over whole tables.

_MENTIONS_SQL = (
    "names(kind, alias, code) AS (VALUES "
    + ", ".join([f"('country', '{a}', '{code}')" for a, (_, code) in lexicon.COUNTRIES.items()] + [f"('indicator', '{a}', '{code}')" for a, code in lexicon.INDICATORS.items()])
    + r"""),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS "at" FROM w),
g AS (SELECT doc_id, "at", n AS length, array_to_string(w["at":"at" + n - 1], ' ') AS gram FROM a, range(1, 5) t(n) WHERE "at" + n - 1 <= len(w)),
h AS (SELECT doc_id, kind, code, "at", length, max("at" + length) OVER (PARTITION BY doc_id, kind ORDER BY "at", length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM g JOIN names ON gram = alias),
found AS (SELECT doc_id, kind, code, "at" FROM h WHERE ended IS NULL OR "at" + length > ended)"""
)


@query("WITH " + _MENTIONS_SQL + " SELECT * FROM found")
def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator and country that a document names, with its place."""
    rows = _documents(spark, sf_dir)
    parts = [lexicon.mentions(rows, ["doc_id"], "text", names).select("doc_id", F.lit(kind).alias("kind"), "code", F.col("at").cast("long").alias("at")) for kind, names in (("country", lexicon.country_names(spark)), ("indicator", lexicon.indicator_names(spark)))]
    return parts[0].unionAll(parts[1])


_OWN_SQL = "CASE iso3 " + " ".join(f"WHEN '{c}' THEN '{money}'" for c, money in lexicon.CURRENCIES.items()) + " END"
_MATCHING_SQL = ", ".join(f"CASE WHEN list_contains(w, '{name}') AND own IN ({', '.join(repr(x) for x in known)}) THEN own END" for name, known in lexicon.DENOMINATIONS.items())
_SINGLE_SQL = ", ".join(f"CASE WHEN list_contains(w, '{name}') THEN '{known[0]}' END" for name, known in lexicon.DENOMINATIONS.items() if len(known) == 1)


@query(
    "WITH " + _MENTIONS_SQL + ", first AS (SELECT doc_id, arg_min(code, \"at\") AS iso3 FROM found WHERE kind = 'country' GROUP BY doc_id), "
    + r"c AS (SELECT doc_id, w, iso3, " + _OWN_SQL + r" AS own, nullif(regexp_extract(text, '(^|[^\p{L}\p{N}_])(" + "|".join(sorted(set(lexicon.CURRENCIES.values()))) + r")($|[^\p{L}\p{N}_])', 2), '') AS stated FROM documents JOIN w USING (doc_id) LEFT JOIN first USING (doc_id)) "
    + f"SELECT doc_id, iso3, coalesce(stated, {_MATCHING_SQL}, {_SINGLE_SQL}) AS currency FROM c"
)
def document_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency of every document, its country being the first it names."""
    rows = _documents(spark, sf_dir)
    first = lexicon.mentions(rows, ["doc_id"], "text", lexicon.country_names(spark)).groupBy("doc_id").agg(F.min_by("code", "at").alias("iso3"))
    return rows.join(first, "doc_id", "left").select("doc_id", "iso3", lexicon.currency_of(F.col("text"), F.col("iso3")).alias("currency"))


LINE = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price, round(l_discount * 100) AS discount FROM lineitem")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed in four ways, by line number, and discounts in percent, read again."""
    english = F.format_number("l_extendedprice", 2)
    form = F.pmod("l_linenumber", F.lit(4))
    price = F.when(form == 0, english).when(form == 1, F.translate(english, ",.", " ,")).when(form == 2, F.translate(english, ",.", ".,")).otherwise(F.replace(english, F.lit(","), F.lit("")))
    percent = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" %"))
    return table(spark, sf_dir, "lineitem").select(*LINE, text.parse_number(price).alias("price"), text.parse_number(percent).alias("discount"))


@query(
    """SELECT l_orderkey, l_linenumber, year(l_shipdate)::INT AS year, CASE WHEN l_linenumber % 4 = 1 THEN year(l_shipdate)::INT + 1 END AS last_year, CASE WHEN l_linenumber % 4 = 2 THEN quarter(l_shipdate)::INT END AS quarter,
  CASE WHEN l_linenumber % 4 = 3 THEN month(l_shipdate)::INT END AS month FROM lineitem"""
)
def line_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates printed as year, range, quarter or month, by line number, and read again."""
    year, form = F.year("l_shipdate").cast("string"), F.pmod("l_linenumber", F.lit(4))
    label = F.when(form == 0, year).when(form == 1, F.concat_ws("-", year, (F.year("l_shipdate") + 1).cast("string"))).when(form == 2, F.concat(year, F.lit("-Q"), F.quarter("l_shipdate").cast("string"))).otherwise(F.concat(year, F.lit("-M"), F.date_format("l_shipdate", "MM")))
    rows = table(spark, sf_dir, "lineitem").select(*LINE, label.alias("label"))
    return rows.select(*LINE, *(c.alias(n) for n, c in codes.parse_period(F.col("label")).items()))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN '%' WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'million' WHEN l_linestatus = 'O' THEN 'billion' ELSE l_linestatus END AS canonical FROM lineitem")
def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the lines, printed in French and English, made canonical; unknown ones stay."""
    even = F.pmod("l_linenumber", F.lit(2)) == 0
    unit = F.when((F.col("l_linestatus") == "F") & even, "Pour cent ").when(F.col("l_linestatus") == "F", " per cent").when((F.col("l_linestatus") == "O") & even, "Millions").when(F.col("l_linestatus") == "O", "milliards").otherwise(F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(*LINE, codes.normalize_unit(unit).alias("canonical"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'validated' WHEN o_orderstatus = 'O' OR o_totalprice >= 200000 THEN 'review' ELSE 'validated' END AS status FROM orders")
def order_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labels: finished ones validated, open ones to be looked at, others by their price."""
    label = F.when(F.col("o_orderstatus") == "F", " Validé").when(F.col("o_orderstatus") == "O", "À vérifier").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.status_of(label, F.col("o_totalprice") >= 200000).alias("status"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"SELECT l_orderkey, l_linenumber, indicator, value FROM (SELECT l_orderkey, l_linenumber, {', '.join(MEASURES)} FROM lineitem) UNPIVOT (value FOR indicator IN ({', '.join(MEASURES)}))")
def line_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*LINE, *(F.col(c).cast("string").alias(c) for c in MEASURES))
    return tables.unpivoted(rows, LINE, MEASURES)


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by supplier, return flag, line status and ship year: what a printed table of each supplier holds."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("sector"), F.col("l_linestatus").alias("indicator"), F.year("l_shipdate").cast("string").alias("period"))
    return rows.agg(F.sum("l_quantity").alias("value"))


_SUMS_SQL = "SELECT l_suppkey AS id, l_returnflag AS sector, l_linestatus AS indicator, year(l_shipdate)::VARCHAR AS period, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


def _rank(*order: str) -> Column:
    return F.dense_rank().over(W.partitionBy("id").orderBy(*order))


def _printed(value: str) -> Column:
    return F.replace(F.col(value).cast("string"), F.lit("."), F.lit(","))


@query(
    """WITH {facts} SELECT id, country, indicator, value, unit, year, last_year, quarter, month FROM (SELECT fact_id AS id, country, indicator, value, unit, year, NULL::INT AS last_year, quarter, month FROM facts)"""
)
def fact_long_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact printed as the line of a table with a header, and read again; lines of one order that share number and price share an id, so a table."""
    period = codes.period_key(F.col("year"), F.col("quarter"), F.col("month"))
    head = [F.lit(x) for x in ("Pays", "Période", "Indicateur", "Valeur", "Unité")]
    body = [F.col("country"), period, F.col("indicator"), _printed("value"), F.col("unit")]
    lines = facts(spark, sf_dir).groupBy(F.col("fact_id").alias("id")).agg(F.collect_list(F.array(*body)).alias("body"))
    grids = lines.select("id", F.concat(F.array(F.array(*head)), "body").alias("rows"))
    return tables.long_table(tables.cells(grids, ["id"]), ["id"]).drop("r")


@query(_SUMS_SQL)
def supplier_grouped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table a supplier: statuses over years across (each status printed once), return flags down."""
    rows = _sums(spark, sf_dir).withColumns({"c": _rank("indicator", "period"), "r": _rank("sector") + 1})
    columns = rows.groupBy("id", "indicator", "c", "period").agg(F.lit(0).alias("_"))
    leads = F.lag("indicator").over(W.partitionBy("id").orderBy("c")).eqNullSafe(F.col("indicator"))
    top = columns.select("id", F.lit(0).alias("r"), "c", F.when(~leads, F.col("indicator")).alias("cell"))
    second = columns.select("id", F.lit(1).alias("r"), "c", F.col("period").alias("cell"))
    labels = rows.groupBy("id", "r", F.col("sector").alias("cell")).agg(F.lit(0).alias("c")).select("id", "r", "c", "cell")
    grid = top.unionByName(second).unionByName(labels).unionByName(rows.select("id", "r", "c", _printed("value").alias("cell")))
    return tables.grouped_columns(grid, ["id"])


@query(_SUMS_SQL)
def supplier_sector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table a supplier: years across, a heading a return flag, its statuses under it."""
    rows = _sums(spark, sf_dir).withColumn("c", _rank("period"))
    headings = rows.select("id", "sector", F.lit(None).cast("string").alias("indicator"), F.lit(0).alias("c"), F.col("sector").alias("cell")).distinct()
    labels = rows.select("id", "sector", "indicator", F.lit(0).alias("c"), F.col("indicator").alias("cell")).distinct()
    body = rows.select("id", "sector", "indicator", "c", _printed("value").alias("cell"))
    numbered = headings.unionByName(labels).unionByName(body).withColumn("r", F.dense_rank().over(W.partitionBy("id").orderBy("sector", F.asc_nulls_first("indicator"))))
    heads = rows.select("id", F.lit(0).alias("r"), "c", F.col("period").alias("cell")).distinct()
    return tables.sector_blocks(numbered.select("id", "r", "c", "cell").unionByName(heads), ["id"])


@query(
    """WITH {facts}, x AS (SELECT fact_id, status = 'rejected' AS critical, value_type = 'relative_change' AS conflict, status = 'review' AS review, origin = 'human' AS sure, confidence AS q, (unit IS NOT NULL)::INT AS m, CASE WHEN quarter IS NULL AND month IS NULL THEN 0.7 ELSE 0.9 END AS p FROM facts),
y AS (SELECT *, round(least(greatest(q * 0.49 + m * 0.12 + p * 0.17 + 0.10 + 0.8 * 0.08 - CASE WHEN critical THEN 0.30 ELSE 0 END - CASE WHEN conflict THEN 0.15 ELSE 0 END - CASE WHEN review THEN 0.10 ELSE 0 END, 0.05), 0.98), 4) AS score FROM x)
SELECT fact_id, score, CASE WHEN conflict THEN least(score, 0.80) ELSE score END AS final_score, CASE WHEN critical THEN 'rejected' WHEN conflict OR review THEN 'review' WHEN sure THEN 'validated' ELSE 'review' END AS final_status FROM y"""
)
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the facts; none has a context, so only those of human origin can be validated."""
    sure, dated = F.col("confidence"), F.col("quarter").isNotNull() | F.col("month").isNotNull()
    dimensions = {"indicator": sure, "amount": sure, "measure": F.when(F.col("unit").isNotNull(), 1.0), "period": F.when(dated, 0.9).otherwise(0.7), "place": F.lit(1.0), "association": sure, "semantic": F.lit(0.8), "context": F.lit(None).cast("double")}
    warnings = {"critical": F.col("status") == "rejected", "conflict": F.col("value_type") == "relative_change", "review": F.col("status") == "review", "deterministic": F.col("origin") == "human"}
    rows = facts(spark, sf_dir).select("fact_id", *(c.alias(n) for n, c in (dimensions | warnings).items()))
    return consistency.final_status(consistency.evidence_score(rows)).select("fact_id", "score", "final_score", "final_status")

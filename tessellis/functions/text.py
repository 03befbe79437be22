"""Text, metadata and number functions as column expressions. Patterns carry (?iuU), since Java's defaults are ASCII only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as text is stripped of it: ASCII, separators and the Unicode blanks.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_text(text: Column) -> Column:
    """NUL and BOM as blanks, without direction marks; hyphenated line ends joined; blanks and empty lines squeezed; no blank before marks."""
    out = F.translate(text, "\x00\ufeff\u200f\u200e", "  ")
    steps = [(r"(?U)(\w)-\n(\w)", "$1$2"), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r" +([,.;:!?%])", "$1")]
    for pattern, into in steps:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(into))
    return F.btrim(out, F.lit(STRIPPED))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[\w؀-ۿ]+"))


def arabic_share(text: Column) -> Column:
    """Arabic letters among the letters, 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[؀-ۿ]")), letters), F.lit(0.0))


# Words that tell the languages apart, in the order they are tried.
LANGUAGE_WORDS = {"en": "the and of with for was were", "fr": "le la les des de du en avec pour est sont"}


def language(text: Column) -> Column:
    """unknown under 20 characters; ar if over a quarter of the letters are; else en, then fr, by any of their words; else unknown."""
    bare = F.btrim(text, F.lit(STRIPPED))
    arabic, letters = F.regexp_count(bare, F.lit("[\u0600-\u06ff]")), F.regexp_count(bare, F.lit("[A-Za-z\u00c0-\u00ff\u0600-\u06ff]"))
    out = F.when(bare.isNull() | (F.length(bare) < 20), "unknown").when(arabic * 4 > letters, "ar")
    for name, words in LANGUAGE_WORDS.items():
        out = out.when(bare.rlike(rf"(?iuU)(?<!\w)(?:{'|'.join(words.split())})(?!\w)"), name)
    return out.otherwise("unknown")


def url_host(url: Column) -> Column:
    """Host of the first address in the text, lower case, without www."""
    host = F.lower(F.regexp_extract(url, r"(?i)https?://([^/\s?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def first_date(text: Column) -> Column:
    """The first date of the first 3000 characters: year-month-day, else day/month/year, else day-month-year."""
    head = F.substring(text, 1, 3000)
    shapes = (r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}-\d{1,2}-\d{4}")
    return F.coalesce(*(F.nullif(F.regexp_extract(head, rf"(?U)\b{shape}\b", 0), F.lit("")) for shape in shapes))


def title_line(text: Column) -> Column:
    """The first of the first eight lines with text that has 15 to 180 characters and is no address."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    fit = F.filter(F.slice(lines, 1, 8), lambda x: (F.length(x) >= 15) & (F.length(x) <= 180) & ~x.rlike(r"(?i)^https?://"))
    return F.get(fit, 0)


def parse_number(raw: Column) -> Column:
    """The value of a printed number: blanks and repeated points group thousands, of comma and point the last is decimal."""
    return _parsed(_bare_number(raw))


def _bare_number(raw: Column) -> Column:
    digits = F.translate(raw, "٠١٢٣٤٥٦٧٨٩٫٬", "0123456789,.")
    return F.regexp_replace(F.trim(digits), r"[\s  %]", "")


def _parsed(text: Column) -> Column:
    comma, point = F.instr(text, ","), F.instr(text, ".")
    last_comma = F.length(text) - F.instr(F.reverse(text), ",")
    last_point = F.length(text) - F.instr(F.reverse(text), ".")
    both = F.when(last_comma > last_point, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    grouped = text.rlike(r"^[-+]?\d{1,3}(\.\d{3})+$")
    plain = F.when((comma > 0) & (point > 0), both).when(comma > 0, F.replace(text, F.lit(","), F.lit("."))).when(grouped, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    return F.when(text.rlike(r"^[-+]?\d+(?:\.\d{1,2})?$"), text.try_cast("double")).otherwise(plain.try_cast("double"))  # most numbers leave nothing to be told


NUMBER = r"(?<![\p{L}\d.,-])[-+]?\d{1,3}(?:[   ]\d{3})+(?:[.,]\d+)?(?![\d])|(?<![\p{L}\d.,])[-+]?\d+(?:[.,]\d+)*(?![\p{L}\d])"


def numeric_mentions(text: Column) -> Column:
    """Every number of a text with its ordinal, value and the unit after it, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"(?u)({NUMBER})[  ]?(%|percent|pour cent|points?)?"), F.lit(0))
    return F.transform(found, lambda x, i: F.struct(i.alias("nr"), F.regexp_replace(x, r"[^\d.,+  -]", "").alias("raw"), parse_number(F.regexp_replace(x, r"[^\d.,+-]", "")).alias("value"), x.rlike("(?i)(%|percent|pour cent)$").alias("percent")))


# How scales and currencies are written, and what they stand for.
SCALES = {"million": "million", "millions": "million", "milliard": "milliard", "milliards": "milliard", "billion": "milliard", "billions": "milliard"}
CURRENCY_NAMES = {"dinar": "TND", "dinars": "TND", "tnd": "TND", "dt": "TND", "euro": "EUR", "euros": "EUR", "eur": "EUR", "€": "EUR", "dollar": "USD", "dollars": "USD", "usd": "USD", "$": "USD"}
MEASURED = (
    rf"({NUMBER})(?:[ \u00a0\u202f]?(%|percent\b|per cent\b|pour cent\b|points?\b))?(?:[ \u00a0\u202f]({'|'.join(sorted(SCALES, reverse=True))})\b)?"
    rf"(?:[ \u00a0\u202f](?:de |d['\u2019])?({'|'.join(re.escape(x) for x in sorted(CURRENCY_NAMES, reverse=True))})(?![\p{{L}}]))?"
)


# Signs that are no characters, to part a text by: texts that hold them get the replacement character, which no pattern tells from them.
EDGE, PART = "\ufffe", "\uffff"


def parted(text: Column, pattern: str, shown: str = "$0") -> Column:
    """What stands between the matches of a pattern and the matches, in turn, from one pass; a match as ``shown``."""
    free = F.translate(text, EDGE + PART, "\ufffd\ufffd")
    return F.split(F.regexp_replace(free, F.lit(pattern), F.lit(f"{EDGE}{shown}{EDGE}")), EDGE, -1)


def placed_numbers(text: Column) -> Column:
    """Every number of a text in order: nr, start and stop (from 0, its measure included), raw, value, unit, scale, currency, is_year.

    A year is a bare number of four digits from 1900 to 2099. Null and empty texts have none.
    """
    pieces = F.transform(parted(text, f"(?iuU){MEASURED}", PART.join(f"${k}" for k in range(5))), lambda x: F.split(x, PART, -1))
    none = F.lit(None).cast("string")
    known = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    kind = "struct<at:int,found:array<struct<start:int,stop:int,x:array<string>,bare:string>>>"

    def placed(so_far, x):
        stop = so_far["at"] + F.length(x[0])
        row = F.struct(so_far["at"].alias("start"), stop.alias("stop"), x.alias("x"), _bare_number(F.get(x, 1)).alias("bare"))
        return F.struct(stop.alias("at"), F.when(F.size(x) > 1, F.concat(so_far["found"], F.array(row))).otherwise(so_far["found"]).alias("found")).cast(kind)

    def read(m, nr):
        whole, raw, unit, scale, currency = (m["x"][k] for k in range(5))
        return F.struct(
            nr.alias("nr"), m["start"].alias("start"), m["stop"].alias("stop"), raw.alias("raw"), _parsed(m["bare"]).alias("value"),
            F.when(unit == "", none).when(F.lower(unit).rlike("^point"), "point").otherwise("%").alias("unit"), F.try_element_at(known(SCALES), F.lower(scale)).alias("scale"),
            F.try_element_at(known(CURRENCY_NAMES), F.lower(currency)).alias("currency"), whole.rlike(r"^(19|20)\d{2}$").alias("is_year"),
        )

    nothing = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(kind)
    return F.transform(F.aggregate(pieces, nothing, placed, lambda s: s["found"]), read)

"""Structured tables: grids of cells become facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessellis.functions.codes import parse_period
from tessellis.functions.text import parse_number
from tessellis.operators.lexicon import fold
from tessellis.operators.mentions import worked_out


def cells(grids: DataFrame, keys: list[str], rows: str = "rows") -> DataFrame:
    """(keys, r, c, cell): every cell of an array of rows, trimmed; empty cells are null."""
    lines = grids.select(*keys, F.posexplode(rows).alias("r", "_line"))
    return lines.select(*keys, "r", F.posexplode("_line").alias("c", "_cell")).select(*keys, "r", "c", F.nullif(F.trim("_cell"), F.lit("")).alias("cell"))


def unpivoted(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """A wide table with one column an indicator as (ids, indicator, value); cells that hold no number go."""
    long = rows.unpivot(ids, columns, "indicator", "raw")
    return long.select(*ids, "indicator", parse_number(F.col("raw")).alias("value")).filter("value IS NOT NULL")


def long_table(grid_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of a table whose header names country, period, indicator and value."""
    kind = F.when(fold(F.col("cell")).rlike("^(pays|country)"), "country").when(fold(F.col("cell")).rlike("^period"), "period").when(fold(F.col("cell")).rlike("^indicat"), "indicator").when(fold(F.col("cell")).rlike("^(valeur|value)"), "value").when(fold(F.col("cell")).rlike("^unit"), "unit")
    head = grid_cells.filter("r = 0").select(*keys, "c", kind.alias("_kind")).filter("_kind IS NOT NULL")
    named = grid_cells.filter("r > 0").join(head, [*keys, "c"])
    rows = named.groupBy(*keys, "r").pivot("_kind", ["country", "period", "indicator", "value", "unit"]).agg(F.first("cell"))
    period = parse_period(F.col("period"))
    return rows.select(*keys, "r", "country", "indicator", parse_number(F.col("value")).alias("value"), "unit", *(c.alias(n) for n, c in period.items())).filter("value IS NOT NULL AND indicator IS NOT NULL")


def grouped_columns(grid_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of a table with indicators over periods in its first two rows: an empty header cell repeats the one before."""
    filled = F.last("cell", ignorenulls=True).over(W.partitionBy(*keys).orderBy("c").rowsBetween(W.unboundedPreceding, 0))
    top = grid_cells.filter("r = 0 AND c > 0").withColumn("indicator", filled).select(*keys, "c", "indicator")
    second = grid_cells.filter("r = 1 AND c > 0").select(*keys, "c", F.col("cell").alias("period"))
    label = grid_cells.filter("r > 1 AND c = 0").select(*keys, "r", F.col("cell").alias("sector"))
    body = grid_cells.filter("r > 1 AND c > 0").select(*keys, "r", "c", parse_number(F.col("cell")).alias("value")).filter("value IS NOT NULL")
    return body.join(top, [*keys, "c"]).join(second, [*keys, "c"]).join(label, [*keys, "r"]).select(*keys, "sector", "indicator", "period", "value")


def column_matrix(grid_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of a table with indicators in its first row and a period (YYYY, YYYY-YYYY, YYYY-Qn, YYYY-Mnn) at the start of each other row."""
    heads = grid_cells.filter("r = 0 AND c > 0 AND cell IS NOT NULL").select(*keys, "c", F.col("cell").alias("indicator"))
    spans = parse_period(F.regexp_replace("cell", r"\s*[–-]\s*", "-"))
    periods = grid_cells.filter("r > 0 AND c = 0").select(*keys, "r", *(c.alias(n) for n, c in spans.items())).filter("year IS NOT NULL")
    body = grid_cells.filter("r > 0 AND c > 0").select(*keys, "r", "c", parse_number(F.col("cell")).alias("value")).filter("value IS NOT NULL")
    return body.join(heads, [*keys, "c"]).join(periods, [*keys, "r"]).select(*keys, "indicator", "value", *spans)


def sector_blocks(grid_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of a table whose rows without numbers are sector headings for the indicator rows under them."""
    heads = grid_cells.filter("r = 0 AND c > 0").select(*keys, "c", F.col("cell").alias("period"))
    labels = grid_cells.filter("r > 0").groupBy(*keys, "r").agg(F.first(F.when(F.col("c") == 0, F.col("cell")), ignorenulls=True).alias("label"), F.count_if((F.col("c") > 0) & F.col("cell").isNotNull()).alias("_n"))
    sector = F.last(F.when(F.col("_n") == 0, F.col("label")), ignorenulls=True).over(W.partitionBy(*keys).orderBy("r").rowsBetween(W.unboundedPreceding, 0))
    rows = labels.withColumn("sector", sector).filter("_n > 0").select(*keys, "r", "sector", F.col("label").alias("indicator"))
    body = grid_cells.filter("r > 0 AND c > 0").select(*keys, "r", "c", parse_number(F.col("cell")).alias("value")).filter("value IS NOT NULL")
    return body.join(rows, [*keys, "r"]).join(heads, [*keys, "c"]).select(*keys, "sector", "indicator", "period", "value")


def place_of_row(row_country: Column, document_country: Column) -> tuple[Column, Column]:
    """The country of a table row goes before its document's; with where it came from."""
    return F.coalesce(row_country, document_country), F.when(row_country.isNotNull(), "table_row").when(document_country.isNotNull(), "document")


AVERAGE = r"(?:moyenne|average)\s*\(((?:19|20)\d{2}\s*[–-]\s*(?:19|20)\d{2})\)"
PARSERS = ["long", "grouped_columns", "sector_blocks", "column_matrix", "sector_average"]


def _is_period(cell: Column) -> Column:
    return F.coalesce(parse_period(F.regexp_replace(cell, r"\s*[–-]\s*", "-"))["year"].isNotNull(), F.lit(False))


def concept(header: Column, names: dict[str, str]) -> Column:
    """The indicator of a header: the longest name in it, the first of equal ones; null without one."""
    text = F.concat(F.lit(" "), F.regexp_replace(fold(header), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    longest = sorted(names, key=lambda n: (-len(n), n))
    return F.coalesce(*(F.when(text.contains(f" {n} "), names[n]) for n in longest))


def placed_cells(grid_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with what stands beside and above them, wrapped labels joined: ``label`` of the row, ``heading`` above it, ``top``, ``filled`` and ``second`` of the column, ``number``.

    A row with a label alone, right before a row with numbers and no label, is the start of that row's label, however many such rows there
    are; one that begins in lower case right after a row with numbers is the end of that row's label. Other rows with a label alone are
    headings, and the first row is the header. A grid is one group: all of this is windows after one shuffle.
    """
    cells = worked_out(grid_cells.filter("cell IS NOT NULL"), number=parse_number(F.col("cell")))
    row, grid = W.partitionBy(*keys, "r"), W.partitionBy(*keys).orderBy("r")
    first = F.col("c") == 0
    cells = cells.repartition(*keys).withColumns({
        "label": F.max(F.when(first, F.col("cell"))).over(row), "_full": F.count_if(~first).over(row), "_n": F.count_if(~first & F.col("number").isNotNull()).over(row),
    })
    cells = cells.withColumn("_lone", (F.col("r") > 0) & F.col("label").isNotNull() & (F.col("_full") == 0))
    other = F.when(~F.col("_lone"), F.struct("r", "label", "_n"))
    cells = cells.withColumns({"_next": F.first(other, ignorenulls=True).over(grid.rangeBetween(1, W.unboundedFollowing)), "_last": F.last(other, ignorenulls=True).over(grid.rangeBetween(W.unboundedPreceding, -1))})
    ends = F.col("label").rlike(r"^\p{Ll}") & (F.col("_last._n") > 0) & (F.col("_last.r") > 0)
    starts = F.col("_next.label").isNull() & (F.col("_next._n") > 0)
    into = F.when(F.col("_lone") & ends, F.col("_last.r")).when(F.col("_lone") & starts, F.col("_next.r")).otherwise(F.col("r"))
    cells = cells.withColumn("_into", into)
    parts = F.array_sort(F.collect_list(F.when(first, F.struct("r", "cell"))).over(W.partitionBy(*keys, "_into")))
    joined = F.nullif(F.array_join(F.transform(parts, lambda x: x["cell"]), " "), F.lit(""))
    cells = cells.withColumn("label", joined).filter(F.col("_into") == F.col("r"))
    column = W.partitionBy(*keys, "c")
    filled = F.last(F.when(F.col("r") == 0, F.struct("c", "cell")), ignorenulls=True).over(W.partitionBy(*keys).orderBy("c", "r").rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumns({
        "heading": F.last(F.when(F.col("_lone") & first, F.col("label")), ignorenulls=True).over(grid.rangeBetween(W.unboundedPreceding, 0)),
        "top": F.max(F.when(F.col("r") == 0, F.col("cell"))).over(column), "second": F.max(F.when(F.col("r") == 1, F.col("cell"))).over(column), "filled": filled["cell"],
    }).drop("_full", "_n", "_lone", "_next", "_last", "_into")


def recognised(placed: DataFrame, keys: list[str]) -> DataFrame:
    """``placed`` cells with ``parser``: which of :data:`PARSERS` their grid is for, by what kinds of cells its rows and columns hold; null for none.

    A long table names value and indicator in its header. A table of averages has two columns and "moyenne (Y1-Y2)" or "average" in its header. A
    matrix has periods in most labels. Periods in the header make sector blocks; periods in the second row, under names, grouped columns.
    """
    all_of, first = W.partitionBy(*keys), F.col("c") == 0
    rows = worked_out(placed, _period=_is_period(F.col("cell")), _low=fold(F.col("cell")))
    says = lambda pattern: F.max((F.col("r") == 0) & F.col("_low").rlike(pattern)).over(all_of)
    count = lambda what: F.count_if(what).over(all_of)
    rows = rows.withColumns({
        "_value": says("^(valeur|value)") & says("^indicat"), "_average": says(AVERAGE), "_width": F.max("c").over(all_of), "_dated": count((F.col("r") > 0) & first & F.col("_period")), "_labels": count((F.col("r") > 0) & first),
        "_top": count((F.col("r") == 0) & ~first & F.col("_period")), "_heads": count((F.col("r") == 0) & ~first), "_second": count((F.col("r") == 1) & ~first & F.col("_period")), "_seconds": count((F.col("r") == 1) & ~first),
    })
    parser = (
        F.when(F.col("_value"), "long").when(F.col("_average") & (F.col("_width") == 1), "sector_average").when((F.col("_labels") > 0) & (2 * F.col("_dated") > F.col("_labels")), "column_matrix")
        .when((F.col("_heads") > 0) & (F.col("_top") == F.col("_heads")), "sector_blocks").when((F.col("_seconds") > 0) & (F.col("_second") == F.col("_seconds")), "grouped_columns")
    )
    return rows.withColumn("parser", parser).drop("_value", "_average", "_width", "_dated", "_labels", "_top", "_heads", "_second", "_seconds", "_period", "_low")


def structured_facts(grid_cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parser, sector, country, indicator, unit, value, year, last_year, quarter, month) of grids of any recognised shape; others give no rows."""
    rows = recognised(placed_cells(grid_cells, keys), keys).filter("parser IS NOT NULL")
    kinds = {"country": "^(pays|country)", "period": "^period", "indicator": "^indicat", "unit": "^unit", "value": "^(valeur|value)"}
    rows = worked_out(rows, _head=fold(F.col("top")))
    beside = lambda kind: F.max(F.when(F.col("_head").rlike(kinds[kind]), F.col("cell"))).over(W.partitionBy(*keys, "r"))
    rows = rows.withColumns({f"_{k}": beside(k) for k in ("country", "period", "indicator", "unit")})
    is_ = lambda *names: F.col("parser").isin(*names)
    body = F.when(is_("long"), (F.col("r") > 0) & F.col("_head").rlike(kinds["value"])).when(is_("grouped_columns"), (F.col("r") > 1) & (F.col("c") > 0)).otherwise((F.col("r") > 0) & (F.col("c") > 0))
    period = F.when(is_("long"), F.col("_period")).when(is_("grouped_columns"), F.col("second")).when(is_("sector_blocks"), F.col("top")).when(is_("column_matrix"), F.col("label")).otherwise(F.regexp_extract("_head", AVERAGE, 1))
    facts = rows.filter(body & F.col("number").isNotNull()).select(
        *keys, "parser", F.when(is_("grouped_columns", "sector_average"), F.col("label")).when(is_("sector_blocks"), F.col("heading")).alias("sector"), F.when(is_("long"), F.col("_country")).alias("country"),
        F.when(is_("long"), F.col("_indicator")).when(is_("grouped_columns"), F.col("filled")).when(is_("sector_blocks"), F.col("label")).when(is_("column_matrix"), F.col("top")).alias("indicator"),
        F.when(is_("long"), F.col("_unit")).alias("unit"), F.col("number").alias("value"), F.regexp_replace(period, r"\s*[–-]\s*", "-").alias("_p"),
    )
    dated = worked_out(facts, **parse_period(F.col("_p")))
    kept = (F.col("parser") == "sector_average") | F.col("indicator").isNotNull()
    return dated.filter(kept & F.col("year").isNotNull()).select(*keys, "parser", "sector", "country", "indicator", "unit", "value", "year", "last_year", "quarter", "month")

"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (line hash, documents, largest document) sorted by hash in the shared folder. Every batch
becomes a run of level 0; once a level has ``fanout`` runs they are merged into one run of the next level. Batches
come in descending order of document id, so a line that the runs already know from ``min_docs`` documents is
settled: the batch is merge-anti-joined with the settled lines and adds only what is left. The last look at the
runs, when all batches are in, gives the verdict on every line. The merge is Spark's: a run is a file set of the shared
folder, and only tables of a catalogue tell Spark their order, so merges and anti-joins exchange and sort what they read;
within its files a run is in order, which packs it well and lets a reader of a few hashes skip row groups.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``min_chars``
code points in at least ``min_docs`` documents lose their lines except in the largest document id.

Cases: a null or empty text is one empty line; a null id counts as one document, smaller than any other; rows that
repeat an id are one document, and each row loses its own lines; an empty table gives an empty one; further columns
stay, and clash with nothing, as the values come in one struct with a free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessellis.llm.common import ascii_lower, discard, free_name, spread_join, written

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 3
BLANKS = "\t\n\x0b\x0c\r "
KEY = ["h1", "h2"]


class LineRuns:
    """The index: levels of runs, each run a written table with one row a line hash, sorted within its partitions."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))

    def _write(self, rows: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(written(rows.sortWithinPartitions(*KEY), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            discard(*full)

    def lines(self) -> DataFrame | None:
        """One row per line hash over all runs; None before the first batch."""
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else None

    def add(self, batch: DataFrame, min_docs: int = MIN_DOCS) -> None:
        """Takes in (h1, h2, doc_id) of a batch of smaller ids than all before, but for its settled lines."""
        once = batch.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("n"))
        fresh = once.groupBy(*KEY).agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("top_doc"))  # a row a line, so no line is a hot key of the join
        known = self.lines()
        if known is not None:
            fresh = fresh.join(known.filter(F.col("n_docs") >= min_docs), KEY, "left_anti")
        self._write(fresh, 0)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, at, h1, h2) of every line whose key is long enough; version: the text's hash."""
    rows = df.select(df[id_col].alias("doc_id"), F.xxhash64(df[text_col]).alias("version"), F.posexplode(_lines(df[text_col])).alias("at", "line"))
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    keyed = rows.select("doc_id", "version", "at", key.alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "version", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _descending(lines: DataFrame, batches: int) -> list[Column]:
    """Conditions that cut ``doc_id`` into ranges of about equal size, largest ids first; null ids come last. Ids that are no numbers are one range."""
    shares = [k / batches for k in range(1, batches)] if isinstance(lines.schema["doc_id"].dataType, NumericType) else []
    cuts = lines.agg(F.percentile_approx("doc_id", shares, 1000).alias("cuts")).first()["cuts"] if shares else []
    cuts = sorted(set(cuts or []))
    bounds = [None, *cuts, None]
    ranges = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        inside = F.lit(True) if low is None else F.col("doc_id") > low
        inside = inside & (F.lit(True) if high is None else F.col("doc_id") <= high)
        ranges.append(F.col("doc_id").isNull() | F.coalesce(inside, F.lit(False)) if low is None else inside)
    return ranges[::-1]


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, version, at) of the lines that go."""
    lines = written(line_keys(df, id_col, text_col), "line-keys")
    runs = LineRuns(df.sparkSession)
    for inside in _descending(lines, batches):
        runs.add(lines.filter(inside).select(*KEY, "doc_id"))
    common = written(runs.lines().filter(F.col("n_docs") >= MIN_DOCS), "common-lines")
    return spread_join(lines, common, KEY, counted="n_docs").filter(~F.col("doc_id").eqNullSafe(F.col("top_doc"))).select("doc_id", "version", "at")


def with_kept_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> tuple[DataFrame, str]:
    """``df`` with one struct column, and its name: n_lines, n_dropped, text."""
    name = free_name(df, "line_dedup")
    gone = dropped_lines(df, id_col, text_col, batches).groupBy("doc_id", "version").agg(F.collect_set("at").alias("_at"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "_at")
    joined = df.join(gone, df[id_col].eqNullSafe(gone["_doc"]) & (F.xxhash64(df[text_col]) == gone["_version"]), "left")
    lines = _lines(df[text_col])
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["_at"])
    text = F.when(gone["_at"].isNull(), F.coalesce(df[text_col], F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    dropped = F.when(gone["_at"].isNull(), 0).otherwise(F.size(gone["_at"]))
    values = F.struct(F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), text.alias("text"))
    return joined.select(*(df[c] for c in df.columns), values.alias(name)), name


def line_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Per row: doc_id, n_lines before, n_dropped and kept_sha256 of the lines left."""
    base = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    out, name = with_kept_lines(base, batches=batches)
    return out.select("doc_id", f"{name}.n_lines", f"{name}.n_dropped", F.sha2(f"{name}.text", 256).alias("kept_sha256"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """``df`` with the dropped lines gone from its texts; all columns as before."""
    out, name = with_kept_lines(df, id_col, text_col, batches)
    return out.select(*(F.col(f"{name}.text").alias(c) if c == text_col else df[c] for c in df.columns))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS top_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT d.doc_id, d.pos, d.line, c.k IS NOT NULL AND d.doc_id <> c.top_doc AS gone FROM keyed d LEFT JOIN common c ON d.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

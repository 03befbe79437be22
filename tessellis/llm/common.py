"""What the operators of this package share: the shared folder, written intermediates, input selection."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, U+0020 and U+0009 to U+000D, as a Java and RE2 character class.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; one of our own only in one machine's local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote, once nothing that is still to run reads it."""
    for df in tables:
        folder = shared_dir(df.sparkSession)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
                place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def spread_join(rows: DataFrame, values: DataFrame, key: str | list[str], how: str = "inner", counted: str = "n") -> DataFrame:
    """``rows`` joined with ``values``, one row a key that says in ``counted`` how many rows have the key (it is left out).

    A key with more rows than a shuffle partition has on average is cut into pieces of that size, by a hash of all columns, and its
    value goes to each. There are fewer such keys than partitions, so their list can be broadcast.
    """
    key = [key] if isinstance(key, str) else key
    piece = -(-rows.count() // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or 1
    hot = values.filter(F.col(counted) > piece).select(*key, F.ceil(F.col(counted) / piece).alias("_pieces"))
    cut = rows.join(F.broadcast(hot), key, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_pieces")), F.lit(0))).drop("_pieces")
    many = F.greatest(F.ceil(F.col(counted) / piece), F.lit(1))
    copies = values.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop(counted)
    return cut.join(copies, [*key, "_piece"], how).drop("_piece")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text alone, so that no further column of the caller can clash."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def ascii_lower(column):
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(column):
    """The maximal runs of characters other than ASCII white space; none for a null."""
    trimmed = F.btrim(column, F.lit("\t\n\x0b\x0c\r "))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))

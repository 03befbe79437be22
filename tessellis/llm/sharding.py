"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: offset + k * skip. The shards
take turns, each claiming the first slot of its order that is still free, until the table is full. A row's key is
hashed to a slot, and the slot names the shard: one lookup whatever the number of shards, loads that differ by about
shards / table size, and few moves when a shard joins or leaves.

The table depends on two parameters only (``slots`` rows at most MAX_SLOTS), so it is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellis.llm.common import free_name

SHARDS, SLOTS, MAX_SLOTS = 32, 4093, 1_000_003


def _numbers(name: str) -> tuple[int, int]:
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot; ``slots`` must be prime and at least the number of shards."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if not len(names) <= slots <= MAX_SLOTS or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the table needs a prime size from {len(names)} to {MAX_SLOTS}")
    starts = [(a % slots, b % (slots - 1) + 1) for a, b in map(_numbers, names)]
    following, owner, free = [0] * len(names), [-1] * slots, slots
    while True:
        for shard, (offset, skip) in enumerate(starts):
            slot = (offset + following[shard] * skip) % slots
            while owner[slot] >= 0:
                following[shard] += 1
                slot = (offset + following[shard] * skip) % slots
            owner[slot] = shard
            free -= 1
            if not free:
                return owner


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    return spark.createDataFrame(list(enumerate(fill(names, slots))), "slot long, shard int")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, by its text; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign_shards(df: DataFrame, key_col: str, names: list[str], slots: int = SLOTS, spread_by: list[str] | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """``df`` with long ``slot`` and int ``shard`` columns at its end, under free names if these are taken.

    With ``spread_by``, the rows of a key with more than ``hot_rows`` rows are placed by the key and a hash of those
    columns, in as many parts as keep each part near ``hot_rows``: so no shard takes a hot key whole. Keys are counted
    before anything else moves. Null keys share one slot, repeated rows share theirs, an empty table stays empty.
    """
    slot, shard, entry, hot, rows = (free_name(df, name) for name in ("slot", "shard", "table_slot", "hot_key", "key_rows"))
    table = F.broadcast(lookup_table(df.sparkSession, names, slots).select(F.col("slot").alias(entry), F.col("shard").alias(shard)))
    key, placed, columns = df[key_col], df, [*df.columns]
    if spread_by:
        counts = df.groupBy(df[key_col].alias(hot)).agg(F.count("*").alias(rows)).filter(F.col(rows) > hot_rows)
        placed = df.join(counts, F.col(key_col).eqNullSafe(F.col(hot)), "left")
        part = F.pmod(F.xxhash64(*spread_by), F.ceil(F.col(rows) / hot_rows))
        key = F.when(F.col(rows).isNull(), F.col(key_col).cast("string")).otherwise(F.concat_ws("\x01", F.col(key_col).cast("string"), part.cast("string")))
    placed = placed.withColumn(slot, slot_of(key, slots))
    return placed.join(table, F.col(slot) == F.col(entry)).select(*columns, slot, shard)


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(count)]


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard", files: int = 8) -> None:
    """One folder a shard, each written by up to ``files`` tasks."""
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(files))
    placed.repartition(F.col(shard_col), salt).write.partitionBy(shard_col).parquet(path)


ORACLE = """
WITH RECURSIVE shards AS (
  SELECT i, md5(format('shard-{:04d}', i)) AS h FROM range(32) t(i)
), starts AS (
  SELECT list(('0x' || substr(h, 1, 15))::BIGINT % 4093 ORDER BY i) AS o, list(('0x' || substr(h, 16, 15))::BIGINT % 4092 + 1 ORDER BY i) AS s FROM shards
), filled(t, owner) AS (
  SELECT 0, list_transform(range(4093), lambda x: -1)
  UNION ALL
  SELECT t + 1, list_transform(range(4093), lambda x: CASE WHEN x = claimed THEN t % 32 ELSE owner[x + 1] END)
  FROM (
    SELECT t, owner, list_filter(list_transform(range(4093), lambda j: (o[t % 32 + 1] + j * s[t % 32 + 1]) % 4093), lambda x: owner[x + 1] < 0)[1] AS claimed
    FROM filled, starts WHERE t < 4093
  )
), slots AS (
  SELECT unnest(range(4093)) AS slot, unnest(owner) AS shard FROM filled WHERE t = 4093
), keyed AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % 4093 AS slot FROM documents
)
SELECT doc_id, slot, shard::INT AS shard FROM keyed JOIN slots USING (slot)
"""

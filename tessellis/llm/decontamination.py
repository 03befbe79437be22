"""Benchmark decontamination: test items whose word shingles a document contains to at least 4/5.

Size-partitioned MinHash: items are partitioned by their number of shingles, a partition having those of up to 2^k. For
each partition that has items, every document is cut into blocks of 2^k shingles, sets of about the size of what is sought,
so that an item of 11 shingles is found in 20,000 words. Items and blocks get a one-permutation MinHash: the hash range is
cut into bins, as many as a block has shingles and 32 at least, and each bin that is not empty gives its least hash. An item
and a document that share one of these in the item's partition are a candidate. An item that lies across two blocks has its
least hashes in the one or the other. Candidates are verified on the shingles of the whole document. DataFrame functions only.

The bins make a miss unlikely, not impossible: of an item of n shingles about 0.6 n or more bins have a hash, a block with
the shingle keeps it with a probability of 0.6 or more, and one is enough. Measured recall against all shingles is in the
README. The block's number counts modulo 2^18, so in texts of over a million shingles far blocks share their bins.

Words are lower-cased in A-Z; a text under five words is one shingle, so a short item is found only in a text of the
same words. Cases: null and empty texts contain nothing and are contained in nothing; rows that repeat an id are
checked each and reported once if alike; empty tables give no rows; further columns are not read or stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellis.llm.common import ascii_lower, words_of, written

WIDTH, SHARE_TOP, SHARE_BOTTOM = 5, 4, 5
#: At least so many bins (as a power of two), bits of a hash that are kept, bits of a block's number.
BIN_BITS, HASH_BITS, BLOCK_BITS = 5, 44, 18
#: Signatures of up to so many items, and up to so many document ids, are broadcast; more are joined by shuffle.
BROADCAST_ITEMS, BROADCAST_IDS = 50_000, 1_000_000


def _starts(words: Column) -> Column:
    return F.slice(words, 1, F.greatest(F.size(words) - WIDTH + 1, F.lit(0)))


def _hashes(words: Column) -> Column:
    long = F.transform(_starts(words), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WIDTH))))
    return F.when(F.size(words) >= WIDTH, long).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))


def _shingles(words: Column) -> Column:
    long = F.transform(_starts(words), lambda w, i: F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, WIDTH))))
    return F.array_distinct(F.when(F.size(words) >= WIDTH, long).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _rows(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(F.xxhash64(df[id_col], df[text_col]).alias(f"{name}_row"), df[id_col].alias(f"{name}_id"), words_of(ascii_lower(df[text_col])).alias("words"))


def _in_blocks(hashes: Column, band: int) -> Column:
    """The hashes behind the numbers of their blocks of 2^``band``, in order."""
    number = lambda i: F.shiftleft(F.shiftright(i, band).cast("long").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)), HASH_BITS)
    return F.sort_array(F.transform(hashes, lambda h, i: number(i).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))))


def _least(ordered: Column, band: int) -> Column:
    """The least hash of each bin of each block, marked with the partition's number."""
    bin_of = lambda x: F.shiftright(x, HASH_BITS - max(band, BIN_BITS))
    first = F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))
    return F.transform(first, lambda x: x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)).bitwiseOR(F.lit(band << HASH_BITS)))


def _signatures(df: DataFrame, bands: list[int]) -> DataFrame:
    """``df`` with its column hashes, an array, replaced by the column signatures of all ``bands``.

    To be exploded with ``explode_outer``: of a plain ``explode`` the optimiser takes a filter on the array's size and moves it
    below, where what the lambdas look at would be worked out anew for every element.
    """
    for band in bands:
        df = df.withColumn(f"ordered_{band}", _in_blocks(F.col("hashes"), band))
    none = F.array().cast("array<long>")
    every = F.concat(none, *(_least(F.col(f"ordered_{band}"), band) for band in bands))
    return df.withColumn("signatures", every).drop("hashes", *(f"ordered_{band}" for band in bands))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_row, doc_id, item_id, n_item, n_shared) of the pairs with 5 * n_shared >= 4 * n_item, n_item being the item's shingles."""
    tests = _rows(items, item_id_col, item_text_col, "item").withColumn("shingles", _shingles(F.col("words"))).filter(F.size("shingles") > 0)
    tests = tests.withColumn("hashes", F.array_distinct(_hashes(F.col("words")))).withColumn("band", F.ceil(F.log2(F.size("hashes"))).cast("int"))
    tests = written(tests.select("item_row", "item_id", "shingles", "hashes", "band"), "items")
    bands = sorted(r["band"] for r in tests.select("band").distinct().collect())
    signed = [_signatures(tests.filter(F.col("band") == band).select("item_row", "hashes"), [band]) for band in bands]
    texts = _rows(docs, id_col, text_col, "doc")
    looked = _signatures(texts.select("doc_row", _hashes(F.col("words")).alias("hashes")), bands).select("doc_row", F.explode_outer("signatures").alias("h"))
    if not signed:
        signed = [tests.select("item_row", F.col("hashes").alias("signatures"))]
    known = signed[0]
    for more in signed[1:]:
        known = known.unionByName(more)
    known = written(known.select("item_row", F.explode_outer("signatures").alias("h")).distinct(), "signatures")
    pairs = written(looked.join(_small(known, 40 * BROADCAST_ITEMS), "h").select("doc_row", "item_row").distinct(), "leak-candidates")
    sought = pairs.groupBy("doc_row").agg(F.collect_list("item_row").alias("items"))
    likely = texts.join(F.broadcast(sought) if pairs.count() <= BROADCAST_IDS else sought, "doc_row").withColumn("has", _shingles(F.col("words")))
    both = likely.select("doc_row", "doc_id", "has", F.explode("items").alias("item_row")).join(_small(tests.select("item_row", "item_id", "shingles"), BROADCAST_ITEMS), "item_row")
    counted = both.select("doc_row", "doc_id", "item_id", F.size("shingles").cast("long").alias("n_item"), F.size(F.array_intersect("has", "shingles")).cast("long").alias("n_shared"))
    return counted.filter(F.col("n_shared") * SHARE_BOTTOM >= F.col("n_item") * SHARE_TOP).distinct()


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of every leak."""
    found = contained_items(docs, items).select("doc_id", "item_id", "n_item", "n_shared").distinct()
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with their columns as they were."""
    bad = written(contained_items(docs, items, id_col, text_col).select(F.col("doc_row").alias("_row")).distinct(), "leaking")
    return docs.join(_small(bad, BROADCAST_IDS), F.xxhash64(docs[id_col], docs[text_col]) == bad["_row"], "left_anti")


ORACLE = r"""
WITH texts AS (
  SELECT doc_id AS id, true AS doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark
), words AS (
  SELECT id, doc, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM texts
), sets AS (
  SELECT id, doc, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words
), item AS (SELECT id AS item_id, len(s) AS n_item, unnest(s) AS g FROM sets WHERE NOT doc),
each AS (SELECT id AS doc_id, unnest(s) AS g FROM sets WHERE doc)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM each JOIN item USING (g) GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
"""

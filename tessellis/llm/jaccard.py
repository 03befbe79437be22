"""N-gram Jaccard join: exact components of documents whose word-shingle sets have a similarity of at least 4/5.

1. Every text becomes its set of hashed five-word shingles; equal sets are one class, known by a 64-bit key, with its
   size and a sketch: for each of many parts of the feature domain (one to two a shingle, 512 at least), whether the
   class has an odd number of shingles there. Two classes differ in at least as many shingles as their sketches in bits.
2. Classes emit PartEnum signatures, dealt out by signature; a class with very many copies emits them once, others once
   a task. Only signatures that two classes share go on.
3. In each signature's group every class is paired with one pivot, the class with the most neighbours: as many pairs
   as members. Pairs whose sizes or sketches rule a link out go, the others are compared on their shingles. The links
   found give first components.
4. A group whose members, the pivot apart, still lie in several components may hide links between them. In small groups
   they are paired. The classes of large groups are looked at together: one must have enough shingles that another such
   class has, and takes the rarest of them, so many that two linked classes share one; classes are paired by these if
   sizes, short sketches, places in the order and numbers of shingles without a match allow a link. Sizes and sketches rule pairs out as before, the others are
   compared. So no pair that could link is left out, and no large group is paired up whole.

Words are lower-cased in A-Z. Shingles and classes are told apart by 64-bit hashes. A null or empty text has no set and
is linked with nothing. A text under five words is one shingle. Rows that repeat an id keep their own sets, and a null id
can be a component's name only if all of its ids are null; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellis.llm.common import discard, id_and_text, spread_join, written
from tessellis.llm.components import connected_components
from tessellis.llm.partenum import signatures
from tessellis.llm.shingles import mixed, set_key, shingle_sets

#: Common shingles only steer which signatures are left out: those in at least COMMON_DOCS of a sample of SAMPLE_DOCS.
SAMPLE_DOCS, COMMON_DOCS, MAX_COMMON = 64_000, 5, 200_000
#: Up to so many ids are broadcast (32 MB as a hash table), more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Classes with at least one copy in so many rows emit their signatures once: there are at most so many of them.
HOT_CLASSES = 10_000
#: A task remembers up to so many classes whose signatures it has emitted.
REMEMBERED = 500_000
#: In open groups of more classes than this, classes are paired by rare shingles, not by the group.
SMALL_GROUP = 32
#: Parts of the shortest sketch.
HEAD = 512


def sketch(values: np.ndarray, parts: int | None = None) -> np.ndarray:
    """The parity of the number of elements in each part of the domain, 64 parts a long: as many as given, else a power of two, as the set's size asks for."""
    if parts is None:
        parts = HEAD
        while parts < len(values):
            parts *= 2
    odd = np.bincount((mixed(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _members(base: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, node, sketch): the size of every row's set, its class (null for an empty set) and sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(len(s), set_key(s) if len(s) else None, sketch(s)) for s in shingle_sets(batch["text"].tolist())]
            sizes, nodes, sketches = zip(*made, strict=True) if made else ((), (), ())
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "n_shingles": list(sizes), "node": pd.array(nodes, "Int64"), "sketch": list(sketches)})

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.select("row", "doc_id", "text").mapInPandas(run, f"row long, doc_id {kind}, n_shingles long, node long, sketch array<long>")


def _classes(members: DataFrame) -> DataFrame:
    """(node, size, sketch, row, low_id, n): every class with the smallest of its rows and ids and their number."""
    once = members.filter(F.col("node").isNotNull())
    return once.groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.min("row").alias("row"), F.min("doc_id").alias("low_id"), F.count("*").alias("n"))


def _common_shingles(base: DataFrame, docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Sorted hashes that several documents of a sample have: of about ``docs`` documents, MAX_COMMON hashes at most.

    Only hashes that come twice in a batch of the sample are counted further, so little is shuffled.
    """
    every = max(1, base.count() // docs)
    sample = base.filter(F.pmod(F.col("row"), F.lit(every)) == 0).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, counts = np.unique(np.concatenate([*shingle_sets(batch["text"].tolist()), np.empty(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"h": values[counts > 1].view(np.int64), "n": counts[counts > 1]})

    counted = sample.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_DOCS)
    rows = counted.orderBy(F.desc("n"), "h").limit(MAX_COMMON).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def _hot_classes(members: DataFrame, classes: DataFrame) -> dict[int, int]:
    """The one row that emits the signatures of each class with very many copies; at most HOT_CLASSES classes."""
    least = max(2, -(-members.count() // HOT_CLASSES))
    return {r["node"]: r["row"] for r in classes.filter(F.col("n") >= least).select("node", "row").collect()}


def _candidates(base: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(sig, node, n): the classes of every signature that several classes share, with their number."""
    common, hot = (base.sparkSession.sparkContext.broadcast(x) for x in (_common_shingles(base), hot))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sigs, size = [], [], 0
            for row, values in zip(batch["row"], shingle_sets(batch["text"].tolist()), strict=True):
                if not len(values) or (node := set_key(values)) in seen or hot.value.get(node, row) != row:
                    continue
                if len(seen) == REMEMBERED:
                    seen.clear()
                seen.add(node)
                sigs.append(signatures(values, common.value))
                nodes.append(np.full(len(sigs[-1]), node, np.int64))
                size += len(sigs[-1])
                if size > 100_000:
                    yield pd.DataFrame({"sig": np.concatenate(sigs), "node": np.concatenate(nodes)})
                    nodes, sigs, size = [], [], 0
            if size:
                yield pd.DataFrame({"sig": np.concatenate(sigs), "node": np.concatenate(nodes)})

    group = Window.partitionBy("sig")
    emitted = base.select("row", "text").mapInPandas(emit, "sig long, node long")
    several = emitted.withColumn("_low", F.min("node").over(group)).withColumn("_high", F.max("node").over(group)).filter("_low <> _high")
    return several.select("sig", "node").distinct().withColumn("n", F.count("*").over(group))


def _sets(base: DataFrame, wanted: DataFrame, columns: str, make) -> DataFrame:
    """``make(set, values)`` for the text of each row in ``wanted`` (row and one column of values, an array): it gives a dict of columns.

    A task does each row number once; rows alike in id and text may come up in several tasks.
    """
    size = wanted.agg(F.coalesce(F.sum(F.size(wanted.columns[1]) + 1), F.lit(0)).alias("n")).first()["n"]
    joined = base.select("row", "text").join(F.broadcast(wanted) if size <= BROADCAST_IDS else wanted, "row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            new = [r not in seen and not seen.add(r) for r in batch["row"]]
            once = batch[pd.Series(new, index=batch.index, dtype=bool)]
            for values, own in zip(shingle_sets(once["text"].tolist()), once.iloc[:, 2], strict=True):
                yield pd.DataFrame(make(values.view(np.int64), own))

    return joined.mapInPandas(run, columns)


def _near() -> Column:
    return (5 * F.col("size_a") >= 4 * F.col("size_b")) & (5 * F.col("size_b") >= 4 * F.col("size_a"))


def _folded(one: str, other: str) -> Column:
    """The sketch ``one``, as short as ``other`` if it is twice as long: its halves laid on each other."""
    half = F.size(other)
    return F.when(F.size(one) > half, F.zip_with(F.slice(one, F.lit(1), half), F.slice(one, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(one))


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, row_a, row_b) of the pairs whose sizes and sketches do not rule a link out."""
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    side = lambda s: classes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"), F.col("row").alias(f"row_{s}"))
    joined = spread_join(pairs, side("a").join(counted, "a"), "a").join(side("b"), "b").filter(_near())
    bits = F.aggregate(F.zip_with(_folded("sketch_a", "sketch_b"), _folded("sketch_b", "sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return joined.filter(9 * bits <= F.col("size_a") + F.col("size_b")).select("a", "b", "row_a", "row_b")


def _links(base: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that share at least 4/5 of their shingles."""
    pairs = written(pairs, "pairs")
    possible = written(_possible(pairs, classes), "possible-pairs")
    kind = "a long, size_{0} long, shingles_{0} array<long>"
    right = _sets(
        base, possible.groupBy(F.col("row_b").alias("row")).agg(F.collect_set("a").alias("of")), "b long, " + kind.format("b"),
        lambda s, of: {"b": set_key(s.view(np.uint64)), "a": of, "size_b": len(s), "shingles_b": [s] * len(of)},
    )
    counted = possible.groupBy("a").agg(F.first("row_a").alias("row"), F.count("*").alias("n"))
    left = _sets(
        base, counted.select("row", F.array("n").alias("of")), kind.format("a") + ", n long",
        lambda s, of: {"a": [set_key(s.view(np.uint64))], "size_a": len(s), "shingles_a": [s], "n": of},
    )
    right, left = written(right, "sets"), written(left, "sets")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    joined = spread_join(right, left, "a").filter(_near()).filter(shared * 5 >= (F.col("size_a") + F.col("size_b") - shared) * 4)
    links = written(joined.select("a", "b").distinct(), "links")
    discard(pairs, possible, left, right)
    return links


def _with_pivots(candidates: DataFrame) -> DataFrame:
    """(sig, node, n, pivot): the pivot of a group is its class with the most neighbours over all groups."""
    degree = candidates.groupBy("node").agg(F.sum("n").alias("degree"))
    group = Window.partitionBy("sig")
    return candidates.join(degree, "node").withColumn("pivot", F.max(F.struct("degree", "node")).over(group)["node"]).drop("degree")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of the groups that have several components."""
    group = Window.partitionBy("sig")
    return rows.withColumn("_low", F.min("component").over(group)).withColumn("_high", F.max("component").over(group)).filter("_low <> _high").drop("_low", "_high")


def _rare_pairs(base: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of classes of (node, component) rows that could link, by the rarest of the shingles that several of them have.

    A class lacks a match for ``alone`` shingles; two of them can only link if 9 * (alone_a + alone_b) <= size_a + size_b,
    so in each pair one has 9 * alone <= size. With the shingles in one order, rarest first, the first that two linked
    classes share leaves both enough places (``left``) for the 4/9 of size_a + size_b that they must share.
    """
    kept = classes.join(rows, "node").select("row", F.array("node", "component").alias("own"))
    columns = "node long, component long, size int, head array<long>, shingles array<long>"
    each = _sets(base, kept, columns, lambda s, own: {"node": own[:1], "component": own[1:], "size": len(s), "head": [sketch(s.view(np.uint64), HEAD)], "shingles": [s]})
    each = written(each.dropDuplicates(["node"]), "open-sets")
    single = each.select("node", "size", F.explode("shingles").alias("h"))
    counts = written(single.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "open-counts")
    known = spread_join(single, counts.select("h", "n", F.col("n").alias("often")), "h").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("known"))
    first = F.size("known") - F.ceil(F.col("size") * 0.8).cast("int") + 1
    short = known.filter(first > 0).select("node", "size", (F.col("size") - F.size("known")).alias("alone"), F.size("known").alias("left"), F.posexplode(F.slice("known", F.lit(1), first)).alias("at", "x"))
    short = short.select("node", "size", "alone", (F.col("left") - F.col("at")).alias("left"), F.col("x.h").alias("h")).join(each.select("node", "component", "head"), "node")
    short = written(short, "open-prefixes")
    a, b = (short.select("h", *(F.col(c).alias(f"{c}_{s}") for c in short.columns if c != "h")) for s in "ab")
    room = F.expr("9 * least(left_a, left_b) >= 4 * (size_a + size_b) AND 9 * (alone_a + alone_b) <= size_a + size_b")
    bits = sum((F.bit_count(F.col("head_a")[k].bitwiseXOR(F.col("head_b")[k])) for k in range(HEAD // 64)), F.lit(0))
    joined = a.filter("9 * alone_a <= size_a").join(b, "h").filter((F.col("component_a") != F.col("component_b")) & _near() & room & (9 * bits <= F.col("size_a") + F.col("size_b")))
    pairs = written(joined.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "rare-pairs")
    discard(each, counts, short)
    return pairs


def _hidden_pairs(base: DataFrame, classes: DataFrame, grouped: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may link, none of them with a pivot they were compared with."""
    placed = grouped.filter("node <> pivot").drop("pivot").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = written(_open(placed), "open-groups")
    small = rows.filter(F.col("n") <= SMALL_GROUP)
    a, b = (small.select("sig", F.col("node").alias(s), F.col("component").alias(f"component_{s}")) for s in "ab")
    pairs = a.join(b, "sig").filter((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))).select("a", "b").distinct()
    large = rows.filter(F.col("n") > SMALL_GROUP).select("node", "component").distinct()
    return pairs if large.isEmpty() else pairs.unionByName(_rare_pairs(base, classes, large)).distinct()


def _placed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of ``df``: (row, doc_id, n_shingles, node) of every row, node null without a set; (node, low_id, n, component) of every class."""
    base = id_and_text(df, id_col, text_col)
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    members = written(_members(base), "members")
    classes = written(_classes(members), "classes")
    candidates = written(_candidates(base, _hot_classes(members, classes)), "candidates")
    grouped = written(_with_pivots(candidates), "pivots")
    discard(candidates)
    links = _links(base, classes, grouped.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    first = connected_components(links)
    hidden = _links(base, classes, _hidden_pairs(base, classes, grouped, first))
    components = first if hidden.isEmpty() else connected_components(links.unionByName(hidden))
    placed = written(classes.select("node", "low_id", "n").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    discard(grouped, links, hidden)
    return members.drop("sketch"), placed


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: row (its number), doc_id, n_shingles, component_id (the smallest id that links reach)."""
    members, placed = _placed(df, id_col, text_col)
    names = written(placed.groupBy("component").agg(F.min("low_id").alias("component_id"), F.count("*").alias("n"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows"), "names")
    named = written(spread_join(placed.withColumnRenamed("n", "copies"), names, "component").select("node", "component_id", F.col("copies").alias("n")), "named")
    return spread_join(members, named, "node", "left").select("row", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (nulls last), then of the smallest row number, then any of the rows alike."""
    members, placed = _placed(df, id_col, text_col)
    inside = spread_join(members.filter(F.col("node").isNotNull()), placed.select("node", "component", "n"), "node")
    best = inside.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("_best"), F.count("*").alias("n")).filter("n > 1")
    grouped = written(spread_join(inside, written(best, "best"), "component").select(F.col("row").alias("_row"), (F.col("row") != F.col("_best.row")).alias("_gone")), "near-copies")
    gone = grouped.filter("_gone").select("_row").distinct()
    number = F.xxhash64(df[id_col], df[text_col])
    kept = df.join(_few(gone), number == gone["_row"], "left_anti")
    twins = written(grouped.filter("NOT _gone").groupBy("_row").agg(F.count("*").alias("_n")).filter("_n > 1").select("_row"), "twins")
    if twins.isEmpty():
        return kept
    alone = kept.join(_few(twins), number == twins["_row"], "left_anti")
    return alone.unionByName(kept.join(_few(twins), number == twins["_row"], "left_semi").dropDuplicates([id_col, text_col]))


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, broadcast if these are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
each AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, any_value(s.n) AS n_shingles, min(r.other) AS component_id FROM sized s JOIN reach r USING (doc_id) GROUP BY s.doc_id
"""

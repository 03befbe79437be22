"""Repeated byte strings: every byte under a string of 400 bytes that also starts elsewhere is removed.

Anchored hash refinement, not a merge of suffix orders: no suffixes are ordered or interleaved. Each window of 400 bytes holds exactly
one anchor, the 128-byte string of least hash in it; only suffixes at anchors are looked at, about one in 137. Anchors
are grouped into intervals (suffixes with a common prefix), which are refined from depth to depth:

1. depth 128: anchors by the hash of their 128 bytes. An interval with one member is done: nothing there repeats. If
   all members agree on everything their windows cover, all those windows repeat.
2. depth 369 and 431: in what is left, blocks of 32 windows, by what all of them share and by all they cover. A
   block that shares its core with none is done; blocks that agree on all they cover repeat whole.
3. depth 400: the windows of the blocks still open, one by one.

Prefixes are told apart by 64-bit hashes of their bytes, made by doubling. Intervals are counted by grouping with
partial sums in every shard, so no interval is ever gathered in one task, however many suffixes it has.

Cases: a null text is empty; texts under 400 bytes lose nothing; rows that repeat an id are documents of their own, and
repeat each other if alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellis.llm.common import discard, id_and_text, spread_join, written

LENGTH, GRAM, BLOCK = 400, 128, 32
SPAN = LENGTH - GRAM + 1
_CHUNK = 1 << 18
_AT = np.uint64((1 << 24) - 1)
#: Up to so many places or spans are broadcast, in all their arrays (some 50 MB); more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _doubled(low: np.ndarray, step: int, level: int) -> np.ndarray:
    """Hashes of the strings of twice the length, where both halves are there."""
    x = low[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * level) + low[step:]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _levels(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the strings of 128 and of 256 bytes at every position that has them."""
    level = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    level ^= level >> np.uint64(32)
    kept, size = {}, 1
    while size < 256:
        level = _doubled(level, size, size)
        size *= 2
        if size >= GRAM:
            kept[size] = level
    return kept


def _joined(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros_like(parts[0])
    for part in parts:
        x = (x ^ part) * np.uint64(0xE7037ED1A0B428DB)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


def _covers(hashes: np.ndarray, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of the strings from ``first``, of 256 to 720 bytes, by three strings of 256 that cover them."""
    size = np.broadcast_to(np.asarray(size), first.shape)
    return _joined(hashes[first], hashes[first + np.minimum(size - 256, 232)], hashes[first + size - 256], size.astype(np.uint64))


def _window_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _joined(hashes[first], hashes[first + LENGTH - 256])


def _anchors(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of the documents that end at ``ends`` in ``data``: their place, the windows they stand for, their hashes."""
    empty = {k: np.empty(0, np.int64) for k in ("lo", "hi", "at", "key", "cover")}
    if len(data) < LENGTH:
        return empty
    kept = _levels(data)
    order = (kept[GRAM] & ~_AT) | np.arange(len(kept[GRAM]), dtype=np.uint64)
    least, size = order, 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
    document = np.searchsorted(ends, np.arange(len(least)), side="right")
    inside = ends[document] - np.arange(len(least)) >= LENGTH
    at = (least & _AT).astype(np.int64)
    at[~inside] = -1
    borders = np.flatnonzero(np.diff(at, prepend=-2))
    lo, hi = borders, np.append(borders[1:], len(at)) - 1
    real = at[lo] >= 0
    lo, hi = lo[real], hi[real]
    if not len(lo):
        return empty
    at = at[lo]
    cover = _covers(kept[256], lo, hi - lo + LENGTH)
    return {"lo": lo, "hi": hi, "at": at, "key": kept[GRAM][at].view(np.int64), "cover": _joined(cover.view(np.uint64), (at - lo).astype(np.uint64))}


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several documents, or of a part of a long one: data, ends of documents in it, their numbers, their first positions."""
    block, numbers, size = [], [], 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(block), np.uint8), np.cumsum([len(b) for b in block]), np.array(numbers), np.zeros(len(block), np.int64)

    for number, text in enumerate(texts):
        data = (text or "").encode()
        if len(data) < LENGTH:
            continue
        if len(data) > 4 * _CHUNK:  # parts overlap by one window less a byte, so every window is in one part
            for first in range(0, len(data) - LENGTH + 1, 2 * _CHUNK):
                part = np.frombuffer(data[first : first + 2 * _CHUNK + LENGTH - 1], np.uint8)
                yield part, np.array([len(part)]), np.array([number]), np.array([first])
            continue
        block.append(data)
        numbers.append(number)
        size += len(data)
        if size >= _CHUNK:
            yield packed()
            block, numbers, size = [], [], 0
    if block:
        yield packed()


def _all_anchors(base: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["row"].to_numpy()
            for data, ends, numbers, firsts in _chunks(batch["text"].tolist()):
                found = _anchors(data, ends)
                if len(found["at"]):
                    document = np.searchsorted(ends, found["at"], side="right")
                    move = firsts[document] - np.append(0, ends[:-1])[document]
                    order = np.argsort(found["key"], kind="stable")
                    yield pd.DataFrame({"key": found["key"], "cover": found["cover"], "row": rows[numbers[document]], "lo": found["lo"] + move, "hi": found["hi"] + move, "at": found["at"] + move}).iloc[order]

    return base.mapInPandas(run, "key long, cover long, row long, lo long, hi long, at long")


def _few(grouped: DataFrame, arrays: str) -> DataFrame:
    """``grouped``, broadcast if its rows and the members of its arrays are few."""
    size = grouped.agg(F.coalesce(F.sum(F.size(arrays) + 1), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(grouped) if size <= BROADCAST_ROWS else grouped


def _on_texts(base: DataFrame, places: DataFrame, columns: str, make) -> DataFrame:
    """``make(key, lo, hi, at, hash)`` for the (row, key, lo, hi, at) of each text; it gives a dict of arrays and ``which`` place each is of."""
    grouped = written(places.groupBy("row").agg(F.collect_set(F.struct("key", "lo", "hi", "at")).alias("places")), "places")
    joined = base.join(_few(grouped, "places"), "row").dropDuplicates(["row"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text, places in zip(batch["row"], batch["text"], batch["places"], strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                key, lo, hi, at = (np.array([p[c] for p in places], np.int64) for c in ("key", "lo", "hi", "at"))
                turn = np.argsort(lo)
                key, lo, hi, at = key[turn], lo[turn], hi[turn], at[turn]
                begin = 0
                while begin < len(lo):  # places near each other share one stretch of the text
                    end, stop = begin + 1, hi[begin] + LENGTH
                    while end < len(lo) and lo[end] < stop + 2048 and stop - lo[begin] < 4 * _CHUNK:
                        stop = max(stop, hi[end] + LENGTH)
                        end += 1
                    offset, part = lo[begin], slice(begin, end)
                    out = make(key[part], lo[part] - offset, hi[part] - offset, at[part] - offset, _levels(data[offset:stop])[256])
                    for c in ("lo", "hi", "at"):
                        if c in out:
                            out[c] = out[c] + offset
                    if len(out["lo"]):
                        yield pd.DataFrame(out | {"row": row})
                    begin = end

    return joined.mapInPandas(run, columns)


def _blocks(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The blocks of 32 windows of every place, by distance from the anchor; cover is 0 if the place has only a part of the block."""
    first, last = (at - hi) // BLOCK, (at - lo) // BLOCK
    count = last - first + 1
    which = np.repeat(np.arange(len(at)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    near = at[which] - BLOCK * step  # start of the block's last window
    core = _joined(_covers(hashes, near, LENGTH - BLOCK + 1).view(np.uint64), key[which].view(np.uint64), step.astype(np.uint64))
    low, high = np.maximum(near - BLOCK + 1, lo[which]), np.minimum(near, hi[which])
    whole = high - low == BLOCK - 1
    cover = np.zeros(len(which), np.int64)
    cover[whole] = _covers(hashes, low[whole], LENGTH + BLOCK - 1) | 1
    return {"core": core, "cover": cover, "lo": low, "hi": high, "at": at[which], "key": key[which]}


def _windows(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    count = hi - lo + 1
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return {"hash": _window_hashes(hashes, first), "lo": first}


def repeated_spans(base: DataFrame) -> DataFrame:
    """(row, lo, hi): windows lo to hi of the text of (row, text) repeat; a row may have several, in any order."""
    alike = lambda bare: ((F.col("_least") == F.col("_most")) & bare).alias("alike")
    anchors = written(_all_anchors(base), "anchors")
    intervals = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("cover").alias("_least"), F.max("cover").alias("_most")).filter("n > 1")
    intervals = written(intervals.select("key", "n", alike(F.lit(True))), "intervals")
    shared = written(spread_join(anchors, intervals, "key"), "shared-anchors")
    discard(anchors, intervals)
    mixed = shared.filter(~F.col("alike"))
    classes = written(mixed.groupBy("key", "cover").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi", "at")).alias("one")), "classes")
    again = spread_join(mixed, classes.filter("n > 1").select("key", "cover", "n"), ["key", "cover"], "left_semi")
    one = classes.select("key", "one.*")
    blocks = written(_on_texts(base, one, "core long, cover long, lo long, hi long, at long, key long, row long", _blocks), "blocks")
    cores = blocks.groupBy("core").agg(F.count("*").alias("n"), F.min("cover").alias("_least"), F.max("cover").alias("_most")).filter("n > 1")
    cores = written(cores.select("core", "n", alike(F.col("_least") != 0)), "cores")
    open_blocks = written(spread_join(blocks, cores, "core"), "open-blocks")
    discard(blocks, cores)
    windows = written(_on_texts(base, open_blocks.filter(~F.col("alike")), "hash long, lo long, row long", _windows), "windows")
    several = windows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    spans = shared.filter("alike").select("row", "lo", "hi").unionByName(again.select("row", "lo", "hi")).unionByName(open_blocks.filter("alike").select("row", "lo", "hi"))
    spans = written(spans.unionByName(spread_join(windows, several, "hash").select("row", "lo", F.col("lo").alias("hi"))), "all-spans")
    discard(shared, classes, open_blocks, windows)
    return spans


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the windows of ``spans``, the bytes removed and the maximal runs removed."""
    left, at, runs, removed = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(spans):
        stop = hi + LENGTH
        if lo > end:
            left.append(data[at:lo])
            runs += 1
            removed += stop - lo
        elif stop > end:
            removed += stop - end
        end = at = max(end, stop)
    left.append(data[at:])
    return b"".join(left), removed, runs


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes left."""
    base = id_and_text(df, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(base.select("row", "text"))
    grouped = written(spans.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(spans)
    joined = base.join(_few(grouped, "spans"), "row", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, found in zip(batch["text"], batch["spans"], strict=True):
                data = (text or "").encode()
                kept, removed, runs = cut(data, [] if found is None else [(s["lo"], s["hi"]) for s in found])
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = base.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and how often two tokens overlap.

The tokens of A and B over one text are the two sides of a graph, with an edge where their byte ranges overlap. Its connected
components, found by union-find, are the minimal groups: a border between two groups is a place where tokens of both sides end.
The overlapping pairs among a component's members are its links; they are counted over the whole corpus. Union-find hooks and
compresses the trees of many pieces at a time, as arrays: no component goes over the end of a piece.

Cases: a null or empty text, or one whose tokens do not give back a space and the text, has no tokens; repeated rows each give their row and
count each time; an empty table gives an empty result; further columns go. A very long text is encoded whole, by itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellis.llm.common import id_and_text, spread_join, written

#: With no more pairs than this their counts (17 bytes a pair) go to every task; beyond it they are joined by shuffle.
MAX_PAIRS = 2_000_000
#: So many texts are looked up together, so many new pieces encoded in one string; a task remembers so many pieces of up to so many characters.
CHUNK, BLOCK, MAX_PIECES, LONGEST = 256, 64, 100_000, 40
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 stands for itself, other bytes for U+0100 and on."""
    printable = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 255 and k != 173]
    others = sorted(set(range(256)) - set(printable))
    return {chr(k): k for k in printable} | {chr(256 + n): k for n, k in enumerate(others)}


class ByteLevelSide:
    """Ids and token bytes of a tokenizers file with a byte-level vocabulary, encoded by its ranks: an id says when its merge comes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        of, special = byte_alphabet(), {t["id"] for t in told["added_tokens"]}
        ranks = {bytes(of[c] for c in token): i for token, i in told["model"]["vocab"].items() if i not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [told["model"]["vocab"]["".join(m)] for m in merges]
        if made != sorted(made):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.data = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.data[i] = data

    def ids(self, text: str) -> list[int]:
        """Ids of a space and the text; their special strings are plain text."""
        return self.library.encode_ordinary(" " + text)


class PieceSide:
    """Ids and token bytes of a sentencepiece model, which puts a space before the text. ``cuts``: no piece goes on over a space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.data = [bytes((int(p[3:5], 16),)) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text)


class Side:
    """One tokenizer with the lengths of its tokens in bytes."""

    def __init__(self, made: ByteLevelSide | PieceSide):
        self.made, self.lengths = made, np.array([len(d) for d in made.data], "i8")

    def exact(self, texts: list[str]) -> np.ndarray | None:
        """Ids of texts one after the other; None if their bytes are not a space and the text each time."""
        ids = [i for t in texts for i in self.made.ids(t)]
        kept = b"".join(map(self.made.data.__getitem__, ids)) == "".join(f" {t}" for t in texts).encode()
        return np.array(ids, "i8") if kept else None


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes over the edges (u, v): roots are hooked to smaller ones, then paths compressed."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


class Alignment:
    """The groups and links of texts that stand one after the other, given all ids, how many each text has, and the lengths of the tokens."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.a, self.n_a, self.b, self.n_b = a, n_a, b, n_b
        na, nb = len(self.a), len(self.b)
        held_a, held_b = np.repeat(np.arange(na), lengths_a[self.a]), np.repeat(np.arange(nb), lengths_b[self.b])  # the token over each byte
        if len(held_a) != len(held_b):
            raise ValueError("the two sides do not cover the same bytes")
        first_a, first_b = np.cumsum(lengths_a[self.a]) - lengths_a[self.a], np.cumsum(lengths_b[self.b]) - lengths_b[self.b]
        # of two overlapping tokens one starts inside the other, so these edges are all that overlap
        root = components(np.concatenate([np.arange(na), na + np.arange(nb)]), np.concatenate([na + held_b[first_a], held_a[first_b]]), na + nb)
        number = np.cumsum(root[:na] == np.arange(na)) - 1  # a group's smallest node is its first token of A
        self.group_a, self.group_b = number[root[:na]], number[root[na:]]
        starts = np.zeros(len(held_a), bool)
        starts[first_a] = starts[first_b] = True
        at = np.flatnonzero(starts)  # the bytes of one link lie between two neighbouring ends
        self.link_a, self.link_b = held_a[at], held_b[at]
        self.links_upto = np.searchsorted(self.link_a, np.cumsum(n_a) - 1, "right")
        self.n_links = np.diff(self.links_upto, prepend=0)
        self.n_groups = np.diff(self.group_a[np.cumsum(n_a) - 1] + 1, prepend=0) if na else np.zeros(0, "i8")

    def printed(self, names: Names) -> Iterator[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        many = int(self.group_a[-1]) + 1 if len(self.a) else 0
        per_a, per_b = np.bincount(self.group_a, minlength=many), np.bincount(self.group_b, minlength=many)
        upto_a, upto_b = np.cumsum(per_a), np.cumsum(per_b)
        order = np.empty(len(self.a) + len(self.b), "i8")
        order[np.arange(len(self.a)) + (upto_b - per_b)[self.group_a]] = 3 * self.a
        order[np.arange(len(self.b)) + upto_a[self.group_b]] = 3 * self.b
        order[upto_a + upto_b - per_b - 1] += 1
        order[upto_a + upto_b - 1] += 2
        text = names.signs[order][names.there[order]].tobytes()
        ends = np.concatenate([[0], np.cumsum(names.lengths[order])])[np.cumsum(self.n_a + self.n_b)].tolist()
        for start, end in zip([0, *ends], ends, strict=False):
            yield text[start : end - 1]


class Names:
    """Every id in decimals with a comma, a bar and a semicolon after it: three rows an id, as bytes of which ``there`` marks the used ones."""

    def __init__(self, n: int):
        words = [f"{i}{sign}".encode() for i in range(n) for sign in ",|;"]
        self.lengths = np.array([len(w) for w in words], "i8")
        width = int(self.lengths.max())
        self.signs = np.array(words, f"S{width}").view("u1").reshape(-1, width)
        self.there = np.arange(width) < self.lengths[:, None]


class Aligner:
    """Aligns texts piece by piece and remembers the pieces: neither side goes on over a space between two other signs, so texts are cut there.

    ``numbers`` gives the place of a piece in ``printed`` (its groups), ``links`` (packed codes) and ``figures`` (n_a, n_b, n_groups, n_links);
    a piece whose bytes do not come back has None for its groups.
    """

    def __init__(self, a_path: str, pattern: str, b_path: str):
        self.one, self.two = Side(ByteLevelSide(a_path, pattern)), Side(PieceSide(b_path))
        self.cuts, self.width = self.two.made.cuts, len(self.two.lengths)
        self.kind = "<i8" if len(self.one.lengths) * self.width >= 1 << 31 else "<i4"
        self.names = Names(max(len(self.one.lengths), self.width))
        self.odd, self.between = regex.compile(r"\A | (?=\s|\Z)"), regex.compile(r"(?<=\S) (?=\S)")
        self._keep([])

    def _keep(self, pieces: list[str]) -> None:
        """Forgets all but these."""
        at = [self.numbers[p] for p in pieces] if pieces else []
        self.numbers = {p: k for k, p in enumerate(pieces)}
        self.printed = [self.printed[k] for k in at] if at else []
        self.links = [self.links[k] for k in at] if at else []
        self.figures = self.figures[at] if at else np.zeros((0, 4), "i8")
        self.used = np.zeros(len(at), "i8")

    def pieces(self, text: str) -> list[str]:
        return [text] if not self.cuts else self.between.split(text) if self.odd.search(text) else text.split(" ")

    def whole(self, texts: list[str]) -> Alignment | None:
        """The alignment of texts that can stand one after the other; None if some bytes do not come back."""
        blocks = [" ".join(texts[k : k + BLOCK]) for k in range(0, len(texts), BLOCK)]
        a, b = self.one.exact(blocks), self.two.exact(blocks)
        if a is None or b is None:
            return None
        ends = np.cumsum([1 + len(t.encode()) for t in texts])
        count = lambda side, ids: np.diff(1 + np.searchsorted(np.cumsum(side.lengths[ids]), ends), prepend=0)
        return Alignment(a, count(self.one, a), b, count(self.two, b), self.one.lengths, self.two.lengths)

    def _learn(self, pieces: list[str]) -> None:
        found = self.whole(pieces)
        if found is None and len(pieces) > 1:
            for piece in pieces:
                self._learn([piece])
            return
        first = len(self.printed)
        self.numbers.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.used = np.concatenate([self.used, np.zeros(len(pieces), "i8")])
        if found is None:
            self.printed.append(None)
            self.links.append(b"")
            self.figures = np.concatenate([self.figures, np.zeros((1, 4), "i8")])
            return
        self.printed += found.printed(self.names)
        size, packed = np.dtype(self.kind).itemsize, (found.a[found.link_a] * self.width + found.b[found.link_b]).astype(self.kind).tobytes()
        ends = (size * found.links_upto).tolist()
        self.links += [packed[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        self.figures = np.concatenate([self.figures, np.stack([found.n_a, found.n_b, found.n_groups, found.n_links], 1)])

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
        """(figures, printed groups, packed links) of every text; zeros and nothing for one without tokens."""
        nothing = (np.zeros(4, "i8"), b"", b"")
        for lo in range(0, len(texts), CHUNK):
            cut = [self.pieces(t) if t else [] for t in texts[lo : lo + CHUNK]]
            if len(self.printed) > MAX_PIECES:
                self._keep([p for p, k in self.numbers.items() if self.used[k] > 1])
                if len(self.printed) > MAX_PIECES // 2:
                    self._keep([])
            known = self.numbers
            found = [list(map(known.get, parts)) for parts in cut]
            new = {p for parts, at in zip(cut, found, strict=True) if None in at for p, k in zip(parts, at, strict=True) if k is None}
            odd = [p for p in new if len(p) > LONGEST or p.strip() != p]
            if plain := list(new.difference(odd)):
                self._learn(plain)
            for piece in odd:
                self._learn([piece])
            for text, parts, at in zip(texts[lo : lo + CHUNK], cut, found, strict=True):
                if None in at:
                    at = [known[p] if k is None else k for p, k in zip(parts, at, strict=True)]
                groups = list(map(self.printed.__getitem__, at))
                if None in groups:
                    if text not in known:
                        self._learn([text])
                        odd.append(text)
                    at = [known[text]]
                    groups = [self.printed[at[0]]]
                if not parts or None in groups:
                    yield nothing
                    continue
                np.add.at(self.used, at, 1)
                yield self.figures[at].sum(axis=0), b";".join(groups), b"".join(map(self.links.__getitem__, at))
            for piece in odd:  # long pieces and whole texts go at once
                if len(piece) > LONGEST and (k := known.pop(piece, None)) is not None:
                    self.printed[k], self.links[k] = b"", b""


def _lists(values: list[np.ndarray], kind: str = "i4") -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *values]).astype(kind)))


def aligned_groups(df: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, the ids on both sides and the number of the group each of them is in: a, a_group, b, b_group."""
    base = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, none = Aligner(a_path, pattern, b_path), np.zeros(0, "i8")
        for batch in batches:
            found = [aligner.whole([t]) if t else None for t in batch.column("text").to_pylist()]
            columns = [[none if x is None else getattr(x, c) for x in found] for c in ("a", "group_a", "b", "group_b")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(_lists, columns)], ["doc_id", "a", "a_group", "b", "b_group"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, a array<int>, a_group array<int>, b array<int>, b_group array<int>")


def _linked(base: DataFrame, a_path: str, pattern: str, b_path: str, kind: str) -> DataFrame:
    """(doc_id, counts, groups_sha256, links, _row), written: a link is ``a * width + b``, rows are numbered in the table as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, pattern, b_path)
        for batch in (b.slice(k, CHUNK) for b in batches for k in range(0, b.num_rows, CHUNK)):
            counts, digests, links = np.zeros((len(COUNTS), batch.num_rows), "i8"), [""] * batch.num_rows, []
            for k, (figures, groups, packed) in enumerate(aligner.aligned(batch.column("text").to_pylist())):
                counts[:, k] = figures
                links.append(np.frombuffer(packed, kind))
                if groups:
                    digests[k] = hashlib.sha256(groups).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), _lists(links, kind[1:])], ["doc_id", *COUNTS, "groups_sha256", "links"])

    id_kind, named = base.schema["doc_id"].dataType.simpleString(), ", ".join(f"{c} long" for c in COUNTS)
    made = base.mapInArrow(run, f"doc_id {id_kind}, {named}, groups_sha256 string, links array<{'long' if kind == '<i8' else 'int'}>")
    return written(made.withColumn("_row", F.monotonically_increasing_id()), "aligned")


def _counted(linked: DataFrame, width: int) -> DataFrame:
    """(link, n, best), written: a pair's count over the corpus, and whether no pair with the same b has more."""
    summed = written(linked.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")), "pairs")
    most = summed.groupBy(F.pmod("link", F.lit(width)).alias("b")).agg(F.max("n").alias("most"))
    return written(summed.withColumn("b", F.pmod("link", F.lit(width))).join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _aligned(df: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    aligner = Aligner(a_path, pattern, b_path)
    linked = _linked(id_and_text(df, id_col, text_col), a_path, pattern, b_path, aligner.kind)
    return linked, _counted(linked, aligner.width), aligner.width


def pair_counts(df: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n, best) of every pair of an A and a B token that some text links."""
    _, counts, width = _aligned(df, a_path, pattern, b_path, id_col, text_col)
    return counts.select(F.floor(F.col("link") / width).alias("a"), F.pmod("link", F.lit(width)).cast("long").alias("b"), "n", "best")


def alignment_digests(df: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 ('' without tokens)."""
    linked, counts, _ = _aligned(df, a_path, pattern, b_path, id_col, text_col)
    columns = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    if counts.count() > max_pairs:
        return _by_join(linked, counts).select(*columns)
    table = counts.orderBy("link").toArrow()
    sent = df.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("link", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in (b.slice(k, CHUNK) for b in batches for k in range(0, b.num_rows, CHUNK)):
            links = batch.column("links")
            at = np.searchsorted(known, links.flatten().to_numpy()).astype("i4")
            ends = np.cumsum(links.value_lengths().to_numpy())
            total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x[at], dtype="i8")])[ends], prepend=0), pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], total(best), total(n)], [*batch.schema.names[:-1], "n_best", "count_sum"])

    plain = linked.select("doc_id", *COUNTS, "groups_sha256", "links")
    kind, named = linked.schema["doc_id"].dataType.simpleString(), ", ".join(f"{c} long" for c in COUNTS)
    return plain.mapInArrow(run, f"doc_id {kind}, {named}, groups_sha256 string, n_best long, count_sum long").select(*columns)


def _by_join(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """The same for counts too many for a task: each row's links, summed up, are joined with their counts; hot pairs are cut into pieces."""
    each = linked.select("_row", F.explode("links").alias("link")).groupBy("_row", "link").agg(F.count("*").alias("times"))
    judged = spread_join(each, counts.withColumn("_rows", F.col("n")), "link", "inner", "_rows")
    sums = judged.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return linked.join(sums, "_row", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})

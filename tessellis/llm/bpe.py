"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

A rank vocabulary fixes, for every prefix of a byte string, one last token: the only token ending there that
is compatible with the last token of the prefix before it (two tokens are compatible if merging their joined
bytes gives the two back). So a left-to-right machine needs to remember only the places where a longer token
may still start, with the last token before each. Those are the states; they and their transitions are made
when they are first met. A token is certain as soon as every open place agrees on it, which is after fewer
bytes than two of the longest tokens have.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tessellis.llm.common import id_and_text

START = -1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token from the bytes of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class MergeTransducer:
    """Encodes one piece of bytes at a time; the tables are caches, emptied when they reach ``max_states``.

    A state lists the open places: where a longer token may start, with the last token before it and the bytes
    since. A move also gives the token that ends there. In a long piece the tokens that every open place agrees
    on leave after each ``block`` bytes; what stays open is shorter than two tokens.
    """

    block = 1024

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:k] for token in ranks for k in range(len(token))}
        self._bytes = [bytes((k,)) for k in range(256)]
        self.none = max(ranks.values()) + 1
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._whole: dict[int, bool] = {}
        self._spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self._fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[tuple[tuple[int, bytes], ...], int] = {}
        self._states: list[tuple[tuple[int, bytes], ...]] = []
        self._moves: dict[int, tuple[int, int]] = {}
        self._state(((START, b""),))

    def merged(self, data: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first: the definition the transducer is built from."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1 and (at := self._lowest(parts)) is not None:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _made_of(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte and for what merging never gives."""
        if rank not in self._halves:
            data, known = self.tokens[rank], None
            parts = [data[k : k + 1] for k in range(len(data))]
            while len(parts) > 2 and (at := self._lowest(parts)) is not None:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                known = (self.ranks[parts[0]], self.ranks[parts[1]])
            self._halves[rank] = known
            self._whole[rank] = len(parts) < 3
        return self._halves[rank]

    def _lowest(self, parts: list[bytes]) -> int | None:
        pairs = [self.ranks.get(a + b, self.none) for a, b in zip(parts, parts[1:], strict=False)]
        lowest = min(pairs)
        return pairs.index(lowest) if lowest < self.none else None

    def _is_whole(self, rank: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        if rank not in self._whole:
            self._made_of(rank)
        return self._whole[rank]

    def _spine(self, rank: int, side: int) -> list[int]:
        """The tokens at the right (1) or left (0) edge of a token while it is merged, from the byte up to itself."""
        if (known := self._spines[side].get(rank)) is None:
            half = self._made_of(rank)
            known = self._spines[side][rank] = ([] if half is None else self._spine(half[side], side)) + [rank]
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge over the border comes before those inside ``left`` and ``right``.

        At any time the tokens at the border are one of each edge. The next merge is that of the lowest rank;
        of equal ranks, the one further left.
        """
        if left == START:
            return True
        key = left << 20 | right
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 10 * self.max_states:
                self._fits.clear()
            a, b, tokens = self._spine(left, 1), self._spine(right, 0), self.tokens
            i = j = 0
            known = True
            while known:
                up_a = a[i + 1] if i + 1 < len(a) else self.none
                up_b = b[j + 1] if j + 1 < len(b) else self.none
                over = self.ranks.get(tokens[a[i]] + tokens[b[j]], self.none)
                if over < up_a and over <= up_b and over < self.none:
                    known = False
                elif up_a == up_b == self.none:
                    break
                elif up_a <= up_b:
                    i += 1
                else:
                    j += 1
            self._fits[key] = known
        return known

    def _state(self, places: tuple[tuple[int, bytes], ...]) -> int:
        """The number of the state with these open places."""
        if (known := self._ids.get(places)) is None:
            known = self._ids[places] = len(self._states)
            self._states.append(places)
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the length of the token that ends with ``byte``, times 2**20 and with its rank added."""
        step, found, still = self._bytes[byte], None, []
        for before, part in self._states[state]:
            part += step
            if found is None and (rank := self.ranks.get(part)) is not None and self._is_whole(rank) and self._compatible(before, rank):
                found = rank
            if part in self.prefixes:
                still.append((before, part))
        if found is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        still.append((found, b""))
        return self._state(tuple(still)), len(self.tokens[found]) << 20 | found

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens on the way back from position ``at``; ends[k]: the token that ends after k + 1 bytes."""
        found = []
        while at > 0:
            found.append(ends[at - 1] & 0xFFFFF)
            at -= ends[at - 1] >> 20
        found.reverse()
        return found

    def _certain(self, ends: list[int], state: int) -> int:
        """The last position on the ways back from every open place."""
        sure = len(ends)
        for _, part in self._states[state]:
            at = len(ends) - len(part)
            while at != sure:
                if at > sure:
                    at -= ends[at - 1] >> 20
                else:
                    sure -= ends[sure - 1] >> 20
        return sure

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is itself a token is that token."""
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        if len(self._states) > self.max_states:
            self._reset()
        state, out, ends, moves = 0, [], [], self._moves
        for byte in piece:
            key = state << 8 | byte
            if (move := moves.get(key)) is None:
                move = moves[key] = self._move(state, byte)
            state, end = move
            ends.append(end)
            if len(ends) >= self.block:
                sure = self._certain(ends, state)
                out += self._back(ends, sure)
                del ends[:sure]
                if len(self._states) > 2 * self.max_states:
                    places = self._states[state]
                    self._reset()
                    state, moves = self._state(places), self._moves
        return out + self._back(ends, len(ends))


class _Kept(dict):
    """A cache of ``make``, emptied when it has ``most`` entries; long keys are not kept."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 40):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


class TextEncoder:
    """Ids of a whole text as little-endian unsigned 32-bit integers.

    No match of the pattern goes over a single space that has text on both sides, except by starting with it.
    So a text without a space before white space or at its end is cut at its spaces, and each piece is looked
    up; other texts are matched as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_kept: int = 500_000):
        self.transducer, self.pattern = MergeTransducer(ranks), regex.compile(pattern)
        self.odd_space = regex.compile(r" (?=\s|\Z)")
        self.matches = _Kept(self._match, max_kept)
        self.first, self.later = _Kept(self.by_pattern, max_kept // 10), _Kept(lambda piece: self.by_pattern(" " + piece), max_kept)

    def _match(self, text: str) -> bytes:
        return struct.pack(f"<{len(ids := self.transducer.encode(text.encode()))}I", *ids)

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.odd_space.search(text):
            return self.by_pattern(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


class StreamDecoder:
    """Turns ids into text block by block; bytes of an unfinished character wait for the next block.

    The state is the unfinished character: a lead byte that announces two, three or four bytes and the
    continuation bytes that have come. Invalid bytes become U+FFFD, as in any UTF-8 decoder.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.waiting = tokens, b""

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        data = self.waiting + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data) if last else self._complete(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _complete(data: bytes) -> int:
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return len(data) - back if need > back else len(data)
            if byte < 0x80:
                break
        return len(data)


def _decoded(tokens: dict[int, bytes], ids: np.ndarray, block: int) -> Iterator[str]:
    decoder = StreamDecoder(tokens)
    for k in range(0, len(ids), block):
        yield decoder.feed(ids[k : k + block].tolist())
    yield decoder.feed((), last=True)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and its ``ids`` (array<int>); a null text has none, repeated rows stay, further columns go."""
    data = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder(read_ranks(data.value), pattern)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t or ""), "<u4").astype("i4") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    base = id_and_text(df, id_col, text_col)
    return base.mapInPandas(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(df: DataFrame, ranks_path: str, block: int = 65_536) -> DataFrame:
    """The texts of (doc_id, ids): the other way round of :func:`encode_documents`; null ids give an empty text."""
    data = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = {rank: token for token, rank in read_ranks(data.value).items()}
        for batch in batches:
            texts = ["" if ids is None else "".join(_decoded(tokens, np.asarray(ids), block)) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return df.select("doc_id", "ids").mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def token_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = 65_536) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding again.

    A null text counts as empty; repeated rows each give a row; an empty table gives none; further columns go.
    """
    data = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = read_ranks(data.value)
        encoder = TextEncoder(ranks, pattern)
        tokens = encoder.transducer.tokens
        for batch in batches:
            counts, digests, texts = [], [], []
            for text in batch["text"]:
                packed = encoder.encode(text or "")
                again = hashlib.sha256()
                for part in _decoded(tokens, np.frombuffer(packed, "<u4"), block):
                    again.update(part.encode())
                counts.append(len(packed) // 4)
                digests.append(hashlib.sha256(packed).hexdigest())
                texts.append(again.hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": digests, "decoded_sha256": texts})

    base = id_and_text(df, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

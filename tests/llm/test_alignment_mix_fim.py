"""Operators 11 to 13 against plain versions, with nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessellis.llm import alignment, fim, mixing

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> plain <s> </s> <unk>", "  two  spaces \n\n and\ttabs ", "中文没有空格也要对齐。日本語も", "é̂ ﬁ ②  x　y", "a ▁ b", "x▁y", "\x00 nul \x1c sep", "🙂🙃 👩‍👩‍👧", "naïve café 1234567890 ===== ----", "\n", " ", "a" * 3000, "تونس والمغرب"]


# 11 cross-tokenizer alignment


class PlainSides:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        stay = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        self.of, extra = {chr(k): k for k in stay}, 0
        for k in range(256):
            if k not in stay:
                self.of[chr(256 + extra)] = k
                extra += 1

    def tokens(self, text):
        """[(id, bytes)] of both sides, or nothing."""
        if not text:
            return [], []
        a = [(i, bytes(self.of[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


@pytest.fixture(scope="module")
def sides():
    return PlainSides()


def ranges(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def plain_alignment(sides, texts):
    held, counts = [], Counter()
    for text in texts:
        a, b = map(ranges, sides.tokens(text))
        links = [(i, j) for i, lo, hi in a for j, low, high in b if lo < high and low < hi]
        counts.update(links)
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([i for i, lo, hi in a if s <= lo < e], [j for j, lo, hi in b if s <= lo < e]) for s, e in zip([0, *both], both, strict=False)]
        held.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for n_a, n_b, groups, links in held:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), plain.sha(shown) if groups else ""))
    return out, counts, best


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("max_pairs", [alignment.MAX_PAIRS, 3])
def test_alignment_matches_the_plain_version(spark, frame, corpus, sides, max_pairs):
    rows = corpus(45, 21) + [(100 + k, t) for k, t in enumerate(ODD)] + [(7, "again again"), (7, "again again"), (None, "no id here")]
    want, counts, best = plain_alignment(sides, [t for _, t in rows])
    got = alignment.alignment_digests(frame(rows), A, public_tokenizers.PATTERN, B, max_pairs=max_pairs)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((k, *w)) for (k, _), w in zip(rows, want, strict=True))
    if max_pairs > 3:
        pairs = alignment.pair_counts(frame(rows), A, public_tokenizers.PATTERN, B).collect()
        assert {(r.a, r.b): (r.n, r.best) for r in pairs} == {x: (n, n == best[x[1]]) for x, n in counts.items()} and len(pairs) == len(counts)
        assert [r for r in got.collect() if r.doc_id is not None and r.doc_id in (104, 105)][0].n_a == 0  # U+2581 in a text does not come back


def test_groups_of_tokens_in_order(spark, frame, sides):
    texts = ["hello wörld", "  odd  ", None, ""]
    got = {r.doc_id: r for r in alignment.aligned_groups(frame(list(enumerate(texts))), A, public_tokenizers.PATTERN, B).collect()}
    for k, text in enumerate(texts):
        a, b = sides.tokens(text)
        assert list(got[k].a) == [i for i, _ in a] and list(got[k].b) == [i for i, _ in b]
        for _, group in [*zip(got[k].a, got[k].a_group, strict=True)]:
            mine = b"".join(x for (_, x), g in zip(a, got[k].a_group, strict=True) if g == group)
            assert mine == b"".join(x for (_, x), g in zip(b, got[k].b_group, strict=True) if g == group)


def test_alignment_of_nothing_and_of_very_long_texts(spark, frame, sides):
    assert alignment.alignment_digests(frame([]), A, public_tokenizers.PATTERN, B).count() == 0
    empty = alignment.alignment_digests(frame([(1, None), (2, "")]), A, public_tokenizers.PATTERN, B).orderBy("doc_id").collect()
    assert [r.asDict() for r in empty] == [{"doc_id": k} | dict.fromkeys(COLUMNS, 0) | {"groups_sha256": ""} for k in (1, 2)]
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9))) for _ in range(40_000))
    got = alignment.alignment_digests(frame([(1, long), (2, "x" * 120_000)]), A, public_tokenizers.PATTERN, B).orderBy("doc_id").collect()
    for row, text in zip(got, (long, "x" * 120_000), strict=True):
        a, b = map(ranges, sides.tokens(text))
        ends = {e for *_, e in a} & {e for *_, e in b}
        assert (row.n_a, row.n_b, row.n_groups, row.n_links) == (len(a), len(b), len(ends), len({e for *_, e in a} | {e for *_, e in b}))


def test_pieces_are_forgotten_without_trace(monkeypatch, sides):
    monkeypatch.setattr(alignment, "MAX_PIECES", 20)
    monkeypatch.setattr(alignment, "CHUNK", 3)
    r = random.Random(8)
    texts = [" ".join(r.choice(["one", "two", "wörd", "a\nb", "x" * 60, "▁", " "]) + str(r.randint(0, 30)) for _ in range(12)) for _ in range(60)]
    aligner = alignment.Aligner(A, public_tokenizers.PATTERN, B)
    want, _, _ = plain_alignment(sides, texts)
    for (figures, groups, _), w in zip(aligner.aligned(texts), want, strict=True):
        assert tuple(figures) == w[:4] and (plain.sha(groups) if groups else "") == w[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_components_are_those_of_the_graph(edges):
    parent = list(range(15))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    u, v = (np.array([e[k] for e in edges], "i8") for k in (0, 1))
    assert alignment.components(u, v, 15).tolist() == [find(x) for x in range(15)]


# 12 mixing sources to target weights


def plain_mix(rows, weights=(1, 2, 3), cap=3):
    """[(id, size, source size, target, taken)]; ids differ."""
    sizes = [len(plain.words(t)) for _, t, _ in rows]
    total, per = sum(sizes), defaultdict(int)
    for (_, _, s), n in zip(rows, sizes, strict=True):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:
        open_weight = sum(weight[s] for s in order if s not in full)
        level = (total - cap * sum(per[s] for s in full)) / open_weight if open_weight else 0.0
        more = {s for s in order if s not in full and weight[s] * level >= cap * per[s]}
        if not more:
            break
        full |= more
    target = {s: cap * float(per[s]) if s in full else weight[s] * level for s in order}
    taken = {}
    for s in order:
        copies = target[s] / per[s] if per[s] else 0.0
        whole, part = int(copies), copies - int(copies)
        mine = [(k, n) for (k, _, x), n in zip(rows, sizes, strict=True) if x == s]
        taken |= {k: whole * n for k, n in mine}
        left = target[s] - whole * per[s]
        ranked = []
        for k, n in mine:
            u = (int(hashlib.sha256(f"mix:{'' if k is None else k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if part > 0 and n:
                odds = (u / (1 - u)) / (part / (1 - part))
                ranked.append((odds / (1 + odds), -1 if k is None else k, n, k))
        ranked.sort(key=lambda x: x[:3])
        short = [x for x in ranked if x[2] <= left]
        sums = np.cumsum([x[2] for x in short]).tolist()
        fit = [x for x, upto in zip(short, sums, strict=True) if upto <= left]
        gap = left - (sums[len(fit) - 1] if fit else 0)
        rest = sorted((x for x in ranked if x not in fit), key=lambda x: (abs(x[2] - gap), *x[:3]))
        for x in fit + [x for x in rest[:1] if abs(x[2] - gap) < gap]:
            taken[x[3]] += x[2]
    return [(k, n, per[s], target[s], taken[k]) for (k, _, s), n in zip(rows, sizes, strict=True)]


def sourced(spark, rows):
    clash = ["s", "u", "v", "id", "size", "level", "target", "taken", "whole", "n", "row", "preference", "cut"]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *(f"'x' AS {c}" for c in clash))


@pytest.fixture
def mixture():
    r = random.Random(4)
    names = ["b", "a", "é", "Z", "", None, "only blanks", "tiny"]
    rows = [(k, " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(names[:6] + ["a"] * 8)) for k in range(600)]
    return rows + [(1000, None, "a"), (1001, "", "b"), (1002, " \n", "only blanks"), (1003, "one two", "tiny"), (1004, "x " * 30_000, "b"), (None, "no id", "Z")]


@pytest.mark.parametrize("bracket", [mixing.MAX_BRACKET, 2])
def test_mix_matches_the_plain_version(spark, mixture, bracket, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BRACKET", bracket)
    got = mixing.mix_shares(sourced(spark, mixture))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_mix(mixture)))


def test_mix_comes_near_its_targets_and_is_the_same_again(spark, mixture, monkeypatch):
    df = sourced(spark, mixture)
    first, again = (sorted(map(tuple, mixing.mix_shares(x).collect()), key=str) for x in (df, df.repartition(5)))
    assert first == again and all(t <= 3 * n for _, n, _, _, t in first)
    sums = defaultdict(lambda: [0, 0.0])
    for (k, *_), (_, _, s) in zip(sorted(mixture, key=lambda r: str(r[0])), sorted(mixture, key=lambda r: str(r[0])), strict=True):
        row = next(r for r in first if r[0] == k)
        sums[s][0] += row[4]
        sums[s][1] = row[3]
    for s, (taken, target) in sums.items():
        if s != "b":  # its one very long document is more than it needs, and all others are less
            assert abs(taken - target) <= max(3, 0.01 * target), s
    assert all(t for k, n, _, _, t in first for (i, _, s) in mixture if k == i and s == "b" and 0 < n < 30_000)
    assert abs(sum(t for _, t in sums.values()) - sum(r[1] for r in first)) < 1
    monkeypatch.setattr(mixing, "MAX_SENT", 0)  # sources too many to broadcast
    assert sorted(map(tuple, mixing.mix_shares(df).collect()), key=str) == first


def test_mixed_documents_are_the_rows_as_often_as_they_are_taken(spark, mixture):
    df = sourced(spark, mixture)
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_shares(df).collect()}
    rows = mixing.mixed_documents(df)
    assert rows.columns == df.columns
    times = Counter(r.doc_id for r in rows.collect())
    assert all(times[k] * n == t for k, (n, t) in taken.items() if n)


def test_preferred_documents_are_taken_more_often(spark):
    rows = [(k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("good", F.col("doc_id") % 5 == 0)
    out = mixing.mixed_documents(df, weights=(1, 3), preference=F.when(F.col("good"), 4.0).otherwise(1.0)).groupBy("source").agg(
        F.avg(F.col("good").cast("int")).alias("good"), F.sum(F.size(F.split(F.trim("text"), " "))).alias("words"))
    got, total = {r.source: r for r in out.collect()}, sum(1 + k % 7 for k in range(2000))
    assert abs(got["a"].words - total / 4) < 8 and abs(got["b"].words - 3 * total / 4) < 8
    assert 0.4 < got["a"].good < 0.6 and got["b"].good > 0.3  # of 1 in 5 documents


def test_rows_alike_are_decided_together_and_no_documents_give_none(spark):
    same = [(9, "w w w", "a")] * 40 + [(k, "w " * 10, "b") for k in range(10, 30)]
    got = mixing.mix_shares(sourced(spark, same)).collect()
    assert len(got) == 60 and len({r.taken for r in got if r.doc_id == 9}) == 1
    assert mixing.mix_shares(sourced(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix_shares(sourced(spark, [(1, None, None), (2, "", "a")])).collect()} == {0}


# 13 fill in the middle


def plain_fim(rows):
    out = []
    for key, text in rows:
        t = text or ""
        h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        lo, hi = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((key, len(t), "plain", None, None, plain.sha(t), plain.sha(t)))
            continue
        p, m, s = t[:lo], t[lo:hi], t[hi:]
        form = "spm" if h4 % 100 < 20 else "psm"
        made = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        out.append((key, len(t), form, lo, hi - lo, plain.sha(made), plain.sha(t)))
    return out


def test_fim_matches_the_plain_version(frame, corpus):
    rows = corpus(150, 31) + [(200 + k, t) for k, t in enumerate(ODD)] + [(300, "a<P>b"), (301, "<S"), (302, "M><P"), (303, "🙂" * 700), (304, "x" * 128), (305, "xy" * 64 + "\n"), (306, "<" * 500)]
    rows += [(310 + k, "ab\r\n é" * k) for k in range(40)] + [rows[40], rows[40], (None, "no id at all"), (None, "no id at all"), (None, "other")]
    got = fim.fim_digests(frame(rows))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_fim(rows)))


def test_fim_of_very_long_texts_and_of_nothing(frame):
    rows = [(k, "".join(chr(97 + (k * i * i) % 26) for i in range(150_000))) for k in range(3, 7)] + [(8, "é\n" * 200_000)]
    assert sorted(map(str, map(tuple, fim.fim_digests(frame(rows)).collect()))) == sorted(map(str, plain_fim(rows)))
    assert fim.fim_digests(frame([])).count() == 0


@pytest.mark.parametrize("run", [1, 3, 128])
def test_fim_cuts_between_other_units(frame, run):
    rows = [(k, " ".join(f"w{j}" for j in range(k)) + "  é" * (k % 3)) for k in range(60)]
    unit = r"\S+"
    for r in fim.fill_in_middle(frame(rows), unit=unit, run=run).collect():
        text = rows[r.doc_id][1]
        units = re.findall(r"\S+|.", text, re.S)
        h = hashlib.sha256(f"1:{r.doc_id}".encode()).hexdigest()
        lo, hi = sorted(int(h[8 * k : 8 * k + 8], 16) % (len(units) + 1) for k in (0, 1))
        assert r.n == len(units)
        if r.form != "plain":
            p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
            assert r.output == (f"<S>{s}<P>{p}<M>{m}" if r.form == "spm" else f"<P>{p}<S>{s}<M>{m}") and (r.prefix_chars, r.middle_chars) == (len(p), len(m))

"""Each operator against its plain version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib

import plain
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellis.llm import bpe, chat, decontamination, html, jaccard, linededup, quality, repeats, sharding, warc


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# 1 sharding


def test_lookup_table_is_full_even_and_stable():
    names = sharding.shard_names(10)
    table = sharding.fill(names, 1009)
    loads = [table.count(k) for k in range(10)]
    assert sum(loads) == 1009 and max(loads) - min(loads) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.2 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 8)


def test_every_row_gets_its_shard_and_hot_keys_are_spread(spark, frame):
    df = frame([(k, "t") for k in range(50)] + [(7, "t")] * 3 + [(None, "n")])
    got = sharding.assign_shards(df, "doc_id", sharding.shard_names(4), 101)
    assert got.count() == 54 and got.columns[:-2] == df.columns and got.columns[-2:] == ["_slot", "_shard"]
    owner = sharding.fill(sharding.shard_names(4), 101)
    for r in got.select("doc_id", "_slot", "_shard").collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r._slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r._shard == owner[r._slot]
    hot = spark.range(3000).selectExpr("1L AS doc_id", "id AS n")
    spread = sharding.assign_shards(hot, "doc_id", sharding.shard_names(8), 1009, spread_by=["n"], hot_rows=100)
    assert spread.count() == 3000 and spread.select("shard").distinct().count() > 4
    assert sharding.assign_shards(df.limit(0), "doc_id", sharding.shard_names(4), 101).count() == 0


# 2 chat formatting


def test_every_side_of_a_dialogue(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "x"), (3, 70, "bob", "y"), (None, 0, "ann", "lost"), (None, 0, "ann", "gone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS side")
    got = {(r.conv_id, r.side, r.text): r for r in chat.rotate_perspectives(df).collect()}
    text = "<|system|>\nS<|end|>\n<|assistant|>\nHi<|end|>\n<|user:bob|>\nYo<|end|>\n<|assistant|>\n<|end|>\n"
    row = got[1, "ann", text]
    assert (row.n_turns, row.n_own) == (4, 2)
    spans = [tuple(map(int, s.split(":"))) for s in row.mask.split(",")]
    assert [text[a:b] for a, b in spans] == ["Hi<|end|>\n", "<|end|>\n"]
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (3, "unknown"), (3, "bob"), (None, "ann")}
    assert len([k for k in got if k[0] is None]) == 2 and len([k for k in got if k[0] == 3]) == 2
    assert got[3, "bob", "<|assistant|>\ny<|end|>\n<|user:unknown|>\nx<|end|>\n"].mask == "14:23"
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_a_long_dialogue_is_one_row_a_side(spark):
    for n in (65, 1000):
        turns = [(7, k, "ab"[k % 2], f"t{k}") for k in range(n)] + [(7, None, "a", "late"), (7, None, "b", "late")]
        got = {r.side: r for r in chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
        assert set(got) == {"a", "b"}
        for side, row in got.items():
            own = [f"t{k}<|end|>\n" for k in range(n) if "ab"[k % 2] == side] + ["late<|end|>\n"]
            spans = [tuple(map(int, s.split(":"))) for s in row.mask.split(",")]
            assert [row.text[a:b] for a, b in spans] == own and (row.n_turns, row.n_own) == (n + 2, len(own))


def test_repeated_turns_and_very_long_ones_all_show(spark):
    turns = [(1, 1, "ann", "Hi")] * 3 + [(1, 2, "bob", "x" * 300_000), (1, 3, "bob", ""), (1, 3, "ann", "")]
    got = chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {r.side for r in got} == {"ann", "bob"} and all(r.n_turns == 6 for r in got)
    for r in got:
        assert r.n_own == (4 if r.side == "ann" else 2) and r.text.count("Hi<|end|>") == 3 and "x" * 300_000 in r.text


# 3 quality rules


def test_quality_matches_the_plain_version(spark, frame, corpus):
    rows = corpus(150, 3) + [(900, "a b c " * 40), (901, "x\n\nx\n \n" + "w%d " * 60), (7, "same id again " * 30), (None, "no id " + "q w e r t " * 20)]
    good = set(range(6, 60))
    labels = spark.createDataFrame([(k, 1) for k in good] + [(6, 1), (70, 0), (71, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_rules(frame(rows), labels)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    want = plain.quality(rows, good, quality.BUCKETS, quality.PRIOR, quality.THRESHOLD)
    rounded = lambda rs: sorted(((*r[:7], round(r[7], 9), r[8]) for r in rs), key=str)
    assert rounded(rows_of(got, *columns)) == rounded(want)
    kept = quality.keep_good(frame(rows), labels)
    assert kept.columns == frame(rows).columns and kept.count() == sum(r[8] for r in want)


def test_quality_of_very_long_texts(spark, frame):
    rows = [(1, " ".join(f"w{k % 7919}x{k % 31}" for k in range(60_000))), (2, "a b c " * 20_000), (3, "x" * 300_000), (3, "x" * 300_000)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = rows_of(quality.quality_rules(frame(rows), labels), *columns)
    assert got == sorted((r[:7] for r in plain.quality(rows, {1}, quality.BUCKETS, quality.PRIOR, quality.THRESHOLD)), key=str)


def test_quality_without_labels_or_documents(spark, frame, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_rules(frame(corpus(30)), none).collect()
    assert len(got) == 30 and all(abs(r.score) < 1e-9 and r.kept != r.base_failed for r in got)
    assert quality.quality_rules(frame([]), none).count() == 0


# 4 repeated strings


def test_repeats_match_the_plain_version(frame, corpus):
    rows = corpus(60, 4) + [(200, "a" * 1500), (201, "ab" * 900), (202, "a" * 399), (203, "é" * 200), (204, "xé" * 300), (None, "ab" * 450)]
    rows += [(5, rows[5][1]), (5, rows[5][1])]
    got = repeats.repeat_digests(frame(rows))
    want = [(key, *x) for (key, _), x in zip(rows, plain.repeats([t for _, t in rows]), strict=True)]
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert repeats.repeat_digests(frame([])).count() == 0


def test_repeats_in_texts_longer_than_a_part(frame, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 1 << 10)
    rows = corpus(40, 5)
    rows.append((300, " ".join(t or "" for _, t in rows)))
    texts = [t for _, t in rows]
    found = {}
    for data, ends, numbers, firsts in repeats._chunks(texts):
        out = repeats._anchors(data, ends)
        document = (out["at"][:, None] >= ends[None, :]).sum(axis=1)
        for lo, hi, d in zip(out["lo"], out["hi"], document, strict=True):
            move = firsts[d] - ([0, *ends[:-1]][d])
            found.setdefault(numbers[d], []).extend(range(lo + move, hi + move + 1))
    want = {k: list(range(len((t or "").encode()) - 399)) for k, t in enumerate(texts) if len((t or "").encode()) >= 400}
    assert {k: sorted(v) for k, v in found.items()} == want


def test_repeats_within_and_between_very_long_texts(frame):
    """Passages at known places of random texts that are cut into parts, one of them across a part's border; those in the first text share the signs around them too."""
    import random

    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    text = lambda n: "".join(r.choices(letters, k=n))
    passage, short, base = text(1000), text(399), [text(1_300_000), text(50_000), text(700)]
    at = [300_000, 2 * repeats._CHUNK - 500, 1_200_000]
    for k in sorted(at, reverse=True):
        base[0] = base[0][:k] + "#" + passage + "%" + base[0][k:]
    base[1] = base[1][:100] + "@" + passage + "~" + short + "^" + base[1][100:]
    base[2] = base[2] + "=" + short + "!"
    got = {x.doc_id: x for x in repeats.repeat_digests(frame(list(enumerate(base)))).collect()}
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans) for k in range(3)] == [(len(base[0]), 3006, 3), (len(base[1]), 1000, 1), (len(base[2]), 0, 0)]
    assert got[0].kept_sha256 == plain.sha(base[0].replace(f"#{passage}%", "")) and got[1].kept_sha256 == plain.sha(base[1].replace(passage, ""))


# 5 HTML extraction

PAGE = "<html><head><title>T</title></head><body><nav><a>Home</a></nav>{}<article><h1>Head &amp; &eacute;</h1><p>One\n two<b> three</b><br>four<p>{}<div class='share'>Share</div></article><div class='ad'>Buy</div><section id=comments><p>First!</p></section><footer>F</footer></body></html>"


def test_article_text_without_what_surrounds_it():
    assert html.Page(PAGE.format("<form>Sign up<input></form>", "Body <i>x</i>")).text() == "Head & é\nOne two three four\nBody x"
    assert html.Page("").text() == "" and html.Page("just text").text() == "just text"
    assert html.Page("<p>a<p>b<ul><li>c<li>d</ul><script>var x='</p>';</script><!-- no -->e").text() == "a\nb\nc\nd\ne"
    assert html.Page("<div>" * 5000 + "deep" + "</div>" * 5000).text() == "deep"
    assert html.Page("<body><header>H</header><main><p>M</p></main><aside>A</aside>").text() == "M"
    assert html.Page('<p title="a > b">q</p><table><tr><td>1<td>2<tr><td>3</table>').text() == "q\n1\n2\n3"


def test_templates_go_and_shared_sentences_stay(spark):
    box = "<div class=x1><div>Brand</div> tagline</div>"
    pages = [(k, f"http://a.example/{k}", f"<body>{box}<div><p>Same sentence.</p><p>own {k}</p></div></body>") for k in range(8)]
    pages += [(90, "http://b.example/", f"<body>{box}<p>only here</p>"), (91, None, None), (92, "not a url", "<p>t"), (92, "not a url", "<p>t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS template", "3 AS text")
    got = {(r.page_id, r.text, r.n_chars) for r in html.extract_text(df).collect()}
    want = {(k, f"Same sentence.\nown {k}", 20) for k in range(8)} | {(90, "Brand\ntagline\nonly here", 23), (91, "", 0), (92, "t", 1)}
    assert got == want and html.extract_text(df).count() == 12 and html.extract_text(df.limit(0)).count() == 0


def test_class_names_take_no_text_by_chance():
    text = lambda body: html.main_text(body)[0]
    assert text('<div class="layout has-sidebar"><p>Real article text.</p></div>') == "Real article text."
    assert text('<p>a</p><div class="share-price"><p>12.5</p></div>') == "a\n12.5"
    assert text('<div class="widget"><h1>T</h1><p>a</p></div><div class="cookie-banner">We use cookies</div>') == "T\na"
    assert text('<div class="sidebar"><p>all there is</p></div>') == "all there is"
    assert text('<p>a</p><div id="siteFooter">F</div><div class="reader comments"><p>First!</p></div><ul class="nav-links main"><li>x</ul>') == "a"
    assert text('<article class="comment"><p>c</p></article><p>a</p>') == "a"


def test_templates_match_counts_by_brute_force(spark):
    """Well-formed pages of <div> and <p>, counted and cut with a tree parser."""
    import random
    from collections import Counter
    from xml.etree import ElementTree

    r, pages = random.Random(3), []
    boxes = [f"<div><p>box {k}</p><div>part {k % 3}</div></div>" for k in range(12)]
    for k in range(40):
        host = r.choice("ab")
        own = "".join(f"<p>own {k} {j} " + "long text " * 9 + "</p>" for j in range(3))
        chosen = [boxes[min(int(r.expovariate(0.4)), 11)] for _ in range(3)]
        pages.append((k, f"http://{host}/{k}", f"<body><div>{''.join(chosen[:2])}</div>{own}{chosen[2]}</body>"))
    pages += [(100 + k, f"http://a/x{k}", pages[0][2].replace("http", "")) for k in range(9)]  # copies count once
    whole = lambda e: ElementTree.tostring(e, encoding="unicode")
    counts = Counter((url.split("/")[2], key) for url, html_text in {(u.split("/")[2].join(("//", "/")), h) for _, u, h in pages} for key in {whole(e) for e in ElementTree.fromstring(html_text).iter("div")})

    def cut(element, host):
        out = [element.text.strip()] if element.text and element.text.strip() else []
        for child in element:
            if child.tag == "p" or counts[host, whole(child)] < html.MIN_PAGES:
                out += cut(child, host)
        return out

    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html.extract_text(df).collect()}
    assert got == {k: "\n".join(cut(ElementTree.fromstring(h), u.split("/")[2])) for k, u, h in pages}
    assert max(counts.values()) >= 5 and len({len(t) for t in got.values()}) > 3


def test_menus_whose_text_varies_go_by_their_shape(spark):
    menu = lambda k: "<div class=m>" + "".join(f"<div><a href=/{j}>entry {k} {j}</a></div>" for j in range(k % 4 + 1)) + "</div>"
    pages = [(k, f"http://a/{k}", f"<body>{menu(k)}<div class=t>prose of its own, number {k}</div></body>") for k in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {(x.page_id, x.text) for x in html.extract_text(df).collect()} == {(k, f"prose of its own, number {k}") for k in range(9)}
    assert {x.text.count("entry") for x in html.extract_text(df.limit(4)).collect()} == {1, 2, 3, 4}


def test_malformed_and_very_long_pages_take_one_pass(frame, spark):
    import time

    for piece in ("<a ", '<a "', "<a '", "<!x ", "</script ", "<script></script ", "<p>x<b ", "< ", "&amp;<"):
        began = time.time()
        html.Page(piece * 200_000)
        html.Page("<p>a</p> > " + piece * 200_000)
        assert time.time() - began < 60, piece
    assert html.Page("<p>a <b> c</b> <a b").text() == "a c <a b" and html.Page("<p>a<!-- b <i>c</i> d").text() == "a" and html.Page("<p>a<![CDATA[b <i> c").text() == "ab <i> c"
    assert html.Page("<p>a<!--> b --> c").text() == "a c" and html.Page("<p>a <script>x</script y").text() == "a"


# 6 decontamination


def test_leaks_match_the_plain_version(spark, frame, corpus):
    rows = corpus(120, 6) + [(None, "no id"), (3, "one two")]
    texts = [t for _, t in rows if t]
    items = [(k, " ".join(texts[k * 7 % len(texts)].split(" ")[3 : 3 + 6 + k])) for k in range(30)] + [(80, None), (81, ""), (82, "ONE two"), (83, texts[20]), (83, texts[20]), (None, texts[21])]
    tests = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS h", "3 AS shingles")
    got = decontamination.leaks(frame(rows), tests)
    assert rows_of(got, "doc_id", "item_id", "n_item", "n_shared") == plain.leaks(rows, items)
    clean = decontamination.without_leaks(frame(rows), tests)
    bad = {r[0] for r in plain.leaks(rows, items)}
    assert clean.columns == frame(rows).columns and {r.doc_id for r in clean.collect()} == {k for k, _ in rows} - bad


def test_no_items_or_no_documents_leak_nothing(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(frame([(1, "a b c d e f")]), none).count() == 0 and decontamination.leaks(frame([]), none).count() == 0


def test_short_items_are_found_in_a_very_long_text(spark, frame):
    """Every item lies somewhere in one text of 60,000 words, with up to a fifth of its shingles broken; blocks must not lose it."""
    import random

    r = random.Random(8)
    words, items = [f"w{r.randrange(9000)}" for _ in range(60_000)], []
    for k in range(300):
        n = r.randint(5, 90)
        item = [f"i{k}x{j}" for j in range(n)]
        items.append((k, " ".join(item)))
        if r.random() < 0.5 and n > 40:
            item[n // 2] = "other"  # breaks five of n - 4 shingles
        at = r.randrange(len(words))
        words[at:at] = item
    rows = [(1, " ".join(words)), (2, items[7][1] + " and more"), (2, items[7][1] + " and more")]
    got = rows_of(decontamination.leaks(frame(rows), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "n_item", "n_shared")
    want = plain.leaks(rows, items)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and (2, 7) in {x[:2] for x in got}


# 7 byte-level BPE


@pytest.fixture(scope="module")
def codec():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(open(path, "rb").read())
    return bpe.TextEncoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdehrstin 'éü\n\t  　 .,!10🙂ا", max_size=120)))
def test_ids_are_those_of_the_library(codec, text):
    import numpy as np

    encoder, library = codec
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    decoder = bpe.StreamDecoder(encoder.transducer.tokens)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed((), last=True) == text


def test_long_pieces_and_small_tables(codec):
    import numpy as np

    encoder, library = codec
    small = bpe.TextEncoder(encoder.transducer.ranks, public_tokenizers.PATTERN, max_kept=5)
    small.transducer.max_states = 20
    for text in ("ab" * 3000, "the" + "n" * 5000 + "tion", "é" * 700, "x" * 10 + "0" * 3000, " ".join(f"w{k}ord" for k in range(300))):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_digests_and_round_trip_of_a_table(frame, codec):
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (4, "x" * 20_000), (1, "Hello  wörld"), (None, "a b")]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.token_digests(frame(rows), path, public_tokenizers.PATTERN)
    _, library = codec
    pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    want = [(k, len(ids := library.encode_ordinary(t or "")), plain.sha(pack(ids)), plain.sha(t or "")) for k, t in rows]
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(frame(rows), path, public_tokenizers.PATTERN), path)
    assert rows_of(back, "doc_id", "text") == sorted(((k, t or "") for k, t in rows), key=str)
    assert bpe.token_digests(frame([]), path, public_tokenizers.PATTERN).count() == 0


# 8 WARC


def test_archives_come_back_as_they_were_written(spark):
    pages = [(3, "http://a/é ü\r\nX: y", "same"), (1, "http://b/", "same"), (2, None, None), (4, "http://c/", ""), (5, "http://d/", "x" * 300_000), (None, "http://e/", "same"), (6, "u", "own"), (6, "u", "own")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS sha1", "2 AS payload")
    got = warc.archive_round_trip(df).collect()
    seen = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in got), key=str)
    first = {"same": 1, "": 2, "x" * 300_000: 5, "own": 6}
    want = []
    for key, _, text in pages:
        data = text or ""
        alone = key == first[data]
        want.append((key, len(data), warc.base32_sha1(data.encode()), "response" if alone else "revisit", None if alone else first[data], None))
    assert seen == sorted(want, key=str)
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    marked = warc.marked_revisits(df, least_bytes=4)
    assert marked.filter("html = '' AND revisit").count() == 0


def test_reader_checks_what_it_reads(spark):
    record = warc._record(1, "http://a/", b"payload", None, False)
    for bad in (record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"payload\r", b"Payload\r"), record[:-2], record.replace(b"Content-Length: ", b"Content-Size: ")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    import struct

    import zstandard

    made = zstandard.ZstdCompressor(write_checksum=True)
    dictionary = b"WARC-Target-URI: http://" * 40
    with_dict = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    lead = struct.pack("<II", warc.DICT_MAGIC, len(dictionary)) + dictionary
    archives = [("plain", made.compress(record) + made.compress(record[:-2])), ("dict", lead + with_dict.compress(record)), ("cut", made.compress(record)[:-3]), ("junk", b"no archive"), ("empty", b"")]
    got = warc.read_archives(spark.createDataFrame([(p, bytearray(c)) for p, c in archives], "path string, content binary")).collect()
    assert sorted(r.page_id for r in got if r.error is None) == [1, 1] and sum(r.error is not None for r in got) == 3
    assert bytes(next(r.payload for r in got if r.error is None)) == b"payload"


# 9 Jaccard join


@pytest.mark.parametrize("seed, small", [(7, 32), (8, 2)])
def test_components_match_the_plain_version(frame, corpus, monkeypatch, seed, small):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", small)
    rows = corpus(160, seed)
    base = rows[5][1].split(" ")[:200]
    for k in range(40):  # near copies of one text, most of them further from each other than the limit
        w = list(base)
        for j in range(k % 9):
            w[(k * 37 + j * 23) % 200] = f"new{k}x{j}"
        rows.append((500 + k, " ".join(w)))
    got = jaccard.near_duplicates(frame(rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(plain.near(rows), key=str)
    if small == 2:
        return
    kept = jaccard.keep_one(frame(rows))
    assert kept.columns == frame(rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _, c in plain.near(rows) if k == c)


def test_jaccard_of_repeated_rows_null_ids_and_nothing(frame):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (1, "other words are here now"), (None, None), (2, None)]
    got = rows_of(jaccard.near_duplicates(frame(rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (1, 1, 1), (None, 0, None), (2, 0, 2)], key=str)
    assert jaccard.near_duplicates(frame([])).count() == 0


def test_signatures_meet_for_every_pair_within_the_limit():
    import numpy as np

    from tessellis.llm.partenum import signatures

    r = np.random.default_rng(5)
    for size in (5, 9, 14, 27, 41, 60, 95, 180, 400):
        for _ in range(40):
            shared = r.integers(0, 1 << 62, size, dtype=np.uint64)
            diff = int(r.integers(0, size // 4 + 1))
            one = int(r.integers(0, diff + 1))
            a = np.unique(np.append(shared, r.integers(0, 1 << 62, one, dtype=np.uint64)))
            b = np.unique(np.append(shared, r.integers(0, 1 << 62, diff - one, dtype=np.uint64)))
            if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) and diff:
                for common in (np.empty(0, np.uint64), np.sort(shared), np.sort(shared[: size // 2])):
                    assert np.intersect1d(signatures(a, common), signatures(b, common)).size


# 10 line dedup


def test_lines_match_the_plain_version(frame, corpus):
    rows = corpus(120, 10)
    rows += [(400 + k, f"  This line is LONG enough {k // 30}\t\nshort\nanother line of enough length\n") for k in range(70)] + [(401, "this line is long enough 0\nthis line is long enough 0"), (None, "another line of enough length"), (None, None)]
    got = linededup.line_digests(frame(rows))
    want = [(k, n, d, plain.sha(t)) for k, n, d, t in plain.line_dedup(rows)]
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=str)
    out = linededup.dedup_lines(frame(rows))
    assert out.columns == frame(rows).columns and rows_of(out, "doc_id", "text") == sorted(((k, t) for k, _, _, t in plain.line_dedup(rows)), key=str)
    assert linededup.line_digests(frame([])).count() == 0
    named = linededup.line_digests(frame(rows, extra=False).selectExpr("lpad(CAST(doc_id AS STRING), 6, '0') AS doc_id", "text").filter("doc_id IS NOT NULL"))
    assert sorted(r.kept_sha256 for r in named.collect()) == sorted(plain.sha(t) for k, _, _, t in plain.line_dedup([r for r in rows if r[0] is not None]))


def test_runs_are_compacted_and_settled_lines_not_taken_again(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for ids in ((9, 8, 7), (6,), (5, 4), (3,)):
        runs.add(spark.createDataFrame([(1, 1, i) for i in ids] + [(2, 2, ids[0])], "h1 long, h2 long, doc_id long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    # line 1 is settled after the first batch; line 2 is in the batches of 9, 6 and 5, then settled, so that of 3 is not taken in
    assert rows_of(runs.lines(), "h1", "n_docs", "top_doc") == [(1, 3, 9), (2, 3, 9)]

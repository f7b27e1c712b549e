"""The per-row operators: extraction, licences, tokens, TIFF; and the WARC round trip."""

import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linefold.llm import html_extract as H
from linefold.llm import license_scan as L
from linefold.llm import tiff_media as T
from linefold.llm import token_count as K
from linefold.llm import warc as W

LOREM = "the quick brown fox of the forest jumps over the lazy dog and then it is gone to the hills "


def test_article_is_kept_and_the_rest_goes():
    page = (
        "<html><head><title>x</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>A</a></li></ul></nav><!-- ad --><div class=ad>Buy</div>"
        "<header>Top</header><article><header><h1>T &amp; U</h1></header><p>One<br>two\n  three<p><b>bold <i>in</i>side</b>.</p><form>f</form><aside>s</aside>"
        "<section class='comments'><p>nice post</p></section></article><div id=cookie-notice>ok?</div><footer>&copy; me</footer></body></html>"
    )
    assert H.extract_text(page) == "T & U One two three bold inside ."[:-2] + "."


def test_rules_without_article():
    long = (LOREM * 4).strip()
    page = f"<body><div><a href=/x>Home</a> <a href=/y>News</a></div><h2>Head</h2><p>{long}</p><p>short</p><p>{long}</p><div>tiny</div><div><a href=/z>All the links</a></div></body>"
    assert H.extract_text(page) == f"Head {long} short {long}"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "a<b", "<!--", "<script>x", "</p></div>", "<p>&#0;&bogus;&amp", "<![CDATA[x", "<a href='>"])
def test_odd_pages_do_not_raise(page):
    assert isinstance(H.extract_text(page), str)


def test_pages_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in H.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    import html

    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def brute_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "License", "apache", "general", "public", "é", "x", ",", "\n"]), max_size=30))
def test_licence_base_against_brute_force(words):
    text = " ".join(words)
    f = L.scan_text(text)
    assert (f["n_words"], f["n_base"], f["first_word"], f["last_word"], f["base_labels"]) == brute_licence(text)


def test_licence_fuzzy_finds_edited_notices():
    assert L.scan_text("x y. Licensd under CC BY-NC 4.0.")["labels"] == "cc-by-nc"
    f = L.scan_text("a b Permission is hereby granted, free of charge, to any persons obtaining a copy c")
    assert f["labels"] == "mit" and f["base_labels"] == "" and 0 < f["score"] < 1 and f["spans"][0]["first_word"] == 2
    assert L.scan_text(None)["n_words"] == 0 and L.scan_text("plain words only")["labels"] == ""


def test_fuzzy_against_brute_force():
    import regex

    notice = "gnu lesser general public license"
    k = L.edits_for(notice, 0.08)
    for t in ("the gnu leser general public licence now", "gnu lesser general publc license", "gnu general public license"):
        want = bool(regex.search(rf"(?<![^ ])(?:{notice}){{e<={k}}}(?![^ ])", t))
        assert ("lgpl" in {x[0] for x in L.fuzzy_spans(t)}) == want


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab c\n\t.,1é  '<|>endoftext", max_size=60) | st.just("<|endoftext|> a <|endoftext|>"))
def test_split_keeps_token_counts(text):
    import public_tokenizers as P

    encode = K.load(str(P.path("byte_bpe_50k.json")))
    assert K.count_texts([text], encode, {}) == encode([text])
    assert "".join(K.split_safe(text)) == text


def test_which_tokenizers_split_safely(spark):
    import public_tokenizers as P

    assert [K.splits_safely(str(P.path(n))) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")] == [True, False, False]
    docs = spark.createDataFrame([(1, "Two  words <|endoftext|> é"), (2, None)], "doc_id bigint, text string")
    for n in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        got = {r.doc_id: r.n_tokens for r in K.count(docs, n).collect()}
        assert got == {1: K.load(str(P.path(n)))(["Two  words <|endoftext|> é"])[0], 2: K.load(str(P.path(n)))([""])[0]}


def test_tokens_of_the_table(spark, sf):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in docs.join(K.count(docs, "byte_bpe_50k.json"), "doc_id").collect():
        assert r.n_tokens == len(t.encode(r.text, add_special_tokens=False).ids) and r.n_bytes == len(r.text.encode())


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=700), st.sampled_from([T.NONE, T.LZW, T.PACKBITS, T.DEFLATE]), st.sampled_from([1, 2]), st.sampled_from([0, 16, 48]))
def test_tiff_round_trip(data, compression, predictor, tile):
    data = T.pad(data, 36)
    img = np.frombuffer(data, np.uint8).reshape(-1, 12, 3)
    pages = [img, img[::-1]]
    back = list(T.read_pages(T.write_tiff(pages, compression, predictor, 5, tile)))
    assert len(back) == 2 and all((a == b).all() for a, b in zip(back, pages, strict=True))


def test_lzw_long_and_packbits():
    data = np.random.default_rng(1).integers(0, 7, 60_000, dtype=np.uint8).tobytes() + bytes(3000)
    assert T.lzw_decode(T.lzw_encode(data)) == data and T.packbits_decode(T.packbits_encode(data)) == data


def test_codecs_on_published_examples():
    """LZW: 7 7 7 8 8 7 7 6 6 is written as Clear 7 258 8 8 258 6 6 End, nine bits each; PackBits: a run, a literal, a run."""
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    want = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert T.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == want and T.lzw_decode(want) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa")
    plain = bytes.fromhex("aa aa aa 80 00 2a aa aa aa aa 80 00 2a 22" + "aa" * 10)
    assert T.packbits_decode(packed) == plain and T.packbits_encode(plain) == packed


def slow_lzw(data):
    """A plain LZW decoder over a string of bits, with the width from the table's size."""
    bits = "".join(f"{b:08b}" for b in data)
    table, out, at, prev = {}, b"", 0, None
    while True:
        size = 258 + len(table)
        width = next(w for w in (9, 10, 11, 12) if size + (prev is not None) < (1 << w) or w == 12)
        code = int(bits[at : at + width], 2)
        at += width
        if code == 257:
            return out
        if code == 256:
            table, prev = {}, None
            continue
        entry = bytes((code,)) if code < 256 else table.get(code) or prev + prev[:1]
        if prev is not None:
            table[size] = prev + entry[:1]
        out, prev = out + entry, entry


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 9000), st.integers(1, 256))
def test_codecs_against_plain_decoders(seed, n, kinds):
    data = np.random.default_rng(seed).integers(0, kinds, n, dtype=np.uint8).repeat(1 + seed % 3).tobytes()
    assert slow_lzw(T.lzw_encode(data)) == data == T.lzw_decode(T.lzw_encode(data)) == T.packbits_decode(T.packbits_encode(data))


def test_every_packing_has_a_fair_share(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = [0] * 4
    for r in T.media_column(docs).collect():
        tags = next(T.directories(bytes(r.media)))
        n[{T.LZW: 0, T.PACKBITS: 1}.get(tags[259][0], 2 + (324 in tags))] += 1
    assert min(n) > 0.12 * sum(n)


def test_a_file_by_hand():
    """Little endian, one strip of 2 x 2 grey samples, no compression; then big endian, RGB, PackBits and two strips."""
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, 4)]
    entry = lambda e: b"".join(t.to_bytes(2, e) + k.to_bytes(2, e) + (1).to_bytes(4, e) + (v.to_bytes(2, e) + b"\0\0" if k == 3 else v.to_bytes(4, e)) for t, k, v in tags)
    small = b"II*\0" + (12).to_bytes(4, "little") + bytes([1, 2, 3, 4]) + len(tags).to_bytes(2, "little") + entry("little") + bytes(4)
    assert [p.ravel().tolist() for p in T.read_pages(small)] == [[1, 2, 3, 4]]
    strips = [bytes([0xFB, 7]), bytes([5, 1, 2, 3, 4, 5, 6])]  # six sevens; six bytes as they are
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 32773), (262, 3, 2), (277, 3, 3), (278, 3, 1)]
    lists = b"".join(t.to_bytes(2, "big") + (4).to_bytes(2, "big") + (2).to_bytes(4, "big") + at.to_bytes(4, "big") for t, at in ((273, 17), (279, 25)))
    body = sorted([*[(t, x) for t, x in zip([t for t, *_ in tags], [entry("big")[i : i + 12] for i in range(0, 84, 12)])], (273, lists[:12]), (279, lists[12:])])
    large = b"MM\0*" + (34).to_bytes(4, "big") + strips[0] + strips[1] + (8).to_bytes(4, "big") + (10).to_bytes(4, "big") + (2).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"\0" + len(body).to_bytes(2, "big") + b"".join(x for _, x in body) + bytes(4)
    assert [p.ravel().tolist() for p in T.read_pages(large)] == [[7] * 6 + [1, 2, 3, 4, 5, 6]]


def test_tiff_documents(spark):
    rows = [(1, None), (2, ""), (3, "x" * 192), (4, "é" * 200), (5, "é" * 200), (6, "word " * 300_000)]
    got = {r.doc_id: r for r in T.describe(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        p = T.pad((t or "").encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[6].n_pages > 1


def retag(data, changes):
    """The file with the first value of some tags changed; all values of this size stand in the entry itself."""
    import struct

    data = bytearray(data)
    (at,) = struct.unpack_from("<I", data, 4)
    for i in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, _ = struct.unpack_from("<HHI", data, at + 2 + 12 * i)
        if tag in changes:
            struct.pack_into({3: "<H", 4: "<I"}[kind], data, at + 10 + 12 * i, changes[tag])
    return bytes(data)


def test_tiff_damage_gives_an_error_row(spark):
    img = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    strips, tiles = T.write_tiff([img], T.LZW, 1), T.write_tiff([img], tile=16)
    bad = {
        1: retag(tiles, {322: 0}), 2: retag(strips, {256: 4_000_000_000}), 3: retag(strips, {317: 3}), 4: retag(strips, {278: 0}), 5: strips[:8] + b"\xff" * 6 + strips[14:], 6: strips[:-20], 7: b"II*\0" + b"\xff" * 4,
        8: retag(strips, {259: 7}), 9: b"", 10: retag(tiles, {323: 0}), 11: retag(strips, {277: 0}), 12: T.write_tiff([img])[:8] + b"junk" * 4 + T.write_tiff([img])[24:], 13: retag(strips, {257: 9}), 14: retag(strips, {273: 10**9}),
    }
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in bad.items()] + [(99, bytearray(strips))], "id bigint, data binary")
    got = {r.id: r for r in T.explode_pages(df, "id", "data").collect()}
    assert got[99].error is None and got[99].sha256 == hashlib.sha256(img.tobytes()).hexdigest()
    assert set(got) == {99, *bad} and all(got[i].error and got[i].sha256 is None for i in bad)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_tiff_random_damage_never_crashes(data):
    img = np.arange(192, dtype=np.uint8).reshape(8, 8, 3)
    raw = bytearray(T.write_tiff([img, img], data.draw(st.sampled_from([T.NONE, T.LZW, T.PACKBITS, T.DEFLATE])), data.draw(st.sampled_from([1, 2])), 3, data.draw(st.sampled_from([0, 16]))))
    for _ in range(data.draw(st.integers(1, 4))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    try:
        for p in T.read_pages(bytes(raw), 1 << 20):
            assert p.dtype == np.uint8
    except ValueError:
        pass


def test_tiff_media_column_and_query_agree(spark):
    rows = [(1, None), (2, "ab" * 150), (3, "aaaa" * 160), (4, "word " * 300), (5, "é word " * 4000), (6, "x" * 192 * 4100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    media = {r.doc_id: bytes(r.media) for r in T.media_column(docs).collect()}
    kinds = {i: next(T.directories(m)) for i, m in media.items()}
    for i, t in rows:
        own = T.PACKINGS[zlib.crc32(T.pad((t or "").encode())) % 4]
        assert kinds[i][259][0] == own["compression"] and (324 if own.get("tile") else 273) in kinds[i]
    pages = T.explode_pages(T.media_column(docs), "doc_id", "media").collect()
    assert {(r.id, r.page_no) for r in pages} == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (6, 1)} and not any(r.error for r in pages)
    for r in T.describe(docs).collect():
        payload = T.pad((dict(rows)[r.doc_id] or "").encode())
        x = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(float)
        means = x.sum(axis=(0, 2)) / (x.shape[0] * 3)
        bits = "".join("1" if m > means.mean() else "0" for m in means)
        assert r.feature == f"{int(bits, 2):016x}" and r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() and r.media_bytes == len(media[r.doc_id])


def test_tiff_pages_and_damage(spark):
    img = np.zeros((3, 4, 1), np.uint8)
    df = spark.createDataFrame([(1, bytearray(T.write_tiff([img, img]))), (2, bytearray(b"junk")), (3, None)], "id bigint, data binary")
    got = sorted((r.id, r.page_no, r.error is None) for r in T.explode_pages(df, "id", "data").collect())
    assert got == [(1, 0, True), (1, 1, True), (2, 0, False)]


def test_warc_cases(spark):
    big = "x" * 1500
    rows = [(1, "u1", big, "c"), (2, None, big, "c"), (3, "u3", None, "c"), (4, "u4", "", "c"), (5, "u5", "é" * 3000, "c"), (6, "u6", "small", "c"), (7, "u7", "small", "c"), (None, "u", big, "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha string")
    chunks = W.write_archive(pages, chunk=1000)
    assert chunks.groupBy("record_id").count().agg({"count": "max"}).collect()[0][0] == 6
    got = {r.page_id: r for r in W.read_archive(chunks).collect()}
    assert len(got) == 8
    for i, _, h, _ in rows:
        p = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(p), hashlib.sha1(p).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 6, 7, None)] == [("revisit", 2), ("response", None), ("response", None), ("response", None), ("revisit", 2)]
    # the rows of one record, joined, are the record
    body = gzip.decompress(b"".join(bytes(r.body) for r in chunks.where("page_id = 5").orderBy("chunk_no").collect()))
    assert body.startswith(b"WARC/1.1\r\n") and body.endswith("é".encode() + b"\r\n\r\n")
    head = lambda p: W.parse_header(gzip.decompress(bytes(chunks.where(f"page_id = {p} and chunk_no = 0").collect()[0].body)).split(b"\r\n\r\n")[0])
    assert head(1)["warc-refers-to"] == head(2)["warc-record-id"] and head(1)["warc-record-id"].startswith("<urn:uuid:")


def test_warc_repeated_page_ids_behind_a_shuffle(spark):
    big = "y" * 2000
    pages = spark.createDataFrame([(i % 3, f"u{i}", big) for i in range(40)], "page_id bigint, url string, html string").repartition(4)
    got = W.read_archive(W.write_archive(pages)).collect()
    assert len(got) == 40 and sorted((r.record_type, r.refers_to) for r in got if r.record_type == "response") == [("response", None)]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {2}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert L.scan(docs).count() == K.count(docs, "byte_bpe_50k.json").count() == T.describe(docs).count() == H.extract(pages).count() == 0
    assert W.read_archive(W.write_archive(pages)).count() == 0


@pytest.mark.parametrize(
    "head, tail",
    [
        ("<body class='no-sidebar'>", "</body>"),
        ("<body class='has-search-form'>", "</body>"),
        ("<body><div class='content-sidebar-wrap'>", "</div></body>"),
        ("<body><main class='overflow-hidden'>", "</main></body>"),
        ("<body><form action=/x>", "</form></body>"),
        ("<body><div class='widget'>", "</div></body>"),
    ],
)
@pytest.mark.parametrize("inner", ["<p>{0}</p>", "<article><p>{0}</p></article>"])
def test_wrappers_do_not_hide_the_article(head, tail, inner):
    long = (LOREM * 4).strip()
    page = head + "<nav><a href=/x>Home</a></nav>" + inner.format(long) + "<div class=sidebar-box>Buy</div><footer>me</footer>" + tail
    assert H.extract_text(page) == long


def test_comments_stay_out_beside_an_article():
    long = (LOREM * 4).strip()
    assert H.extract_text(f"<body><div><p>{long}</p></div><div class=comments-area><article class=comment-body><p>{long * 9}</p></article></div></body>") == long


def test_passes_run_inside_and_outside_of_the_article():
    long = (LOREM * 4).strip()
    links = "".join(f"<a href=/{i}>Another story of the week {i}</a> " for i in range(5))
    assert H.extract_text(f"<main><h1>Head</h1><p>{long}</p><div>{links}</div><p>short</p></main>") == f"Head {long} short"
    story = f"<div><p>{long}</p></div><div>tiny</div>"
    assert long in H.extract_text(f"<body>{story}<article><h2>Card</h2><p>A card.</p></article></body>")
    assert H.extract_text(f"<body><div>tiny</div><article><p>{long}</p></article><div>by line</div></body>") == long


STORY = "The story of the day is that it was told to all of us by the old man in the house, and we heard it with care and with some doubt."


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p><a name=top>{s}</p><p>{s}</p>", "{s} {s}"),  # an anchor that never closes is no link
        ("<p><a href=/x>Top</p><p>{s}</p>", "{s}"),  # a link ends with its block
        ("<p>{s}</p><button>x<p>{s}</p>", "{s} {s}"),
        ("<p>{s}</p><svg><path d=1><p>{s}</p>", "{s} {s}"),
        ("<article><p>{s}</p><p>Click here</p><p>Buy now!</p><p>So be it.</p><p>{s}</p></article>", "{s} So be it. {s}"),
        ("<p>{s}</p><p>1 <2 and x<y, says {s}</p>", "{s} 1 <2 and x<y, says {s}"),
        ("<p>{s}</p><img alt='a > b'><p>{s}</p><!-- <p>no</p> --><p title=\"it's > that\">{s}</p>", "{s} {s} {s}"),
        ("<article><p>Hi there</p></article>", "Hi there"),
        ("<p>Only a short line.</p>", "Only a short line."),
        ("<nav><a href=/a>A</a></nav><div><a href=/a>One</a> <a href=/b>Two</a></div><h1>Title</h1><p>{s}</p><ul><li><a href=/c>Next story of the day</a></li></ul><p>Copyright</p>", "Title {s}"),
    ],
)
def test_hand_marked_pages(page, want):
    assert H.extract_text(page.format(s=STORY * 2)) == want.format(s=STORY * 2)


def brute_passes(blocks):
    """The two passes outside of an article, block by block, as the docstring words them."""
    first = []
    for b in blocks:
        n, words = len(b["text"]), re.findall(r"[^\W\d_]+", b["text"].lower())
        stops = sum(w in H.STOP_WORDS for w in words) / max(1, len(words))
        if b["boiler"] or b["linked"] / n > 0.5:
            first.append("bad")
        elif n < 70 or stops < 0.10:
            first.append("short" if n < 70 or b["linked"] / n <= 0.2 else "bad")
        else:
            first.append("good" if stops >= 0.25 and n >= 200 else "near")
    if "good" not in first:
        first = ["good" if x == "near" else x for x in first]
    out = []
    for i, x in enumerate(first):
        left = next(((i - j, first[j]) for j in range(i - 1, -1, -1) if first[j] in ("good", "bad")), (10**9, "bad"))
        right = next(((j - i, first[j]) for j in range(i + 1, len(first)) if first[j] in ("good", "bad")), (10**9, "bad"))
        if x in ("good", "bad"):
            out.append(x == "good")
        elif left[1] == right[1]:
            out.append(left[1] == "good")
        elif blocks[i]["tag"] in H.HEADING_TAGS:
            out.append(right[1] == "good")
        elif x == "near":
            out.append(True)
        else:
            out.append(left[0] != right[0] and min(left, right)[1] == "good")
    return out


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from([STORY * 2, STORY, "word " * 30, "tiny", "the end of it", "Zebra crossing qqq"]), st.sampled_from([0, 0, 0.3, 1]), st.sampled_from(["p", "h2", "div"]), st.booleans()).map(
            lambda x: {"text": x[0].strip(), "linked": int(x[1] * len(x[0].strip())), "tag": x[2], "boiler": x[3], "main": False}
        ),
        max_size=9,
    ).filter(lambda bs: any(len(b["text"]) > 100 and not b["boiler"] and not b["linked"] and b["text"].startswith("The") for b in bs))
)
def test_passes_against_brute_force(blocks):
    assert H.classify(blocks) == brute_passes(blocks)


@pytest.mark.parametrize("piece", ["<a ", '<a "<a" ', "<button>", "<svg><p>", "<![CDATA[ >", "<div class=ad>x", "<ul><li>", "</div>", "<span class=ad>", "&amp"])
def test_hostile_pages_take_linear_time(piece):
    import time

    def took(n):
        began = time.process_time()
        H.extract_text(piece * n)
        return time.process_time() - began

    took(100)
    assert took(40_000) < 30 * took(4_000) + 0.5


@pytest.mark.parametrize("kind", ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"])
@pytest.mark.parametrize("version", ["4.0", "3.0"])
def test_each_cc_licence_has_its_own_label(kind, version):
    assert L.scan_text(f"Text licensed under CC {kind.upper()} {version}, all of it")["labels"] == f"cc-{kind}"
    assert L.scan_text(f"Text licnsed under CC {kind} 4.0")["labels"] == f"cc-{kind}"


@pytest.mark.parametrize(
    "name, label",
    [
        ("Attribution", "cc-by"),
        ("Attribution-ShareAlike", "cc-by-sa"),
        ("Attribution Share Alike", "cc-by-sa"),
        ("Attribution-NonCommercial", "cc-by-nc"),
        ("Attribution-Noncommercial-Share Alike", "cc-by-nc-sa"),
        ("Attribution NonCommercial ShareAlike", "cc-by-nc-sa"),
        ("Attribution-NoDerivatives", "cc-by-nd"),
        ("Attribution-No Derivative Works", "cc-by-nd"),
        ("Attribution NonCommercial NoDerivs", "cc-by-nc-nd"),
        ("Attribution-NonCommercial-NoDerivatives", "cc-by-nc-nd"),
        ("Atribution-NonComercial", "cc-by-nc"),
    ],
)
def test_long_cc_names_have_their_own_label(name, label):
    for end in (" 4.0 International License.", "", " is what holds"):
        assert L.scan_text(f"Under the Creative Commons {name}{end}")["labels"] == label


def test_names_that_others_go_on_from():
    assert L.scan_text("lesser general public license")["labels"] == "gpl,lgpl"  # the base phrase stays
    assert L.scan_text("SPDX-License-Identifier: LGPL-2.1")["labels"] == "lgpl"
    assert L.scan_text("SPDX-License-Identifier: CC-BY-NC-4.0")["labels"] == "cc-by-nc"
    assert L.scan_text("Creative Commons Attribution. No warranty is given")["labels"] == "cc-by"
    assert L.scan_text("creative commons attribution no deriverble")["labels"] == ""  # a term that no notice has is not cc-by


def test_notices_give_their_own_label_only():
    for notice, label in L.EVERY:
        f = L.scan_text(f"a {notice} b")
        assert set(f["labels"].split(",")) == {label} | set(filter(None, f["base_labels"].split(",")))
    assert L.scan_text("released under the mpl license")["labels"] == L.scan_text("licensed under the isc license")["labels"] == ""


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([*[n for n, _ in L.NOTICES[:10:3]], "mit license", "some words", "é", "x"]), min_size=1, max_size=12))
def test_word_numbers_against_counting(parts):
    f = L.scan_text(" ".join(parts))
    words = " ".join(parts).split()
    for s in f["spans"]:
        piece = " ".join(words[s["first_word"] : s["end_word"]])
        assert any(p.startswith(piece[:8]) for p in parts) and (s["label"], 0, len(piece), s["edits"]) in L.fuzzy_spans(piece)
    if f["n_base"]:
        assert " ".join(words[f["first_word"] :]).startswith(("mit license", "general public license"))


def test_many_notices_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        L.scan_text(" and ".join(["licensed under cc by sa 4 0"] * n))
        return time.process_time() - began

    took(100)
    assert took(10_000) < 25 * took(1_000) + 0.5


PROSE = "The quick brown fox of the forest jumps over the lazy dog and then it is gone to the hills for the rest of the day."


@pytest.mark.parametrize(
    "body, want",
    [
        ("<p>{P}</p><p>Let <math>x=4</math> hold.</p>", "{P} Let x=4 hold."),
        ("<p>{P}</p><object>else {P}</object>", "{P} else {P}"),
        ("<section class='legal-analysis'><h2>Law</h2><p>{P}</p></section>", "Law {P}"),
        ("<div class='social-history'><p>{P} {P}</p></div><p>{P}</p>", "{P} {P} {P}"),
        ("<p>{P}</p><p><a href=/y>{P}</a></p><p>{P}</p>", "{P} {P} {P}"),
        ("<p>{P}</p><div class='social-share'><a href=/x>Share</a> <a href=/y>Tweet</a></div><p>{P}</p>", "{P} {P}"),
        ("<p>{P}</p><ul class='share-links'><li>Share this on X</li></ul><p>{P}</p>", "{P} {P}"),
        ("<p>{P}</p><div class='post-comments'><p>{P}</p></div>", "{P}"),
        ("<p>{P}</p><ul><li><a href=/1>One more</a></li></ul><div class='cookie-notice'>{P}</div>", "{P} One more"),
    ],
)
def test_parts_of_class_names_are_a_vote_inside_articles(body, want):
    page = f"<body><nav><a href=/>x</a></nav><article>{body}</article><div class='legal-notice'><p>{PROSE}</p></div></body>"
    assert H.extract_text(page.replace("{P}", PROSE)) == want.replace("{P}", PROSE)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 400])
def test_quotes_are_trusted_however_many_are_broken(n):
    """A tag with a bracket in its quotes is one tag, whatever stood before it."""
    page = f"<article><p>{'a <u x=1 <i> of ' * n}{PROSE}</p><p>Of the <q class='>\" b\" href=\"u\"'>day</q> it is the end.</p></article>"
    assert H.extract_text(page).endswith("Of the day it is the end.")


TREES = st.recursive(
    st.lists(st.sampled_from(["one", "two words", "&amp;", "é"]), min_size=1, max_size=2).map(" ".join),
    lambda inner: st.tuples(st.sampled_from(["div", "section", "ul", "b", "i", "blockquote"]), st.lists(inner, max_size=4)),
    max_leaves=25,
)


def plain_blocks(tree):
    """Texts of blocks of a well-formed tree: block elements begin and end a block, inline ones do not."""
    out, line = [], []

    def walk(t):
        if isinstance(t, str):
            line.append(t.replace("&amp;", "&") + " ")
            return
        edge = t[0] not in "bi"
        if edge:
            out.append("".join(line))
            line.clear()
        for x in t[1]:
            walk(x)
        if edge:
            out.append("".join(line))
            line.clear()

    walk(tree)
    return [" ".join(x.split()) for x in [*out, "".join(line)] if x.strip()]


def written(t):
    return f"{t} " if isinstance(t, str) else f"<{t[0]}>{''.join(map(written, t[1]))}</{t[0]}>"


@given(TREES)
def test_blocks_of_random_trees(tree):
    assert [b["text"] for b in H.blocks_of(written(tree))] == plain_blocks(tree)

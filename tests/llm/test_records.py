"""HTML text, WARC archives and packing."""

import base64
import hashlib
import io
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from respondex.llm import html_text, packing, warc
from respondex.llm.shared import table

BODY = "<p>First paragraph of the article, long enough to count as text.</p><p>Second one, about as long as the first, with <a href=x>a link</a> in it.</p><p>Short.</p>"
TEXT = "First paragraph of the article, long enough to count as text.\nSecond one, about as long as the first, with a link in it.\nShort."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=/>Home</a></nav><article>{BODY}</article><footer>Foot</footer></body></html>",
        f"<div class='cookie-notice'>We use cookies on this page, as all do.</div><main>{BODY}<section id=comments><p>A reader says something long about it.</p></section></main>",
        f"<header><h2>Site</h2></header><div class=sidebar><p>Other things to read, a long list of them.</p></div><div id=content>{BODY}</div><form>Mail <input></form>",
        f"<article>{BODY}<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><aside>Related</aside></article>",
        f"<body class='has-sidebar'><div class='page nav-open'><article>{BODY}",
        f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div>{BODY}</div><p class=advert>Buy<p class=ad>Buy more",
        f"<article>{BODY.replace('Short.', ' Sh&#111;rt&period;&nbsp; ')}</article>",
    ],
)
def test_article(page):
    assert html_text.main_text(page) == TEXT


LONG = [f"Sentence number {i} of the article, as long as a paragraph of some news page would be." for i in range(6)]
LONG_BODY = "".join(f"<p>{x}</p>" for x in LONG)


def test_line_blocks_choose_beside_marks():
    cards = "".join(f"<article class=card><h3><a href=/{i}>Card {i}</a></h3></article>" for i in range(3))
    for page in (f"<div>{LONG_BODY}</div>{cards}", f"{cards}<div>{LONG_BODY}</div>", f"{cards}<div>{LONG_BODY}</div>{cards}"):
        assert html_text.main_text(page) == "\n".join(LONG)
    # Text outside that is long by itself stays; short lines and lists of links inside stay.
    inside = "<h1>Head</h1>" + "<p>No.</p>" * 5 + LONG_BODY + "<p><a href=x>Source</a></p>" * 5
    want = ["Head"] + ["No."] * 5 + LONG + ["Source"] * 5
    assert html_text.main_text(f"<p>By me</p><article>{inside}</article><p>Bye</p>") == "\n".join(want)
    assert html_text.main_text(f"<article>{inside}</article><div><p>{LONG[0]}</p></div>") == "\n".join(want + LONG[:1])
    assert html_text.main_text("<main><p><a href=x>One</a><p><a href=y>Two</a></main>") == "One\nTwo"


@pytest.mark.parametrize("wrap", ["class='content with-sidebar'", "class=no-sidebar", "id='has-header'", "class='article-header'", "class='search'", "role=search class=share", "hidden", "id=comments"])
def test_names_never_take_the_article(wrap):
    want = "\n".join(LONG)
    assert html_text.main_text(f"<div {wrap}>{LONG_BODY}</div><div class=share>Send it to all</div>") == want
    assert html_text.main_text(f"<article><section {wrap}>{LONG_BODY}</section></article>") == want


def test_parts_of_names_and_links_cut_nothing():
    part = f"<h1 class='article-header'>{LONG[0]}</h1><section class='related-work'><p>{LONG[1]}</p></section>{LONG_BODY}"
    assert html_text.main_text(f"<article>{part}</article>") == "\n".join(LONG[:2] + LONG)
    assert html_text.main_text(f"<div>{part}</div>") == "\n".join(LONG[:2] + LONG)
    links = "<p>See <a href=x>a long text in a link</a>, <a href=y>another</a>.</p><p><a href=z>More of it</a></p>"
    page = f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div>{LONG_BODY}{links}{LONG_BODY}</div><p><a href=c>Three</a>"
    assert html_text.main_text(page) == "\n".join([*LONG, "See a long text in a link, another.", "More of it", *LONG])
    assert html_text.main_text(f"<div class=ad>{LONG[0]}</div><article><p>Sh is.</p></article>") == "Sh is."
    small = f"<div class='cookie-notice'><p>{LONG[0]}</p></div><div class='box sidebar'><p>{LONG[1]}</p></div>"
    assert html_text.main_text(f"{small}<div>{LONG_BODY}</div>") == "\n".join(LONG)


COMPOUND = "sidebar-left left-sidebar site-footer main-nav comments-area nav-links comment-list user-comments post-comments ad-container top-menu comment-thread ad_slot".split()


@pytest.mark.parametrize("name", COMPOUND)
def test_compound_names(name):
    part = f"<div class='{name}'><p>{LONG[0]}</p><p>{LONG[1]}</p></div>"
    for page in (f"<article>{LONG_BODY}</article>{part}", f"<div>{LONG_BODY}</div>{part}", f"{part}<div class='post main'>{LONG_BODY}</div>", f"<article>{LONG_BODY}{part}</article>"):
        assert html_text.main_text(page) == "\n".join(LONG)


@pytest.mark.parametrize("wrap", ["class=comments", "id=comments", "class='ad-box'", "class='cookie-notice'", "class='main-nav'"])
def test_comments_and_adverts_go_however_long_they_are(wrap):
    part = f"<section {wrap}>{LONG_BODY * 4}</section>"
    for page in (f"<article>{LONG_BODY}{part}</article>", f"<div>{LONG_BODY}</div>{part}", f"<main><p>Short one.</p></main>{part}"):
        assert html_text.main_text(page) == ("Short one." if "Short one" in page else "\n".join(LONG))
    # Names that say with what else a box comes, or that it is a post's header, cut nothing.
    assert html_text.main_text(f"<div class='post-header'><h1>{LONG[0]}</h1></div>{LONG_BODY}") == "\n".join(LONG[:1] + LONG)


def test_short_lines_inside_an_article_stay():
    short = "".join(f"<p>No {i}.</p>" for i in range(8))
    want = "\n".join([*LONG, *[f"No {i}." for i in range(8)], *LONG])
    assert html_text.main_text(f"<div>{LONG_BODY}{short}{LONG_BODY}</div>") == want
    links = "".join(f"<p><a href={i}>Link {i}</a></p>" for i in range(8))
    assert html_text.main_text(f"<div>{LONG_BODY}{links}{LONG_BODY}</div>") == "\n".join(LONG * 2)


@pytest.mark.parametrize("part", ["<script ", "<a b ", "<a b \"", "<a '\">", "<", "</script ", "<div class='", "<!--", "<script>", "a" * 8])
def test_a_megabyte_of_broken_markup(part):
    started = time.perf_counter()
    html_text.main_text("<" + part * (1_000_000 // len(part)))
    html_text.main_text("<p>" + part * (1_000_000 // len(part)) + ">")
    assert time.perf_counter() - started < 10


def test_markup_is_read_as_far_as_it_goes():
    page = f"<p title='a > b'>{LONG[0]}</p><p title=\"never closed>{LONG[1]}</p><SCRIPT x>var a = '<p>';</script ><p>1 < 2 and <3</p><!-- {LONG[2]} --><? x ?><p>{LONG[3]}</p>"
    got = html_text.main_text(page)
    assert got.split("\n") == [LONG[0], LONG[1], "1 < 2 and <3", LONG[3]]


@pytest.mark.parametrize("page", ["", "<", "<<<>>>", "<p", "<!--", "<script>", "</p></p>", "<article></article>", "<nav>x</nav>"])
def test_pages_without_article(page):
    assert html_text.main_text(page).strip("<>p ") == ""


def test_extract_keeps_all_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (3, "v", f"<article>{BODY * 2000}</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert [(r.page_id, r.url) for r in got] == [(x[0], x[1]) for x in rows]
    assert got[0].text == "" and got[3].text == "\n".join([TEXT] * 2000)
    assert html_text.extract(pages.where("false")).count() == 0


def pages(spark):
    rows = [(1, "u", "same"), (2, "u\r\nX: y", "same"), (9, None, "same"), (None, "u", "same"), (4, "u", None),
            (5, "u", ""), (6, "u", "caf\u00e9 \u00df" * 100_000), (7, "u", "own"), (7, "u", "own")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string"), rows


@pytest.mark.parametrize("least", [0, 1, 10**9])
def test_archives_round_trip(spark, least):
    frame, rows = pages(spark)
    got = warc.archived(frame, least_bytes=least).collect()
    groups = defaultdict(list)
    for i, _, text in rows:
        groups[(text or "").encode()].append(i)
    want = []
    for payload, ids in groups.items():
        first = max(i for i in ids if i is not None)
        for i in ids:
            again = len(payload) >= least and len(ids) > 1 and i != first
            name = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            want.append((i, len(payload), name, "revisit" if again else "response", first if again else None))
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert warc.archived(frame.where("false")).count() == 0


def test_reader_is_sequential_and_strict():
    members = [warc.record("response", str(i), "u", b"\r\n\r\n" * i, None) for i in range(50)]
    data = b"".join(members)
    found = list(warc.records(io.BytesIO(data)))
    assert [warc.payload_of(b) for _, b in found] == [b"\r\n\r\n" * i for i in range(50)]
    assert len(zlib.decompress(members[3], 31)) < len(b"".join(zlib.decompress(m, 31) for m in members))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-5])))
    plain = zlib.decompress(members[3], 31)
    for broken in (plain.replace(b"\r\n\r\n\r\n", b"\r\n\r\n\r\nx"), plain.replace(b"200 OK", b"201 OK"), plain[:40]):
        squeeze = zlib.compressobj(1, wbits=31)
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(squeeze.compress(broken) + squeeze.flush())))
    revisit = warc.record("revisit", "2", "u", b"abc", "1")
    ((fields, block),) = warc.records(io.BytesIO(revisit))
    assert fields["warc-refers-to"] == "<urn:respondex:page:1>" and fields["x-payload-length"] == "3"


def full_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    full.encode_special_tokens = True
    return full


def test_words_give_the_same_ids():
    import public_tokenizers
    import pyarrow as pa

    texts = [None, "", "  ", "It's Don'T we'll \u2019s 'super \"'s x", "\u0130stanbul \u03a3\u03a3 e\u0301 \u00e9 \ufb01 \U0001f600 \u0149 \u017f",
             "<|endoftext|> a\x00b\x01c \x1c\u2003x\u00a0y", "#$%*** 123 4.5 _a_ \u00b2\u00bd", "".join(map(chr, range(33, 0x250))),
             " ".join(map(chr, range(33, 0x250))), "x" * 3000, "\u4e2d\u6587 \u0440\u0443\u0441 \u0e20\u0e32"]
    encoder = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    ids, bounds = encoder.texts(pa.array(texts * 2)[len(texts) :])
    full = full_tokenizer()
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == full.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_have_the_ids_of_the_plain_call(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    texts = ["foo <|endoftext|> bar", "foo<|endoftext|>bar's<|startoftext|><|endoftext|>x", "<|startoftext|>", "caf\u00e9<|endoftext|>\U0001f600",
             "e<|endoftext|>\u0301 <|ENDOFTEXT|> <|endoftext|", "a\u2003<|endoftext|>\u2003b <| endoftext |>", "plain words"]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [23435, 49407, 2411]
    ids, bounds = packing.WordEncoder(path, added_tokens=True).texts(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(packing.pack(frame).collect(), {i: x + [2] for i, x in enumerate(want)})


def check_packing(pieces, ids, limits=(4096, 128, 4096), prompt=None):
    docs, bins = defaultdict(list), defaultdict(list)
    for r in pieces:
        own = ids[r.doc_id]
        part = np.array(own[r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(own) and r.length > 0
        docs[r.doc_id].append((r.start, r.length))
        loss = max(r.start + r.length - max(r.start, (prompt or {}).get(r.doc_id, 0)), 0)
        bins[r.sequence_id].append((r.offset, r.length, loss))
    for i, own in ids.items():
        at = 0
        for start, n in sorted(docs[i]):
            assert start == at
            at += n
        assert at == len(own)
    for content in bins.values():
        at = 0
        for start, n, _ in sorted(content):
            assert start == at
            at += n
        assert at <= limits[0] and len(content) <= limits[1] and sum(x[2] for x in content) <= limits[2]
    return [sum(x[1] for x in c) for c in bins.values()]


@pytest.mark.parametrize("limits", [(4096, 128, 4096), (64, 3, 64), (64, 100, 20), (50, 4, 7)])
def test_packing_under_limits(spark, limits):
    texts = [None, ""] + [" ".join(["ab"] * (37 * i % 200)) for i in range(150)] + ["word " * 9000]
    rows = [(i, t, i % 40, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, prompt long, start string").coalesce(2)
    full = full_tokenizer()
    ids = {i: full.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    packed = packing.pack(frame, prompt_tokens="prompt", tokens=limits[0], segments=limits[1], loss_tokens=limits[2], window=16, with_ids=True)
    pieces = packed.collect()
    check_packing(pieces, ids, limits, {r[0]: r[2] for r in rows})
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in pieces)


def test_packing_pads_nothing_without_other_limits(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    full = full_tokenizer()
    ids = {r.doc_id: full.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    sizes = check_packing(packing.pack(docs).collect(), ids)
    assert all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokens=0)

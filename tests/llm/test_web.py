"""WARC archives and HTML extraction."""

import hashlib
import html as html_lib
import re
from collections import defaultdict

import pytest

from panelscore.llm import html_extract, warc
from panelscore.session import scratch_path

PAGE = "page_id long, url string, html string"


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- WARC


def expected_records(pages, least=1000):
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[(h or "").encode()].append(i)
    out = []
    for body, ids in groups.items():
        top = max(ids)
        for i in ids:
            again = len(body) >= least and i != top
            out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out)


def records(df):
    return sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(df))


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 77\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture
def page_rows():
    big = "<p>" + "grüße " * 300
    out = [(1, "http://a.b/", big), (2, "http://a.b/", big), (3, None, big), (4, "x", "small"), (5, "x", "small"), (6, "", None), (7, "u\r\nEvil: 1", "")]
    out += [(8, "f", FAKE), (9, "f", "x" * 3000 + FAKE * 3 + "tail"), (10, "f", FAKE[:40]), (11, "f", "WARC/1.1\r\n" * 200), (12, "f", "\r\n\r\n" * 400)]
    return out


def test_round_trip_rejects_records_inside_payloads(spark, page_rows):
    df = spark.createDataFrame(page_rows, PAGE).repartition(3)
    assert records(warc.round_trip(df)) == expected_records(page_rows)


def test_candidates_hold_false_records_and_the_chain_drops_them(spark, page_rows):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(page_rows, PAGE).coalesce(1), path)
    found = warc.read_candidates(spark, path)
    assert found.where("page_id = 77").count() == 4
    back = warc.read_archives(spark, path)
    assert back.where("page_id = 77").count() == 0 and back.count() == len(page_rows)


def test_archives_are_plain_warc(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(3, "http://a/é", "päge")], PAGE), path)
    (data,) = [bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = warc.header_fields(head)
    assert data.startswith(b"WARC/1.1\r\n") and fields["warc-target-uri"] == "http://a/é"
    assert rest == "päge".encode() + b"\r\n\r\n" and int(fields["content-length"]) == 5


def test_pages_of_the_test_table(spark, sample_dir):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    assert records(warc.round_trip(df.repartition(4))) == expected_records(pages)


def test_repeated_rows_null_ids_extra_columns_and_empty_table(spark):
    big = "y" * 2000
    schema = "page_id long, url string, html string, path string, start long, next long, rid int"
    df = spark.createDataFrame([(1, "u", big, "p", 1, 1, 1), (2, "u", big, "p", 1, 1, 1), (2, "u", big, "p", 1, 1, 1), (None, "u", big, "p", 1, 1, 1)], schema)
    got = rows(warc.round_trip(df))
    assert len(got) == 4
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [
        ("1", "revisit", 2), ("2", "response", None), ("2", "revisit", 2), ("None", "revisit", 2)
    ]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_page_ids_of_the_whole_64_bit_range_come_back():
    for i in (-(1 << 63), (1 << 63) - 1, 10**18, -(10**18), 7):
        head = f"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 0\r\nX-Page-Id: {i}\r\nX-Refers-To-Page: {i}\r\n\r\n"
        [found] = warc.candidates_of(head.encode())
        assert (found[2], found[6]) == (i, i)
    assert warc._number(str(1 << 63)) is None
    assert not list(warc.candidates_of(f"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: {(1 << 63) - 1}\r\n\r\n".encode()))


def test_pointer_jumping(spark):
    chain = [("f", i, i + 10) for i in range(0, 1000, 10)] + [("f", 5, 15), ("f", 15, 30), ("g", 0, 7), ("g", 3, 7), ("h", 4, 9)]
    got = rows(warc.reachable(spark.createDataFrame(chain, "path string, start long, next long")))
    assert {(r["path"], r["start"]) for r in got} == {("f", i) for i in range(0, 1000, 10)} | {("g", 0)}


# ---------------------------------------------------------------- HTML


def text_of(html):
    blocks, _, regions = html_extract.parse(html)
    return html_extract.main_text(blocks, regions, {})


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain  words &amp; more", "plain words & more"),
        ("<article><h1>T</h1><p>a<p>b &lt; c<br>d</article>", "T\na\nb < c\nd"),
        ("<body><nav><a>menu</a></nav><header>h</header><article><header>Title</header><p>x <b>y</b>z</p></article><footer>f</footer>", "Title\nx yz"),
        ("<main><p>one</p><aside>no</aside><form><p>no</p></form><div class='ad'>no</div><p>two</p></main><div>out</div>", "one\ntwo"),
        ("<div class='post-content'><p>body</p><div id='comments'><article><p>reader</p></article></div></div>", "body"),
        ("<article><script>var a='<p>x</p>';</script><style>p{}</style><p>ok<!-- <p>no</p> --></p></article>", "ok"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<article><p>a&nbsp; b\n\tc&#8212;&eacute;</p></article>", "a b c—é"),
        ("<title>t</title><body><p>para</p><div class='cookie-notice'>c</div><div role='navigation'>n</div>", "para"),
        ("<article><p>unclosed <b>bold<p>next <i>it", "unclosed bold\nnext it"),
        ("<article><p title='a>b'>quoted</p></article>", "quoted"),
    ],
)
def test_main_text(html, text):
    assert text_of(html) == text


def test_article_of_the_test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in rows(html_extract.extract(df))}
    for r in df.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r["html"], re.S).group(1)
        parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", re.sub(r"<!--.*?-->", "", body))
        parts = [re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in parts]
        text = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)


def site(n, host="s.example"):
    """Pages without any telling markup: fixed texts around a changing body."""
    page = "<html><body><div><div>Home</div><div>Products</div><div>Contact us</div></div><div><p>Story {0} begins here.</p><p>And story {0} ends {1}.</p></div><div>All rights kept</div></body></html>"
    return [(i, f"https://{host}/{i}", page.format(i, i * i)) for i in range(n)]


def test_template_texts_are_deduced_from_the_host(spark):
    pages = site(12)
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(spark.createDataFrame(pages, PAGE).repartition(3)))}
    assert got == {i: f"Story {i} begins here.\nAnd story {i} ends {i * i}." for i in range(12)}
    # joined by host instead of broadcast
    other = {r["page_id"]: r["text"] for r in rows(html_extract.extract(spark.createDataFrame(pages, PAGE), broadcast_tokens=0))}
    assert other == got


def test_copies_of_a_page_are_no_template(spark):
    one = site(1)[0][2]
    pages = [(i, "https://s.example/", one) for i in range(20)]
    got = rows(html_extract.extract(spark.createDataFrame(pages, PAGE)))
    assert {r["text"] for r in got} == {"Home\nProducts\nContact us\nStory 0 begins here.\nAnd story 0 ends 0.\nAll rights kept"}


def templates(spark, pages, **params):
    df = spark.createDataFrame(pages, PAGE).withColumn("host", html_extract.host_of("url"))
    known = html_extract.template(df.selectExpr("host", "xxhash64(html) page", "html"), **params)
    return {r["host"]: r.asDict(recursive=True) for r in known.collect()}


def test_classes_hold_tokens_with_equal_vectors(spark):
    known = templates(spark, site(12) + site(4, "few.example") + site(2, "two.example"))
    # two pages are too few to tell a template from a copy
    assert sorted(known) == ["few.example", "s.example"]
    for t in known.values():
        texts = [x for x in t["template"] if x["kind"] == html_extract.TEXT]
        assert len(texts) == 4 and {x["share"] for x in texts} == {1.0}


def test_template_tree_equals_brute_force(spark):
    """Classes, borders and nesting of a generated site against occurrence vectors and spans in plain Python."""
    pages = []
    for i in range(24):
        notice = "<section><h2>Notice</h2><div><i>Small print</i></div></section>" if i % 2 else ""
        extra = "<ol><li>Listed</li></ol><dl><dt>Term</dt></dl>" if i % 3 == 0 else ""
        items = "".join(f"<li>Item {i} {k}</li>" for k in range(i % 4 + 1))
        pages.append((i, f"https://t.example/{i}", f"<html><body><h1>Fixed</h1><div><p>Own {i}</p>{notice}<p>More {i}</p></div><ul>{items}</ul>{extra}<h6>End</h6></body></html>"))
    seqs = [html_extract.sequence(html_extract.parse(h)[1]) for _, _, h in pages]
    vectors = {}
    for n, seq in enumerate(seqs):
        for token, kind in seq:
            vectors.setdefault((token, kind), [0] * len(pages))[n] += 1
    by = {}
    for token, vector in vectors.items():
        if sum(map(bool, vector)) >= 0.3 * len(pages):
            by.setdefault(tuple(vector), set()).add(token)
    classes = {v: ts for v, ts in by.items() if len(ts) > 1}
    [known] = templates(spark, pages).values()
    name = {t["token"]: t["cls"] for t in known["template"]}
    assert {frozenset(t for t, _ in ts) for ts in classes.values()} == {frozenset(t for t in name if name[t] == c) for c in set(name.values())}
    once = {name[min(ts)[0]]: ts for v, ts in classes.items() if max(v) == 1}
    assert {b["cls"]: {(x["token"], x["close"]) for x in b["tokens"]} for b in known["borders"]} == {
        c: {(t, k == html_extract.CLOSE) for t, k in ts} for c, ts in once.items()
    }
    inside = {}  # class -> slots of other classes that hold all of it, on every page
    for v, ts in classes.items():
        c, slots = name[min(ts)[0]], None
        for seq in seqs:
            own = [i for i, x in enumerate(seq) if x in ts]
            if not own:
                continue
            here = set()
            for p, ps in once.items():
                at = [i for i, x in enumerate(seq) if x in ps]
                before = sum(i < own[0] for i in at)
                if p != c and at and 0 < before < len(at) and at[before] > own[-1]:
                    here.add((p, before, at[before] - at[before - 1]))
            found = {(p, s) for p, s, _ in here}
            slots = found if slots is None else slots & found
            width = {(p, s): w for p, s, w in here}
        if slots:
            inside[c] = min(slots, key=width.__getitem__)
    assert {n["cls"]: (n["parent"], n["slot"]) for n in known["tree"]} == inside and len(inside) >= 3


def test_slots_tell_menus_and_articles_without_names(spark):
    """Links that differ from page to page are a menu slot; a page that lost its mark is read by its host's slots."""
    page = "<html><body><div><div><a>Topic {0}</a><a>Next {0}</a></div></div><section><p>Story {0} has <a>a link</a> in it.</p></section><h6>End</h6></body></html>"
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(spark.createDataFrame([(i, f"https://m.example/{i}", page.format(i)) for i in range(9)], PAGE)))}
    assert got == {i: f"Story {i} has a link in it." for i in range(9)}
    marked = "<html><body><h1>Site</h1><section{1}><p>Text {0}.</p></section><table><tr><td>Teaser {0}</td></tr></table><h6>End</h6></body></html>"
    pages = [(i, f"https://a.example/{i}", marked.format(i, ' id="story"' if i == 7 else ' itemprop="articleBody"')) for i in range(20)]
    pages[7] = (7, pages[7][1], marked.format(7, ""))
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(spark.createDataFrame(pages, PAGE)))}
    assert got == {i: f"Text {i}." for i in range(20)}


def test_borders_that_change_places_or_cross(spark):
    """Tokens in varying order give no borders; their texts stay fixed."""
    pages = []
    for i in range(10):
        parts = ["<div><b>Left</b></div>", "<p>Right</p>"]
        pages.append((i, f"https://x.example/{i}", f"<html><body><h1>Head</h1>{''.join(parts[:: 1 if i % 2 else -1])}<section>Own {i}</section></body></html>"))
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(spark.createDataFrame(pages, PAGE)))}
    assert got == {i: f"Own {i}" for i in range(10)}
    a, b = [(1, 0), (2, 0)], [(3, 0), (4, 0)]
    cls, rank = {1: 10, 2: 10, 3: 20, 4: 20}, {10: (5, 2, 10), 20: (4, 2, 20)}
    assert html_extract.read_borders([a[0], b[0], b[1], a[1]], cls, rank)[1] == set()
    assert html_extract.read_borders([a[0], b[0], a[1], b[1]], cls, rank)[1] == {20}


def test_html_edges(spark):
    schema = "page_id long, url string, html string, host string, page int, fixed string, token int"
    data = [(1, None, None, "h", 1, "f", 1), (None, "no url", "<p>a", "h", 1, "f", 1), (2, "http://u@h:80/x", "", "h", 1, "f", 1), (3, "http://h", "<article>" + "w " * 200_000, "h", 1, "f", 1), (3, "http://h", "<article>same", "h", 1, "f", 1)]
    got = rows(html_extract.extract(spark.createDataFrame(data, schema)))
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 0), ("2", 0), ("3", 4), ("3", 399_999), ("None", 1)]
    assert html_extract.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_host_of(spark):
    df = spark.createDataFrame([("HTTP://User@WWW.a.B:8080/p?q",), ("mailto:x",), (None,), ("https://x.y?z",)], "url string")
    assert [r[0] for r in df.select(html_extract.host_of("url")).collect()] == ["www.a.b", "", "", "x.y"]


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Long payloads go to archives of their own; all records are read back."""
    import os

    rows = [(i, f"http://h.example/{i}", "x" * n) for i, n in enumerate([10, 3000, 20_000, 20_001, 300_000, 300_001, 2_000_000] * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, min_revisit=10**9, archive_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "warc").iterdir() if f.name.startswith("part-")]
    assert max(s for s in sizes if s < 2_000_000) <= 1 << 20
    assert sum(s > 2_000_000 for s in sizes) == 3 and max(sizes) < 2_002_000
    got = warc.round_trip(pages).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == sorted((i, len(h)) for i, _, h in rows)


def test_long_notice_is_template_and_names_do_not_cut_the_article(spark):
    """A notice of any length that all pages share goes; classes that only hold a listed word stay."""
    notice = "This notice is repeated on all pages of the site, and says in many words what nobody reads. " * 5
    rows = []
    for i in range(12):
        body = (
            f'<div class="feedback-loop">Loop {i} of the amplifier.</div><p class="search-and-rescue">Rescue {i} at sea.</p>'
            f'<div class="tags-overview">Overview {i}.</div><p>The <span class="legal">legal {i}</span> case.</p><p>{notice}</p>'
            f'<div class="comments"><p>Reader {i} writes.</p></div><ul class="share social"><li>Share {i}</li></ul>'
        )
        rows.append((i, f"http://one.example/{i}", f"<html><body><nav>Home</nav><article><h1>Title {i}</h1>{body}</article></body></html>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i].split("\n") == [f"Title {i}", f"Loop {i} of the amplifier.", f"Rescue {i} at sea.", f"Overview {i}.", f"The legal {i} case."]


def test_small_host_without_markup(spark):
    """On a host of four pages what all share is template."""
    rows = [
        (i, f"http://small.example/{i}", f"<body><div>Home</div><div>Menu item</div><div><p>Own words of page {i}.</p></div><div>Imprint</div></body>")
        for i in range(4)
    ]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words of page {i}." for i in range(4)}

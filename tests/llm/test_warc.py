import gzip
import html.parser
import json
import random
import time
import zlib

import pytest

from codetide.llm import warc

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
<body><!-- <a href="hidden"> --><h1>Head</h1><p>One <b>bold</b> word<br>next &lt;line&gt;</p><a href='/x?a=1&amp;b=2'>link</a><img alt="a > b" src=pic.png></body></html>"""


def test_text_and_links():
    assert warc.page_text(PAGE) == "A & B\nHead\nOne bold word\nnext <line>\nlink"
    assert warc.page_links(PAGE) == [{"tag": "a", "url": "/x?a=1&b=2"}, {"tag": "img", "url": "pic.png"}]
    assert warc.page_text("") == "" and warc.page_text("no tags 1 < 2") == "no tags 1 < 2"


class Plain(html.parser.HTMLParser):
    """The library's event parser as brute force: the same lines and links, found another way."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.links, self.hidden = [""], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in warc.BREAKS:
            self.lines.append("")
        wanted = next(((k, v) for k, v in attrs if k == warc.LINKING.get(tag)), None)
        if wanted and not self.hidden:
            self.links.append({"tag": tag, "url": wanted[1] or ""})
        self.hidden += tag in warc.HIDDEN
        if tag in warc.HIDDEN:
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN and self.hidden > 0
        if tag in warc.BREAKS:
            self.lines.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1] += data.replace("\n", " ")

    def handle_comment(self, data):
        self.lines[-1] += " " * (not self.hidden)

    @property
    def text(self):
        return "\n".join(x for x in (" ".join(line.split()) for line in self.lines) if x)


def test_pages_against_the_library_parser():
    rng = random.Random(4)
    pieces = ["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "<br/>", "<a href=\"/x?y=1&amp;z=2\">", "</a>", "<img src=a.png alt='>'>", "<!-- no <p> -->", "<script>if (a < b) { '<p>' }</script>", "<style>p > a {}</style>", "words and ", "more\nlines ", "&lt;tag&gt; ", "&eacute; ", "<h2>", "</h2>", "<iframe src='f'>", "</iframe>", "1 < 2 ", "<link href=c.css>", "<li>"]
    for _ in range(400):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        plain = Plain(page)
        assert warc.page_text(page) == plain.text, page
        assert warc.page_links(page) == plain.links, page


@pytest.mark.parametrize("piece", ["<script ", "<a ", "<a href='", "<!--", "<", "</", "<title>", "<style>", "<p title=\"", "<a href=x>", "&", "<script>", "=\"", "<a =\"'"])
def test_hostile_pages_take_linear_time(piece):
    start = time.perf_counter()
    warc.Page(piece * (400_000 // len(piece)))
    assert time.perf_counter() - start < 3


def header(record, name):
    return warc.header(warc.parse_record(record)[0], name)


def test_derived_records_name_their_response():
    response = warc.build_response("7", "http://a.example/\r\nX: y", PAGE.encode(), "2024-01-02T03:04:05Z")
    source, block = warc.parse_record(response)
    assert header(response, "warc-block-digest") == warc.sha1_label(block)
    metadata, conversion = warc.derive(response)
    for fields in (metadata, conversion):
        headers, content = warc.parse_record(fields["record"])
        named = {k.lower(): v for k, v in headers}
        assert named["warc-refers-to"] == header(response, "warc-record-id") == fields["refers_to"]
        assert named["warc-target-uri"] == header(response, "warc-target-uri") and named["warc-date"] == "2024-01-02T03:04:05Z"
        assert named["warc-block-digest"] == warc.sha1_label(content) == fields["block_digest"]
        assert fields["payload_digest"] == header(response, "warc-payload-digest") == warc.sha1_label(PAGE.encode())
        assert int(named["content-length"]) == len(content)
    assert warc.parse_record(conversion["record"])[1].decode() == warc.page_text(PAGE)
    envelope = json.loads(warc.parse_record(metadata["record"])[1])
    assert envelope["HTML-Metadata"]["Title"] == "A & B" and len(envelope["HTML-Metadata"]["Links"]) == 2
    assert [tuple(x) for x in envelope["Source-WARC-Headers"]] == source
    assert ["Content-Type", "text/html; charset=utf-8"] in envelope["HTTP-Response-Metadata"]["Headers"]
    assert envelope["Source-Payload-Digest"] == header(response, "warc-payload-digest")


def response(body, *http, drop=(), extra=()):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in http) + b"\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://x/"), *extra]
    return warc.build_record([h for h in headers if h[0] not in drop], block)


def conversion(record):
    return warc.parse_record(warc.derive(record)[1]["record"])[1].decode()


def test_repeated_headers_stay():
    record = response(b"x", ("Set-Cookie", "a=1"), ("set-cookie", "b=2"), ("Link", "</a>"), ("Link", "</b>"), extra=(("WARC-Concurrent-To", "<1>"), ("WARC-Concurrent-To", "<2>")))
    envelope = json.loads(warc.parse_record(warc.derive(record)[0]["record"])[1])
    assert envelope["HTTP-Response-Metadata"]["Headers"] == [["Set-Cookie", "a=1"], ["set-cookie", "b=2"], ["Link", "</a>"], ["Link", "</b>"]]
    assert [v for k, v in envelope["Source-WARC-Headers"] if k == "WARC-Concurrent-To"] == ["<1>", "<2>"]


def test_codings_and_charsets():
    page = "<p>grün 漢字</p>".encode()
    chunked = b"5;x=y\r\n" + page[:5] + b"\r\n" + b"%x\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    for record in (
        response(chunked, ("Transfer-Encoding", "chunked")), response(page, ("Transfer-Encoding", "chunked")), response(gzip.compress(page), ("Content-Encoding", "gzip")),
        response(gzip.compress(page[:4]) + gzip.compress(page[4:]), ("Content-Encoding", "x-gzip")), response(zlib.compress(page), ("Content-Encoding", "deflate")),
        response(raw.compress(page) + raw.flush(), ("Content-Encoding", "deflate")), response(page, ("Content-Encoding", "identity")), response(b"\xef\xbb\xbf" + page, ("Content-Type", "text/html; charset=latin-1")),
        response(page.decode().encode("utf-16-le"), ("Content-Type", 'text/html; charset="utf-16-le"')), response(page, ("Content-Type", "text/html; charset=no-such")),
    ):
        assert conversion(record) == "grün 漢字"
    assert conversion(response("<meta charset='latin-1'>grün".encode("latin-1"))) == "grün"
    assert conversion(response("grün".encode("latin-1"), ("Content-Type", "text/html; charset=ISO-8859-1"))) == "grün"


def test_bad_records_are_reported(spark):
    good = response(b"<p>fine</p>")
    rows = [
        (1, None), (2, bytearray(b"junk")), (3, bytearray(warc.derive(good)[0]["record"])), (4, bytearray(response(b"x", drop=("WARC-Record-ID",)))), (5, bytearray(good[:-20])),
        (6, bytearray(good.replace(b"Content-Length", b"Content-Lingth"))), (7, bytearray(response(b"no gzip", ("Content-Encoding", "gzip")))), (8, bytearray(response(b"x", ("Content-Encoding", "br")))), (9, bytearray(good)),
    ]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "key long, record binary, problem int")
    got = {}
    for r in warc.derivatives(frame).collect():
        got.setdefault(r["key"], []).append((r["record_type"], r["problem"]))
    assert set(got) == {2, 4, 5, 6, 7, 8, 9} and got[9] == [("metadata", None), ("conversion", None)]
    assert got[2] == [("bad", "not a WARC record")] and got[4] == [("bad", "no WARC-Record-ID")] and got[5] == [("bad", "block cut off")] and got[6] == [("bad", "no content length")]
    assert [k for k, _ in got[7]] == ["metadata"] and got[7][0][1].startswith("compressed body: ")
    assert got[8] == [("metadata", "content coding br")]


def test_long_attributes_are_no_text():
    for sign in "\"'":
        page = f"<p>a</p><div data-x={sign}{'k > v ' * 3000}{sign}>text</div><a href={sign}/x{sign}>b</a>"
        assert warc.page_text(page) == Plain(page).text == "a\ntext\nb" and warc.page_links(page) == Plain(page).links


def test_bodies_cut_off_say_so(monkeypatch):
    page = b"<p>" + bytes(random.Random(2).choices(b"abcdefghij ", k=5000)) + b"</p>"
    packed = gzip.compress(page)
    for body, http, problem in (
        (b"5\r\n<p>", ("Transfer-Encoding", "chunked"), "chunked body cut off"), (b"3\r\n<p>\r\nfe", ("Transfer-Encoding", "chunked"), "chunked body cut off"),
        (packed[:1500], ("Content-Encoding", "gzip"), "compressed body cut off"), (packed + packed[:700], ("Content-Encoding", "gzip"), "compressed body cut off"),
    ):
        made = warc.derive(response(body, http))
        assert [(m["record_type"], m["problem"]) for m in made] == [("metadata", problem), ("conversion", problem)]
        assert json.loads(warc.parse_record(made[0]["record"])[1])["Problem"] == problem
    assert conversion(response(packed[:1500], ("Content-Encoding", "gzip"))).strip() in warc.page_text(page.decode())
    damaged = bytearray(packed)
    damaged[len(packed) // 2] ^= 255
    made = warc.derive(response(bytes(damaged), ("Content-Encoding", "gzip")))
    assert made[0]["problem"].startswith("compressed body")
    monkeypatch.setattr(warc, "MOST_UNFOLDED", 1000)
    made = warc.derive(response(packed, ("Content-Encoding", "gzip")))
    assert len(made) == 2 and {m["problem"] for m in made} == {"compressed body too large"} and 900 < len(conversion(response(packed, ("Content-Encoding", "gzip")))) <= 1000


def test_conversions_are_of_text_alone():
    image = b"\x89PNG\r\n\x1a\n\0\0" + b"<p>no</p>"
    for kind in ("image/png", "image/svg+xml", "application/pdf", "video/mp4"):
        made = warc.derive(response(image, ("Content-Type", kind)))
        assert [m["record_type"] for m in made] == ["metadata"] and made[0]["problem"] is None
        assert "HTML-Metadata" not in json.loads(warc.parse_record(made[0]["record"])[1])
    assert [m["record_type"] for m in warc.derive(response(image))] == ["metadata"]
    assert conversion(response(b"a < b\n <p> ", ("Content-Type", "text/plain; charset=utf-8"))) == "a < b\n <p> "
    assert conversion(response(b'{"a": "<b>"}', ("Content-Type", "application/json"))) == '{"a": "<b>"}'
    assert conversion(response(b"<p>x</p>", ("Content-Type", "application/xhtml+xml"))) == "x"
    for line, kinds in ((b"301 Moved", ["metadata"]), (b"404 Not Found", ["metadata"]), (b"204 No Content", ["metadata", "conversion"]), (b"2000 Odd", ["metadata"])):
        assert [m["record_type"] for m in warc.derive(response(b"<p>x</p>").replace(b"200 OK", line, 1).replace(b"Content-Length: %d" % 27, b"Content-Length: %d" % (21 + len(line))))] == kinds


def test_tables(spark):
    pages = [(1, "http://a.example/", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (1, "http://a.example/", PAGE, 0), (None, "v", "<p>" * 50_000, 0)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, record int")
    out = warc.derivatives(warc.responses_of(frame))
    rows = out.collect()
    assert len(rows) == 10 and {r["record_type"] for r in rows} == {"metadata", "conversion"}
    by = {}
    for r in rows:
        by.setdefault((r["key"], r["record_type"]), set()).add(bytes(r["record"]))
    assert len(by[1, "metadata"]) == 1  # repeated pages give equal records
    assert warc.derivatives(warc.responses_of(frame.limit(0))).count() == 0


def test_files_round_trip(spark):
    frame = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i}</p>") for i in range(25)] + [(None, None, None)], "page_id long, url string, html string").repartition(3)
    records = warc.derivatives(warc.responses_of(frame)).select("record")
    index = warc.write_warc(records)
    assert index.columns == ["file", "offset", "length", "root"]
    back = warc.read_warc(index)
    assert sorted(bytes(r[0]) for r in back.collect()) == sorted(bytes(r[0]) for r in records.collect())
    responses = warc.responses_of(frame)
    keyed = warc.read_warc(warc.write_warc(responses, key_col="key"), key_col="key")
    assert sorted((str(r["key"]), bytes(r["record"])) for r in keyed.collect()) == sorted((str(r["key"]), bytes(r["record"])) for r in responses.collect())
    # The files are gzip members in a row, which any reader of such files takes.
    place = index.first()
    assert gzip.open(f"{place['root'].removeprefix('file:')}/{place['file']}").read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_query_against_a_plain_derivation(spark):
    from pathlib import Path

    from codetide.llm import queries

    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("no test tables here")
    out = {(r["page_id"], r["record_type"]): r for r in queries.op9_warc(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(out) == 2 * len(pages)
    for p in pages:
        text = Plain(p["html"] or "")
        row = out[p["page_id"], "conversion"]
        assert row["block_digest"] == warc.sha1_label(text.text.encode()) and row["n_links"] == len(text.links) and row["target_uri"] == (p["url"] or "")
        assert row["payload_digest"] == warc.sha1_label((p["html"] or "").encode())

"""WARC derivatives: linked metadata and plain-text conversion records from responses.

Each response record gives a metadata record (title, links, headers) and a
conversion record (the page's text).  Both name the response in WARC-Refers-To
and keep its target and date; the metadata record holds all source headers, WARC
and HTTP, in their order with repeats, and the digest of the payload.

Bodies are taken out of their chunked transfer and gzip or deflate coding and read
in the charset that the header, the page or its byte order mark names.  HTML is
read in one pass of time in proportion to its length.

Only successful responses (2xx) with HTML or other text have a conversion record;
of all others, such as images and redirects, the metadata record says what they
are.  A body that can't be read to its end has its metadata record, and a conversion of
what can be read; both name the ``problem``.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from .common import scratch, stage
from .media import open_store

VERSION = "WARC/1.1"
#: The date of records whose source gives none.
NO_DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6f1f6f0e-7d53-5c43-9a7b-0d1d5c0a8e11")

#: Elements whose text is not shown, and elements that begin a line of their own.
HIDDEN = frozenset("script style noscript template".split())
BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav main title head body html blockquote pre hr".split())
LINKING = {"a": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}
#: Bytes that a compressed body is unfolded to, at most.  Text of a larger one is cut there, which its records say.
MOST_UNFOLDED = 1 << 28
HTML_TYPES = ("text/html", "application/xhtml+xml")
#: Types beside ``text/*`` whose body is text as it stands.
TEXT_TYPES = ("application/json", "application/xml", "application/javascript", "application/x-javascript", "application/ld+json")

DERIVED_SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, n_links long, record binary, problem string"


# --- records ------------------------------------------------------------------


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same record gets the same identifier in every run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(parts))}>"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """A record that can't be read, and why."""


def parse_record(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """The headers, in order with repeats, and the block of one record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise BadRecord("not a WARC record")
    headers = header_list(lines[1:])
    length = header(headers, "content-length")
    if length is None or not length.isascii() or not length.isdigit():
        raise BadRecord("no content length")
    if len(rest) < int(length):
        raise BadRecord("block cut off")
    return headers, rest[: int(length)]


def header_list(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values; a line that begins with white space goes on with the value before it."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a header, whatever the case of its name."""
    return next((v for k, v in headers if k.lower() == name), None)


def build_response(key: str, url: str, body: bytes, date: str = NO_DATE) -> bytes:
    """A response record as a crawler stores it; ``key`` tells repeated visits of a URL apart."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(body), body)
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url)), ("WARC-Target-URI", url), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1_label(body)), ("WARC-Block-Digest", sha1_label(block)),
    ]
    return build_record(headers, block)


# --- derivation ---------------------------------------------------------------


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order with repeats, and the body as sent."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], header_list(lines[1:]), body


def plain_body(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, str | None]:
    """The body out of its transfer and content coding, and what keeps it from being whole.

    Of a body that was cut off, or is damaged or too large, there is what comes before; of a coding that is not known, nothing.
    """
    problem = None
    if "chunked" in (header(headers, "transfer-encoding") or "").lower():
        body, problem = _unchunked(body)
    for coding in reversed([c.strip().lower() for c in (header(headers, "content-encoding") or "").split(",") if c.strip()]):
        found = None
        if coding in ("gzip", "x-gzip"):
            body, found = _unfold(body, 31)
        elif coding == "deflate":
            body, found = _unfold(body, 15 if len(body) > 1 and body[0] & 15 == 8 and (body[0] * 256 + body[1]) % 31 == 0 else -15)
        elif coding != "identity":
            body, found = b"", f"content coding {coding}"
        problem = problem or found
    return body, problem


def _unfold(body: bytes, bits: int) -> tuple[bytes, str | None]:
    """All members of a compressed body, up to the first that is cut off, damaged or beyond the limit."""
    out, size = [], 0
    while body:
        member, pending = zlib.decompressobj(bits), body
        while not member.eof and pending:
            try:
                out.append(member.decompress(pending, min(1 << 20, MOST_UNFOLDED - size + 1)))
            except zlib.error as e:
                return b"".join(out), f"compressed body: {e}"
            size += len(out[-1])
            if size > MOST_UNFOLDED:
                return b"".join(out)[:MOST_UNFOLDED], "compressed body too large"
            pending = member.unconsumed_tail
        if not member.eof:
            out.append(member.flush())
            return b"".join(out), "compressed body cut off"
        body = member.unused_data if bits == 31 else b""
    return b"".join(out), None


def _unchunked(body: bytes) -> tuple[bytes, str | None]:
    """Chunks put together; a body that has none is taken as it is, since some crawlers undo them."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 1024)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return (b"".join(out), "chunked body cut off") if out else (body, None)
        n = int(size, 16)
        if n == 0:
            return b"".join(out), None
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) < n:
            return b"".join(out), "chunked body cut off"
        at = end + 2 + n + 2


def content_kind(headers: list[tuple[str, str]], body: bytes) -> str:
    """``html``, ``text`` or ``other``, by the stated type, and by the first bytes where none is stated."""
    stated = (header(headers, "content-type") or "").partition(";")[0].strip().lower()
    if stated in HTML_TYPES:
        return "html"
    if stated:
        return "text" if stated.startswith("text/") or stated in TEXT_TYPES or stated.endswith(("+xml", "+json")) and not stated.startswith("image/") else "other"
    start = body[:1024]
    return "other" if b"\0" in start and not start.startswith((b"\xff\xfe", b"\xfe\xff")) else "html"


def successful(status: str) -> bool:
    """Whether a status line says 2xx."""
    return re.match(r"HTTP/[\d.]+ 2\d\d(?!\d)", status) is not None


_META_CHARSET = re.compile(rb"<meta[^<>]{0,200}?charset\s{0,9}=\s{0,9}[\"']?([A-Za-z0-9_.:-]{1,40})", re.I)


def decode_page(headers: list[tuple[str, str]], body: bytes) -> str:
    """The page as text: by byte order mark, HTTP header or the page's own statement, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    said = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", header(headers, "content-type") or "", re.I)
    stated = _META_CHARSET.search(body[:1024])
    for name in (said[1] if said else None, stated[1].decode() if stated else None):
        if name:
            try:
                return body.decode(name, "replace")
            except (LookupError, UnicodeError):  # not a charset
                continue
    return body.decode("utf-8", "replace")


class Page:
    """Title, visible lines and links of a page, read tag by tag from front to back.

    Every search starts where the last one ended, and one that found nothing is
    not made again, so time grows with the length whatever the page holds.
    """

    def __init__(self, page: str):
        self.page, self.links, self._out, self._title = page, [], [], []
        self._none: dict[str, bool] = {}
        self._quotes: dict[str, int] = {}
        self.titled = False
        self._read()

    @property
    def title(self) -> str:
        return " ".join(html.unescape("".join(self._title)).split())

    @property
    def text(self) -> str:
        """A line for each block of the page, white space folded."""
        lines = (" ".join(x.split()) for x in html.unescape("".join(self._out)).split("\n"))
        return "\n".join(x for x in lines if x)

    def _find(self, what: str, at: int) -> int:
        """The next place of ``what``, or -1; remembers that there is none."""
        if self._none.get(what):
            return -1
        found = self.page.find(what, at)
        self._none[what] = found < 0
        return found

    def _text(self, piece: str, in_title: bool) -> None:
        # Line ends in the source are white space; only breaks begin lines.
        self._out.append(piece.replace("\n", " ").replace("\r", " "))
        if in_title:
            self._title.append(piece)

    def _read(self) -> None:
        page, at, in_title = self.page, 0, False
        lower = page.lower() if len(page.lower()) == len(page) else page
        while at < len(page):
            start = self._find("<", at)
            if start < 0:
                self._text(page[at:], in_title)
                return
            self._text(page[at:start], in_title)
            follows = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = self._find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                self._out.append(" ")
                continue
            if not (follows.isascii() and follows.isalpha() or follows in ("/", "!", "?")) or not follows:
                self._text("<", in_title)
                at = start + 1
                continue
            end = self._tag_end(start + 1)
            if end < 0:  # a tag that never ends is text
                self._text("<", in_title)
                at = start + 1
                continue
            at = end + 1
            closing = follows == "/"
            name = _NAME.match(lower, start + 1 + closing)
            tag = name[0] if name else ""
            if tag in BREAKS:
                self._out.append("\n")
            if tag == "title":
                in_title, self.titled = not closing and not self.titled, self.titled or not closing
            if not closing and tag in LINKING:
                self._link(tag, page[start:end])
            if not closing and tag in HIDDEN:
                stop = self._close(lower, f"</{tag}", at)
                self._out.append(" ")
                at = len(page) if stop < 0 else stop
                if stop < 0 and tag != "script":
                    return

    def _close(self, lower: str, what: str, at: int) -> int:
        if self._none.get(what):
            return -1
        found = lower.find(what, at)
        self._none[what] = found < 0
        return found

    def _tag_end(self, at: int) -> int:
        """The ``>`` of a tag, outside quoted values; the next one where a quote stays open; -1 without any."""
        first = self._find(">", at)
        if first < 0:
            return -1
        end = first
        while True:
            quote = _QUOTE.search(self.page, at, end)
            if quote is None:
                return end
            closing = self._quote(quote[0][-1], quote.end())
            if closing < 0:
                return first
            at = closing + 1
            if at > end:
                end = self._find(">", at)
                if end < 0:
                    return first

    def _quote(self, sign: str, at: int) -> int:
        """The next place of a quote sign, or -1.  Each search goes on where the last one ended."""
        place = self._quotes.get(sign, 0)
        if 0 <= place < at:
            place = self._quotes[sign] = self.page.find(sign, at)
        return place

    def _link(self, tag: str, source: str) -> None:
        for m in _ATTRIBUTE.finditer(source):
            if m[1].lower() == LINKING[tag]:
                self.links.append({"tag": tag, "url": html.unescape(next((x for x in m.groups()[1:] if x is not None), ""))})
                return


_NAME = re.compile(r"[a-z][a-z0-9]*")
_QUOTE = re.compile(r"=\s{0,9}[\"']")
_ATTRIBUTE = re.compile(r"(?<=[\s\"'/])([A-Za-z-]{1,40})\s{0,9}=\s{0,9}(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


def page_text(page: str) -> str:
    """The visible text: a line for each block of the page, white space folded."""
    return Page(page).text


def page_links(page: str) -> list[dict[str, str]]:
    return Page(page).links


def derive(response: bytes) -> list[dict]:
    """The metadata record of a response record and, if it holds text, the conversion record, with their fields; raises BadRecord."""
    source, block = parse_record(response)
    origin = header(source, "warc-record-id")
    if not origin:
        raise BadRecord("no WARC-Record-ID")
    status, http, body = split_http(block)
    plain, problem = plain_body(http, body)
    kind = content_kind(http, plain)
    target, date = header(source, "warc-target-uri") or "", header(source, "warc-date") or NO_DATE
    digest = header(source, "warc-payload-digest") or sha1_label(body)
    envelope = {"Source-WARC-Headers": source, "Source-Payload-Digest": digest, "HTTP-Response-Metadata": {"Status-Line": status, "Headers": http}}
    text, links = None, []
    if kind == "html":
        page = Page(decode_page(http, plain))
        text, links = page.text, page.links
        envelope["HTML-Metadata"] = {"Title": page.title, "Links": links}
    elif kind == "text":
        text = decode_page(http, plain)
    if problem is not None:
        envelope["Problem"] = problem
    contents = [("metadata", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"), "application/json")]
    if text is not None and successful(status) and (plain or not body):
        contents.append(("conversion", text.encode("utf-8", "replace"), "text/plain"))
    made = []
    for record_type, content, media in contents:
        fields = {
            "record_type": record_type, "record_id": record_id(record_type, origin), "refers_to": origin, "target_uri": target, "warc_date": date, "content_type": media, "content_length": len(content),
            "block_digest": sha1_label(content), "payload_digest": digest, "n_links": len(links), "problem": problem,
        }
        headers = [
            ("WARC-Type", record_type), ("WARC-Record-ID", fields["record_id"]), ("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date),
            ("WARC-Target-URI", target), ("WARC-Date", date), ("Content-Type", media), ("WARC-Block-Digest", fields["block_digest"]),
        ]
        made.append(fields | {"record": build_record(headers, content)})
    return made


FIELDS = tuple(x.split()[0] for x in DERIVED_SCHEMA.split(", "))


def rows_of(record: bytes | None) -> list[dict]:
    """What a record gives: its derived records, none if it is no response, or one row that names the problem."""
    if record is None:
        return []
    try:
        kind = header(parse_record(record)[0], "warc-type")
        return derive(record) if kind == "response" else []
    except BadRecord as e:
        return [dict.fromkeys(FIELDS) | {"record_type": "bad", "problem": str(e)}]


def derivatives(responses: DataFrame, key_col: str = "key", record_col: str = "record") -> DataFrame:
    """A metadata row for every response record, and a conversion row where it is text; see ``DERIVED_SCHEMA``.

    A record that can't be read gives one row of type ``bad`` with the ``problem``
    and nothing else; rows of a response whose body is not whole name the problem too.
    Null records and records of other types give none.  Repeated responses give
    repeated rows, and an empty table none.  Other columns are ignored, whatever their
    names.
    """
    ship(responses.sparkSession)
    kind = responses.schema[key_col].dataType.simpleString()
    kinds = [pa.int64() if n in ("content_length", "n_links") else pa.binary() if n == "record" else pa.string() for n in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, fields) for i, record in enumerate(batch.column(1)) for fields in rows_of(record.as_py())]
            keys = batch.column(0).take(pa.array([i for i, _ in made], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[n] for _, r in made], k) for n, k in zip(FIELDS, kinds, strict=True))], names=["key", *FIELDS])

    rows = responses.select(F.col(key_col).alias("key"), F.col(record_col).alias("record"))
    return rows.mapInArrow(run, f"key {kind}, {DERIVED_SCHEMA}").withColumnRenamed("key", key_col)


def responses_of(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(key, record)`` with a response record for every page; null URLs and pages count as empty."""
    ship(pages.sparkSession)
    kind = pages.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build_response(str(k.as_py()), u.as_py() or "", (h.as_py() or "").encode()) for k, u, h in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "record"])

    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"key {kind}, record binary")


# --- files --------------------------------------------------------------------


def write_warc(records: DataFrame, root: str | None = None, record_col: str = "record", key_col: str | None = None) -> DataFrame:
    """Write records to gzip WARC files, a member for each, and return ``(file, offset, length, root)``, stored.

    ``root`` must be on shared storage.  Names hold the task's attempt; only the
    files in the returned rows are whole.  Null records are left out, repeated ones
    are written again, an empty table gives no rows, and other columns are ignored.
    With ``key_col`` the rows have that column too.
    """
    ship(records.sparkSession)
    root = root or scratch(records.sparkSession, "warc")
    key = F.lit(None).cast("string") if key_col is None else F.col(key_col)
    rows = records.select(key.alias("key"), F.col(record_col).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        with closing(store.open_output_stream(f"{base}/{name}", compression=None)) as out:
            for batch in batches:
                places, kept = [], []
                for i, record in enumerate(batch.column(1)):
                    if record.is_valid:
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = member.compress(record.as_py()) + member.flush()
                        out.write(data)
                        places.append((at, len(data)))
                        kept.append(i)
                        at += len(data)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([name] * len(places), pa.string()), *(pa.array([r[i] for r in places], pa.int64()) for i in (0, 1))], names=["key", "file", "offset", "length"])

    index = stage(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, file string, offset long, length long"), "warc-index").withColumn("root", F.lit(root))
    return index.drop("key") if key_col is None else index.withColumnRenamed("key", key_col)


def read_warc(index: DataFrame, key_col: str | None = None) -> DataFrame:
    """``record`` for every row of an index as :func:`write_warc` returns it, by range reads; with ``key_col`` that column too.

    Rows that follow each other in a file share one open file.  Repeated rows are
    read again, an empty index gives no rows, and other columns are ignored.
    """
    ship(index.sparkSession)
    key = F.lit(None).cast("string") if key_col is None else F.col(key_col)
    rows = index.select(key.alias("key"), "file", "offset", "length", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        try:
            for batch in batches:
                out = []
                for file, offset, length, root in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    if (root, file) != opened:
                        if handle is not None:
                            handle.close()
                        store, base = open_store(root)
                        opened, handle = (root, file), store.open_input_file(f"{base}/{file}")
                    out.append(zlib.decompress(handle.read_at(length, offset), 31))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "record"])
        finally:
            if handle is not None:
                handle.close()

    found = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, record binary")
    return found.drop("key") if key_col is None else found.withColumnRenamed("key", key_col)

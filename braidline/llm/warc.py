"""Operator 3: WARC derivatives: metadata and conversion records of responses.

From every response record come a ``metadata`` record (what is known about the
capture, with the source's headers) and a ``conversion`` record (the page's plain
text).  Both name the response in WARC-Refers-To and carry its target, date and
payload digest; their own ids follow from its id, so a rebuilt derivative is equal
byte by byte.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = b"\r\n"
#: Elements whose text is no text of the page, and those that end a line.
SILENT = {"script", "style", "noscript", "template", "head", "svg"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "aside", "blockquote", "pre", "title", "td", "th", "main", "form", "hr"}
#: What a head may hold; any other element, or text, ends one that is not closed.
HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "script", "style", "template"}
#: Elements that end an svg that is not closed, but in these parts of it.
NOT_SVG = {"b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var"}
FOREIGN = {"foreignobject", "desc"}

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    """SHA-1 in the form that WARC files use."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def render(headers: Headers, block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + CRLF + CRLF + block + CRLF + CRLF


def records(stream: BinaryIO) -> Iterator[tuple[Headers, bytes]]:
    """Records of an uncompressed WARC stream, one in memory at a time.

    Header lines that begin with white space continue the one before.  Raises
    ValueError on what is no record, has no length or is cut off.
    """
    n = 0
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record after record {n}")
        headers: Headers = []
        while (line := stream.readline()) != CRLF:
            if not line:
                raise ValueError(f"the head of record {n + 1} is cut off")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                headers.append((name.strip(), value.strip()))
        length = first(headers, "Content-Length") or ""
        if not (length.isascii() and length.isdigit()):
            raise ValueError(f"record {n + 1} has no length")
        block = stream.read(int(length))
        if len(block) < int(length):
            raise ValueError(f"record {n + 1} is cut off")
        n += 1
        yield headers, block


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Records of an uncompressed WARC file in memory; see ``records``."""
    return records(io.BytesIO(data))


def first(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


class _Text(HTMLParser):
    """Text and line ends (None); those of silent elements go when the element ends.

    An element that is never closed is silent as far as HTML lets it reach: a head
    to the body, a script or style to the end.  The text after an unclosed noscript
    or template is not lost, as it may be all of the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str | None] = []
        self.silent: list[tuple[str, int]] = []

    def open(self, tag: str) -> None:
        self.silent.append((tag, len(self.out)))

    def end(self, at: int) -> None:
        """The silent element ``at`` ends, and all in it: line ends stay, text goes."""
        start = self.silent[at][1]
        self.out[start:] = [x for x in self.out[start:] if x is None]
        del self.silent[at:]

    def inner(self) -> str | None:
        return self.silent[-1][0] if self.silent else None

    def last(self, tag: str) -> int | None:
        return next((i for i in range(len(self.silent) - 1, -1, -1) if self.silent[i][0] == tag), None)

    def starts(self, tag: str) -> None:
        """End what cannot hold the element."""
        if self.inner() == "title" and self.last("head") is not None:
            self.end(len(self.silent) - 1)
        if self.inner() == "svg" and tag in NOT_SVG:
            self.end(len(self.silent) - 1)
        head = self.last("head")
        if head is not None and (tag == "body" or self.inner() == "head" and tag not in HEAD):
            self.end(head)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.starts(tag)
        if tag in SILENT or tag in FOREIGN and self.last("svg") is not None:
            self.open(tag)
        elif tag in BREAKS:
            self.out.append(None)
            if tag == "title" and self.inner() == "head":
                self.open(tag)

    def handle_endtag(self, tag: str) -> None:
        at = self.last(tag)
        if at is not None and tag in FOREIGN:
            del self.silent[at:]  # their text goes with the svg
        elif at is not None:
            self.end(at)
        if tag in BREAKS:
            self.out.append(None)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.starts(tag)
        if tag in BREAKS:
            self.out.append(None)

    def handle_data(self, data: str) -> None:
        if self.inner() == "head" and data.strip():
            self.end(len(self.silent) - 1)
        self.out.append(data)

    def text(self) -> str:
        stop = len(self.out)
        for tag, start in reversed(self.silent):
            if tag in ("head", "title", "script", "style"):
                self.out[start:stop] = [x for x in self.out[start:stop] if x is None]
            stop = start
        self.silent = []
        return "".join("\n" if x is None else x for x in self.out)


def plain_text(html: str) -> str:
    """Visible text: white space folded, a line for each block, no empty lines."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in parser.text().split("\n"))
    return "\n".join(x for x in lines if x)


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload of a response block."""
    head, found, payload = block.partition(CRLF + CRLF)
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("iso-8859-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def _record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def derivatives(headers: Headers, block: bytes) -> list[tuple[str, Headers, bytes]]:
    """(type, headers, block) of the two records derived from a response."""
    source = first(headers, "WARC-Record-ID") or _record_id("response", digest(block))
    status, http, payload = split_http(block)
    kind = first(http, "Content-Type") or "application/octet-stream"
    charset = (re.search(r"charset=[\"']?([\w.:-]+)", kind) or [None, "utf-8"])[1]
    try:
        text = payload.decode(charset, "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    body = plain_text(text) if "html" in kind.lower() else text
    payload_digest = first(headers, "WARC-Payload-Digest") or digest(payload)
    kept = [(k, v) for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address") if (v := first(headers, k)) is not None]
    facts = [("source-record", source), ("source-block-digest", first(headers, "WARC-Block-Digest") or digest(block)), ("source-payload-digest", payload_digest), ("source-length", str(len(block))), ("http-status", status), *((f"http-{k.lower()}", v) for k, v in http), ("charset", charset), ("text-digest", digest(body.encode("utf-8", "surrogatepass"))), ("text-length", str(len(body)))]
    fields = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in facts).encode("utf-8", "surrogatepass")
    out = []
    for what, content, data in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", body.encode("utf-8", "surrogatepass"))):
        own = [("WARC-Type", what), ("WARC-Record-ID", _record_id(what, source)), ("WARC-Refers-To", source), *kept, ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(data)), ("Content-Type", content)]
        out.append((what, own, data))
    return out


def page_response(page_id: object, url: str | None, html: str | None, date: str) -> tuple[Headers, bytes]:
    """The response record of a crawled page."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", _record_id("response", str(page_id), url or "", digest(block)))]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return headers, block


SCHEMA = "type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, length long, content string, record binary"


def _row(what: str, headers: Headers, block: bytes) -> tuple:
    return what, first(headers, "WARC-Record-ID"), first(headers, "WARC-Refers-To"), first(headers, "WARC-Target-URI"), first(headers, "WARC-Source-Payload-Digest"), first(headers, "WARC-Block-Digest"), len(block), block.decode("utf-8", "replace"), render(headers, block)


def _batch(of: list[int], rows: list[tuple], source: pa.Array, name: str) -> pa.RecordBatch:
    types = [pa.int64() if c.endswith(" long") else pa.binary() if c.endswith(" binary") else pa.string() for c in SCHEMA.split(", ")]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([source.take(pa.array(of, pa.int64())), *columns], [name, *(c.split()[0] for c in SCHEMA.split(", "))])


def derive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", most: int = 8 << 20) -> DataFrame:
    """Two rows for every page: its metadata and its conversion record.

    A null url leaves out the target; a null or empty page has an empty payload and
    text; a page of any length is one record.  Repeated rows give equal records each
    (same ids); null keys stay null; an empty table gives no rows; other columns are
    left out, so their names cannot clash.  About ``most`` bytes of records are handed
    over at a time.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows, size = [], [], 0
            for i, (k, u, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "u", "h")))):
                for d in derivatives(*page_response(k, u, h, date)):
                    of.append(i)
                    rows.append(_row(*d))
                    size += len(rows[-1][-1])
                if size >= most:
                    yield _batch(of, rows, batch.column("k"), "k")
                    of, rows, size = [], [], 0
            yield _batch(of, rows, batch.column("k"), "k")

    own = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    return own.mapInArrow(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)


def derive_warc(files: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Derivatives of all responses in WARC files read with ``binaryFile`` (path, content; gzip too).

    Records of other types give no rows; a file of several gzip members is one stream,
    unpacked a record at a time; an empty or null file gives no rows.  What comes before
    a damaged record counts; the damage is a row of its own, of type ``damaged``, whose
    content says what is wrong.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows, size = [], [], 0
            for i, data in enumerate(batch.column("content").to_pylist()):
                data = data or b""
                stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                found = records(stream)
                while True:
                    try:
                        headers, block = next(found)
                    except StopIteration:
                        break
                    except (ValueError, EOFError, OSError, zlib.error) as wrong:
                        of.append(i)
                        rows.append(("damaged", None, None, None, None, None, 0, str(wrong), None))
                        break
                    if first(headers, "WARC-Type") != "response":
                        continue
                    for d in derivatives(headers, block):
                        of.append(i)
                        rows.append(_row(*d))
                        size += len(rows[-1][-1])
                    if size >= most:
                        yield _batch(of, rows, batch.column("path"), "path")
                        of, rows, size = [], [], 0
            yield _batch(of, rows, batch.column("path"), "path")

    return files.select("path", "content").mapInArrow(run, f"path string, {SCHEMA}")

"""WARC derivatives (operator 8): responses become linked metadata records and plain-text conversion records.

Records are those of WARC/1.1 (ISO 28500). A conversion names the response it comes from in
WARC-Refers-To, with its target, date, source headers and digests; a metadata record carries the
links of the page. Each response is treated where it is read: no shuffle, memory by the batch. A page is scanned once from left
to right and every character is consumed once, so the time is linear in its size, whatever is left open in it.
A record that cannot be read gives a row that says why and stops no job.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_bytes, arrow_texts, slices

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 4122
#: Elements that start a line of their own, those whose content is not text, those a head may hold, and those with links.
BLOCK_TAGS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split())
SILENT_TAGS = frozenset("script style noscript template title".split())
HEAD_TAGS = frozenset("title meta link script style base noscript template".split())
LINK_TAGS = frozenset("a area img link script iframe".split())
#: A comment, a tag or another declaration. Each alternative ends at the text's end at the latest and gives nothing back, so none is scanned twice.
MARKUP = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
MOST_BYTES = 256 << 20  # of a page after its content encoding is undone


class WarcError(ValueError):
    """Bytes that are not a WARC record."""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, uri: str, payload: bytes) -> str:
    """The same for the same content, so that a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {uri} {digest(payload)}')}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return " ".join(value.split()) if re.search(r"[\r\n]", value) else value


class Headers:
    """Header fields in order; names match in any case, and a name may come repeatedly."""

    def __init__(self, lines: list[str]):
        self.fields: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in (" ", "\t") and self.fields:  # a folded line
                self.fields[-1] = (self.fields[-1][0], f"{self.fields[-1][1]} {line.strip()}")
            elif line:
                name, _, value = line.partition(":")
                self.fields.append((name.strip(), value.strip()))

    def get(self, name: str, default: str = "") -> str:
        return next((v for k, v in self.fields if k.lower() == name.lower()), default)

    def all(self, name: str) -> list[str]:
        return [v for k, v in self.fields if k.lower() == name.lower()]

    __getitem__ = get


def read_record(record: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record; WarcError if it is cut off or longer than it says."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC record")
    headers = Headers(lines[1:])
    length = headers.get("Content-Length")
    if not re.fullmatch("[0-9]{1,18}", length) or rest[int(length) :] != b"\r\n\r\n":
        raise WarcError("the block's length is not the one stated")
    return headers, rest[: int(length)]


def agrees(told: str, *stretches: bytes) -> bool:
    """Whether a labelled digest, in base 32 or hexadecimal, is that of one of the stretches; digests of algorithms not known here are believed."""
    label, _, value = told.partition(":")
    if label.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return True
    made = [hashlib.new(label.lower(), x).digest() for x in stretches]
    return value.lower() in [m.hex() for m in made] or value.upper().rstrip("=") in [base64.b32encode(m).decode().rstrip("=") for m in made]


def joined_chunks(body: bytes) -> bytes:
    """A body without its chunked transfer encoding."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(b"[0-9a-fA-F]{1,8}", size):
            raise WarcError("a chunk without a size")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end + 2 + n > len(body):
            raise WarcError("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def inflated(body: bytes, encoding: str) -> bytes:
    if encoding not in ("gzip", "x-gzip", "deflate"):
        raise WarcError(f"content encoding {encoding!r} is not known")
    for bits in (47, -15) if encoding == "deflate" else (47,):
        z = zlib.decompressobj(bits)
        try:
            out = z.decompress(body, MOST_BYTES)
        except zlib.error:
            continue
        if z.unconsumed_tail:
            raise WarcError("the page is too large when unpacked")
        return out
    raise WarcError("the content encoding is broken")


def page_text(http: Headers, body: bytes) -> str:
    """The characters of an HTTP body: transfer and content encodings undone, decoded by the charset that its header or its first bytes state, else UTF-8."""
    if "chunked" in http.get("Transfer-Encoding").lower():
        body = joined_chunks(body)
    for encoding in reversed([e.strip().lower() for v in http.all("Content-Encoding") for e in v.split(",") if e.strip()]):
        body = body if encoding == "identity" else inflated(body, encoding)
    stated = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", http.get("Content-Type"), re.I) or re.search(r"<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", body[:1024].decode("latin-1"), re.I)
    try:
        return body.decode(stated[1] if stated else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def response_record(uri: str, page: bytes, date: str = "1970-01-01T00:00:00Z") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(page)).encode() + b"\r\n\r\n"
    block = http + page
    return write_record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", uri, page)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(page))], block)


@dataclass
class Seen:
    """What one pass over a page finds: its text with line breaks at block elements, (element, attribute, value) of its links, and its title."""

    parts: list[str] = field(default_factory=list)
    links: list[tuple[str, str, str]] = field(default_factory=list)
    title: str = ""


def scan(page: str) -> Seen:
    out, at, in_head = Seen(), 0, False
    parts, match = out.parts, MARKUP.search
    while m := match(page, at):
        begin, (closing, name, attributes) = m.start(), m.groups()
        if begin > at and not in_head:
            parts.append(page[at:begin])
        at = m.end()
        if name is None:
            continue
        name = name.lower()
        if name == "head":
            in_head = not closing
        elif in_head and name not in HEAD_TAGS:
            in_head = False
        if name in BLOCK_TAGS:
            parts.append("\0")
        if closing:
            continue
        if name in LINK_TAGS and attributes:
            for a in ATTRIBUTE.finditer(attributes):
                if a[1].lower() in ("href", "src") and (value := a[2] or a[3] or a[4]):
                    out.links.append((name, a[1].lower(), value))
        if name in SILENT_TAGS:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            if name == "title" and not out.title:
                out.title = " ".join(html.unescape(page[at : end.start() if end else len(page)]).split())
            at = end.end() if end else len(page)
            parts.append("\0" if name in BLOCK_TAGS else "")
    if not in_head:
        parts.append(page[at:])
    return out


def _lines(parts: list[str]) -> str:
    # Source line breaks are spaces, those of block elements, marked by a character that no HTML text holds, are kept.
    text = html.unescape("".join([p if p == "\0" else p.replace("\0", "\ufffd") for p in parts]))
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\0")) if line)


def plain_text(page: str) -> str:
    """The text of a page: no markup, comments, scripts or head; block elements start lines; white space runs become one space, empty lines go."""
    return _lines(scan(page).parts)


def _absolute(found: list[tuple[str, str, str]], base: str) -> list[tuple[str, str]]:
    out: dict[tuple[str, str], None] = {}
    for name, attribute, raw in found:
        raw = html.unescape(raw).strip()
        try:
            full = urldefrag(urljoin(base, raw))[0]
        except ValueError:  # an address that is none
            full = raw
        if full:
            out[f"{name.upper()}@/{attribute}", full] = None
    return list(out)


def links(page: str, base: str) -> list[tuple[str, str]]:
    """(element/attribute, absolute address without fragment) in the page's order, each once."""
    return _absolute(scan(page).links, base)


def derive(record: bytes) -> tuple[bytes, bytes]:
    """The metadata record and the conversion record of a response record."""
    headers, block = read_record(record)
    head, sep, page = block.partition(b"\r\n\r\n")
    if headers.get("WARC-Type").lower() != "response" or not sep:
        raise WarcError("no response with HTTP headers")
    uri, source = headers.get("WARC-Target-URI"), headers.get("WARC-Record-ID")
    lines = head.decode("latin-1").split("\r\n")
    http = Headers(lines[1:])
    told, told_block = headers.get("WARC-Payload-Digest"), headers.get("WARC-Block-Digest")
    chunked = "chunked" in http.get("Transfer-Encoding").lower()
    if told and not agrees(told, page, *([joined_chunks(page)] if chunked else [])):
        raise WarcError("the payload does not have the digest stated")
    if told_block and not agrees(told_block, block):
        raise WarcError("the block does not have the digest stated")
    seen = scan(page_text(http, page))
    fields = [("title", seen.title), ("source-status", lines[0])]
    fields += [("source-header", f"{k}: {v}") for k, v in http.fields]
    fields += [("outlink", f"{to} {where}") for where, to in _absolute(seen.links, uri)]
    shared = [("WARC-Date", headers.get("WARC-Date")), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Source-Payload-Digest", told or digest(page)), ("WARC-Source-Block-Digest", told_block or digest(block))]
    plain = _lines(seen.parts).encode("utf-8", "replace")
    conversion_id = record_id("conversion", uri, page)
    body = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    metadata = write_record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", uri, page)), *shared, ("WARC-Concurrent-To", conversion_id), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(body))], body)
    conversion = write_record([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *shared, ("WARC-Source-Content-Type", http.get("Content-Type")), ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(plain)), ("WARC-Payload-Digest", digest(plain))], plain)
    return metadata, conversion


RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_digest", pa.string()), ("record", pa.binary()), ("error", pa.string())])
RECORDS_DDL = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, source_digest string, record binary, error string"


def responses(pages: DataFrame) -> DataFrame:
    """page_id and record: a response record of each row of pages (page_id, url, html). Null url or html is empty; repeated rows give equal records; other columns are ignored."""
    schema = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                rows = [response_record(u, p) for u, p in zip(arrow_texts(b.column("url")), arrow_bytes(b.column("html")), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(rows, pa.binary())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response record (page_id, record): metadata and conversion, with their main headers as columns and the record's bytes.

    A row that is no response, is null, or does not have the digest it states gives one row instead: record_type `rejected`,
    the reason in error, the other columns null. A page without text gives a conversion of length 0. An empty table has no rows.
    """

    def described(page_id: int | None, out: bytes) -> tuple:
        h, _ = read_record(out)
        return (page_id, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["Content-Type"], int(h["Content-Length"]), h["WARC-Block-Digest"], h["WARC-Source-Payload-Digest"], out, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "record"):
                rows = []
                for page_id, record in zip(b.column("page_id").to_pylist(), b.column("record").to_pylist(), strict=True):
                    try:
                        rows += [described(page_id, out) for out in derive(record or b"")]
                    except WarcError as e:
                        rows.append((page_id, "rejected", *[None] * 8, str(e)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORDS.types, strict=True)], schema=RECORDS)

    return records.mapInArrow(run, RECORDS_DDL)


def derivative_digest(rows: DataFrame) -> DataFrame:
    """The rows with the record replaced by its size and checksum."""
    return rows.select(*[c for c in RECORDS.names if c != "record"], F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))

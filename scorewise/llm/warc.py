"""WARC derivatives: metadata and plain-text conversion records of responses.

``responses`` wraps pages as WARC response records.  ``derivatives`` reads
response records and makes two records of each: a ``metadata`` record with the
source's headers, title, language and links, and a ``conversion`` record with
the page as plain text.  Both name the response in WARC-Refers-To, keep its
target and date, and carry digests of their own blocks; the metadata record
keeps the digest of the source's payload.  Record ids follow from content, so
a task that runs again makes the same records.  All work is maps over rows.

Defined results: a null page is an empty payload; a null url gives a record
without WARC-Target-URI; a record that is null, empty, not a response or
broken gives no derivatives; equal pages give equal records; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm.common import pieces, table

VERSION = "WARC/1.1"
#: The tables hold no time of capture: responses made from pages bear this one.
NO_DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs
# HTML elements whose content is no text, and those that start a new line.
_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>", re.S | re.I)
_BLOCK = re.compile(
    r"<(?:/?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b|br\b)[^>]*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n\s*")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(parts))}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a record, None if it is broken."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    return headers, rest[: int(size)]


def plain_text(page: str) -> str:
    """The page's text: a line for each block, blanks joined."""
    text = _TAG.sub("", _BLOCK.sub("\n", _SILENT.sub("", page.replace("\n", " "))))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text) if "&" in text else text)).strip()


def response_record(page_id, url: str | None, page: str | None, date: str = NO_DATE) -> tuple[str, bytes]:
    payload = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    rid = record_id("response", str(page_id), url or "", sha1(payload))
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    headers += [("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(http + payload)), ("Content-Type", "application/http; msgtype=response")]
    return rid, record(headers, http + payload)


def derive(raw: bytes) -> list[tuple[str, str, str, bytes, str]]:
    """(type, id, refers to, record, text or fields) of a response's two derivatives."""
    got = parse(raw)
    if got is None or got[0].get("warc-type") != "response" or "warc-record-id" not in got[0]:
        return []
    headers, block = got
    source = headers["warc-record-id"]
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("utf-8", "replace").split("\r\n")
    page = payload.decode("utf-8", "replace")
    common = [("WARC-Refers-To", source), ("WARC-Date", headers.get("warc-date", NO_DATE))]
    if "warc-target-uri" in headers:
        common.append(("WARC-Target-URI", headers["warc-target-uri"]))
        common.append(("WARC-Refers-To-Target-URI", headers["warc-target-uri"]))
    common.append(("WARC-Refers-To-Date", headers.get("warc-date", NO_DATE)))
    digest = sha1(payload)
    fields = [("via-status", _one_line(status)), ("payload-digest", digest), ("source-digest-ok", str(headers.get("warc-payload-digest", digest) == digest).lower())]
    fields += [("http-" + k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    if m := _LANG.search(page):
        fields.append(("lang", m[1]))
    if m := _TITLE.search(page):
        fields.append(("title", _one_line(html.unescape(m[1]))))
    fields += [("outlink", _one_line(html.unescape(a or b or c))) for a, b, c in _LINK.findall(page)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = plain_text(page).encode()
    out = []
    for kind, body, mime in (("metadata", about, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        rid = record_id(kind, source, sha1(body))
        own = [("WARC-Type", kind), ("WARC-Record-ID", rid), *common, ("WARC-Block-Digest", sha1(body)), ("Content-Type", mime)]
        if kind == "metadata":
            own.append(("WARC-Payload-Digest", digest))
        out.append((kind, rid, source, record(own, body), body.decode()))
    return out


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """(page_id, record binary) of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "html"):
                made = [response_record(i, u, h, date)[1] for i, u, h in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(made, pa.binary())], ["page_id", "record"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, record binary")


def derivatives(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, type, record_id, refers_to, record binary, content): two rows per response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "record"):
                out = [(i, *d) for i, raw in zip(part.column(0).to_pylist(), part.column("record").to_pylist()) if raw for d in derive(raw)]
                columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((part.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "type", "record_id", "refers_to", "record", "content"])

    kind = dict(records.dtypes)[id_col]
    schema = f"{id_col} {kind}, type string, record_id string, refers_to string, record binary, content string"
    return records.select(id_col, "record").mapInArrow(run, schema)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of all pages' responses, with digests of the records and their contents."""
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.select(
        "page_id",
        "type",
        "record_id",
        "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"),
        F.sha2("record", 256).alias("record_sha256"),
        F.length("content").cast("long").alias("content_chars"),
        F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"),
    )

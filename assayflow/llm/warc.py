"""WARC derivatives: linked metadata and plain-text conversion records from responses."""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import id_back, id_text

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
# HTML elements whose text is not content, and those that end a line.
HIDDEN = frozenset("script style template noscript title head".split())
BLOCK = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
SCHEMA = (
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "refers_to_digest string, refers_to_block_digest string, block_digest string, content_length long, record binary, body string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: object) -> str:
    """A record id that the parts fix, so that reruns and retried tasks agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes. Line breaks in header values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and (name, value) fields of a header; continued lines are joined."""
    text = re.sub(r"\r?\n[ \t]+", " ", raw.decode("utf-8", "replace"))
    first, *rest = re.split(r"\r?\n", text)
    return first, [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in rest) if colon]


_blank_line = re.compile(rb"\r?\n\r?\n")


def split_head(data: bytes) -> tuple[bytes, bytes]:
    """What comes before and after the first blank line; line ends may lack their carriage return."""
    m = _blank_line.search(data)
    return (data[: m.start()], data[m.end() :]) if m else (data, b"")


def parse(record: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(version, headers, block) of a record. Without a readable length the block is all that follows."""
    head, rest = split_head(record)
    version, headers = fields(head)
    length = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isascii() and v.isdigit()), len(rest))
    return version, headers, rest[:length]


def dechunked(body: bytes) -> bytes:
    """The chunks together; a body that doesn't begin with a chunk as it is; what came before a chunk that can't be read."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        m = re.fullmatch(rb"\s*([0-9A-Fa-f]{1,15})\s*(;.*)?", body[at:end].rstrip(b"\r"), re.S)
        if not m:
            return b"".join(out) if out else body
        size = int(m[1], 16)
        if not size:
            break
        out.append(body[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(out) if out else body if at == 0 and not body.lstrip().startswith(b"0") else b""


def inflated(body: bytes, *windows: int) -> bytes | None:
    """All members of a gzip or deflate stream, by the first of zlib's window settings that fits; as far as a broken one goes; None if none fits."""
    for bits in windows:
        out, rest = [], body
        try:
            while rest:
                stream = zlib.decompressobj(bits)
                out.append(stream.decompress(rest))
                if not stream.eof or bits != 31:
                    break
                rest = stream.unused_data.lstrip(b"\0")
        except zlib.error:
            pass
        if out or not body:
            return b"".join(out)
    return None


def payload_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes | None]:
    """(status line, HTTP headers, payload as sent, payload decoded) of a response's block; decoded is None where the content encoding can't be read."""
    head, body = split_head(block)
    status, headers = fields(head)
    names = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in names.get("transfer-encoding", ""):
        body = dechunked(body)
    plain: bytes | None = body
    for kind in reversed([x.strip() for x in names.get("content-encoding", "").split(",")]):
        if plain is not None and kind not in ("", "identity", "none"):
            plain = inflated(plain, 31) if kind in ("gzip", "x-gzip") else inflated(plain, 15, -15) if kind == "deflate" else None
    return status, headers, body, plain


def text_of(payload: bytes, headers: list[tuple[str, str]]) -> tuple[str, str]:
    """The payload's text and its character set: that of the header, else of a meta element anywhere in it, else UTF-8."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    m = re.search(r"charset=\s*[\"']?([\w.:-]+)", kind, re.I)
    named = m[1] if m else ((m := _meta.search(payload)) and m[1].decode("ascii", "replace")) or "utf-8"
    try:
        if codecs.lookup(named)._is_text_encoding and codecs.lookup(named).name.replace("-", "_") not in ("undefined", "idna", "punycode", "unicode_escape", "raw_unicode_escape"):
            return payload.decode(named, "replace"), named.lower()
    except (LookupError, ValueError):  # unknown, or a codec that replaces nothing
        pass
    return payload.decode("utf-8", "replace"), "utf-8"


_meta = re.compile(rb"<meta[^<>]+?charset=\s*[\"']?([\w.:-]+)", re.I)


class Page(HTMLParser):
    """Title, language, links and text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.links, self.parts, self.hidden, self.in_title = "", "", [], [], [], False

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "html":
            self.lang = found.get("lang") or ""
        for name in ("href", "src"):
            if found.get(name) and tag in ("a", "area", "img", "link", "script", "iframe", "frame"):
                self.links.append((found[name], f"{tag}/@{name}"))
        self.in_title = tag == "title" or self.in_title
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden.clear()
        if tag in BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        if tag in BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden:
            self.parts.append(data)

    def parse_marked_section(self, i, report=1):
        """Sections of unknown kinds, as ``<![foo bar[``, are left out up to the next ``>``."""
        return self.rawdata.find(">", i) + 1 or -1

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def response(page_id: object, url: str, html: str, date: str = DATE) -> bytes:
    """A response record for a fetched page."""
    payload = html.encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return build(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", urn("response", page_id, url, digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def derive(record: bytes) -> list[tuple]:
    """The metadata and conversion rows of a response record; none of other records.

    Both refer to the response's id and keep its target, date and digests, as given or else
    computed. The metadata record lists all source headers, the page's title, language, character set
    and links; the conversion record holds the text alone.
    """
    _, headers, block = parse(record)
    given = {k.lower(): v for k, v in headers}
    if given.get("warc-type", "").lower() != "response":
        return []
    status, http, sent, plain = payload_of(block)
    text, charset = text_of(plain or b"", http)
    page = Page()
    try:
        page.feed(text)
        page.close()
    except (AssertionError, ValueError):  # markup that the parser gives up on: what came before it stays
        pass
    source, target, date = given.get("warc-record-id", ""), given.get("warc-target-uri", ""), given.get("warc-date", "")
    payload_digest, block_digest = given.get("warc-payload-digest") or digest(sent), given.get("warc-block-digest") or digest(block)
    conversion_id, metadata_id = urn("conversion", source, target, payload_digest), urn("metadata", source, target, payload_digest)
    clean = lambda x: " ".join(x.split())
    about = [("title", clean(page.title)), ("language", page.lang), ("charset", charset), ("http-status", status), ("conversion", conversion_id)]
    about += [("content-encoding-not-read", v) for k, v in http if plain is None and k.lower() == "content-encoding"]
    about += [(f"source-{k}", v) for k, v in headers] + [(f"http-{k}", v) for k, v in http]
    for link, how in page.links:
        try:
            about.append(("outlink", f"{urljoin(target, link.strip())} {how}"))
        except ValueError:
            about.append(("outlink", f"{link.strip()} {how}"))
    out = []
    for kind, own, content, body in (
        ("metadata", metadata_id, "application/warc-fields", "".join(f"{k}: {clean(v)}\r\n" for k, v in about)),
        ("conversion", conversion_id, "text/plain; charset=utf-8", page.text()),
    ):
        data = body.encode("utf-8", "replace")
        linked = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date),
            ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(data)), ("Content-Type", content), ("X-Source-Payload-Digest", payload_digest),
        ]
        out.append((kind, own, source, target, date, content, payload_digest, block_digest, digest(data), len(data), build(linked, data), data.decode()))
    return out


def derivatives(records: DataFrame, key_col: str = "key", record_col: str = "record") -> DataFrame:
    """Two rows per response in ``(key, record binary)``: the key and ``SCHEMA``.

    Null records and records of other types give none. Repeated records give equal ids. Chunked, gzip (of several members too) and
    deflate payloads (raw too) are decoded, broken ones as far as they go; a payload in another encoding has an empty text, and its metadata names the
    encoding. Unknown character sets count as UTF-8. Payloads are read whole, however long; null keys stay null. An empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                yield pd.DataFrame([(key, *row) for key, record in zip(part["id"], part["record"]) for row in derive(bytes(record))], columns=names)

    source = records.select(id_text(key_col), F.col(record_col).alias("record")).where("record is not null")
    return id_back(source.mapInPandas(run, f"id string, {SCHEMA}"), records, key_col)


def responses(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(id, record)``: a response record for each page; null urls and pages count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "record": [response(*x) for x in zip(batch["id"], batch["url"], batch["html"])]})

    source = pages.select(id_text(id_col), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return id_back(source.mapInPandas(run, "id string, record binary"), pages, id_col)


#: What separates records in a file, but for the line end before it.
MARK = b"WARC/1."


def assembled(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records from a file's pieces, which were cut at each line that begins with ``MARK``.

    A piece that ends before its record's length was cut inside the record's block, and the next one belongs to it. A record
    without a readable length ends where it was cut.
    """
    kept: list[bytes] = []
    size = need = 0
    for piece in pieces:
        if kept and size < need:
            kept.append(b"\n" + MARK + piece)
            size += len(kept[-1])
        else:
            if kept:
                yield b"".join(kept)
            piece = piece if piece.startswith(MARK) else MARK + piece
            m = _blank_line.search(piece)
            length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,15})[ \t]*\r?$", piece[: m.start()] if m else piece)
            kept, size, need = [piece], len(piece), m.end() + int(length[1]) if m and length else 0
    if kept:
        yield b"".join(kept)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record)`` of WARC files, plain or gzip (by the ending ``.gz``), one row per record.

    Files are read as a stream of records, so a task holds one record (2 GB at most) and not a file; plain files are split between tasks.
    A block that has a line beginning with ``WARC/1.`` just where a split of the file begins is cut there. An empty file has no records; bytes before the first record are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((file, bytes(piece)) for batch in batches for file, piece in zip(batch["file"], batch["piece"]))
        for file, group in itertools.groupby(rows, key=lambda x: x[0]):
            for record in assembled(piece for i, (_, piece) in enumerate(group) if i or is_record(piece)):
                yield pd.DataFrame({"file": [file], "record": [record]})

    def is_record(piece: bytes) -> bool:
        return re.match(rb"(WARC/1\.)?\d\r?\n", piece) is not None

    pieces = spark.read.option("lineSep", "\n" + MARK.decode()).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).where("length(piece) > 0").mapInPandas(run, "file string, record binary")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return derivatives(responses(pages), "page_id").drop("record")

"""WARC derivatives (operator 10): metadata and plain-text conversion records from response records.

Each response yields one ``metadata`` record (a JSON envelope with the source's WARC and HTTP headers, title, links and
digests; a header name that occurs again has the list of its values) and one ``conversion`` record (its visible text).  Both carry ``WARC-Refers-To`` with the response's record id, its
target URI and date, and digests of their own blocks; the response's payload digest goes into the envelope and, for the
conversion, into ``WARC-Source-Payload-Digest``.  Chunked, gzip (any number of members) and deflate payloads are decoded for text and
links; the envelope says what was decoded and marks what could not be, and what is no text, which has no conversion.  The encoding
is that of the text's mark, header or ``meta`` element.  Links are those of anchors, decoded and resolved.  Record ids are name-based UUIDs of the response's id, so a rerun,
or a task that is run again, writes the same records.  Records are independent: nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import pieces, read_table
from cellweave.llm.html_text import PageHead, blocks_of, markup_of
from cellweave.sources.shared import file_uri, materialise

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
_CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
#: What begins a text in one of these encodings.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: Bytes of a page in which a ``meta`` element may name its encoding.
META_BYTES = 1024
#: Content types, besides ``text/``, that have text of their own; a part after a plus sign counts.
TEXT_TYPES = {"application/xhtml+xml", "application/xml", "application/json", "application/javascript", "application/x-javascript"}

HEADERS = "array<struct<name: string, value: string>>"
_HEADER = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
RECORD_SCHEMA = f"warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, headers {HEADERS}, block binary"
_FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "Content-Length", "WARC-Block-Digest", "WARC-Payload-Digest")

Header = tuple[str, str]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(names))}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def serialise(headers: Iterable[Header], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


class _Reader:
    """Lines and blocks of a WARC file, plain or gzipped (as one member or one a record), read ``STEP`` bytes at a time."""

    STEP = 1 << 20

    def __init__(self, stream):
        self.stream, self.data, self.at = stream, b"", 0
        self.members, self.raw, self.ended = None, b"", False
        head = stream.read(2)
        if head == b"\x1f\x8b":
            self.members, self.raw = zlib.decompressobj(31), head
        else:
            self.data = head

    def _more(self) -> bool:
        while True:
            if self.members is None:
                fresh = self.stream.read(self.STEP)
                self.ended = not fresh
            else:
                if self.members.eof:  # the next member
                    left = self.members.unused_data
                    self.members, self.raw = zlib.decompressobj(31), left + self.raw
                if not self.raw:
                    self.raw = self.stream.read(self.STEP)
                    self.ended = not self.raw
                fresh = self.members.decompress(self.raw, self.STEP) if self.raw else b""
                self.raw = self.members.unconsumed_tail
                if not fresh and not self.ended:
                    continue
            self.data, self.at = self.data[self.at :] + fresh, 0
            return bool(fresh)

    def line(self) -> bytes:
        seen = 0
        while (end := self.data.find(b"\n", self.at + seen)) < 0:
            seen = len(self.data) - self.at
            if not self._more():
                end = len(self.data) - 1
                break
        out, self.at = self.data[self.at : end + 1], end + 1
        return out

    def take(self, n: int) -> bytes:
        parts, held = [], 0
        while True:
            part = self.data[self.at : self.at + n - held]
            self.at += len(part)
            parts.append(part)
            held += len(part)
            if held == n or not self._more():
                return b"".join(parts)


def parse(stream) -> Iterator[tuple[list[Header], bytes]]:
    """The records of a WARC file, given as a binary stream; no more than a record is held.  A cut last record is an error."""
    reader = _Reader(stream)
    while line := reader.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:20]!r}")
        headers: list[Header] = []
        while (line := reader.line()).strip():
            if line[:1] in b" \t" and headers:  # a folded line
                headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.decode("utf-8", "replace").strip())
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.append((name.strip(), value.strip()))
        length = int(_value(headers, "Content-Length") or "0")
        block = reader.take(length)
        if len(block) < length:
            raise ValueError("the last record is cut off")
        yield headers, block


def _value(headers: Iterable[Header], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _by_name(headers: Iterable[Header]) -> dict[str, str | list[str]]:
    """Each name's value, or the list of its values in their order if the name (as written) is repeated."""
    values: dict[str, list[str]] = {}
    for name, value in headers:
        values.setdefault(name, []).append(value)
    return {name: v[0] if len(v) == 1 else v for name, v in values.items()}


def split_http(block: bytes) -> tuple[str, list[Header], bytes]:
    """Status line, headers and payload of an HTTP response block; without a head, all of it is payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    m = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    lines = head.decode("utf-8", "replace").splitlines()
    return lines[0], [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:])], payload


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\n", at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else 0
        except ValueError:
            return data if not out else b"".join(out)  # not chunked after all, or damaged
        if not size:
            return b"".join(out)
        out.append(data[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] == b"\n"


def decoded(http: list[Header], payload: bytes) -> tuple[bytes, list[str], str | None]:
    """The payload without its transfer and content encodings, those undone, and the one that could not be (the rest is as it was).

    A body that is cut off or damaged is decoded as far as it goes.
    """
    undone = []
    codings = [x.strip().lower() for name in ("Content-Encoding", "Transfer-Encoding") for k, v in http if k.lower() == name.lower() for x in v.split(",")]
    for coding in reversed([x for x in codings if x and x != "identity"]):
        if coding == "chunked":
            payload = _unchunked(payload)
        elif coding in ("gzip", "x-gzip", "deflate"):
            found = next((x for bits in ((31,) if coding != "deflate" else (15, -15)) if (x := _inflated(payload, bits)) is not None), None)
            if found is None:
                return payload, undone, coding
            payload = found
        else:
            return payload, undone, coding
        undone.append(coding)
    return payload, undone, None


def _inflated(data: bytes, bits: int) -> bytes | None:
    """All members of a compressed body, as far as they go; none if it does not begin with one."""
    out: list[bytes] = []
    while data:
        machine = zlib.decompressobj(bits)
        try:
            out.append(machine.decompress(data))
        except zlib.error:
            return b"".join(out) if out else None
        if not machine.eof or machine.unused_data == data:
            break
        data = machine.unused_data
    return b"".join(out)


def media_type(http: list[Header]) -> str:
    return (_value(http, "Content-Type") or "").split(";")[0].strip().lower()


def has_text(kind: str) -> bool:
    """Whether a body of the content type is text; one without a type is taken for a page."""
    return not kind or kind.startswith("text/") or kind in TEXT_TYPES or kind.rpartition("+")[2] in ("xml", "json")


def text_of(http: list[Header], body: bytes) -> str:
    """The body's text: in the encoding of its first bytes' mark, else of the header, else of a ``meta`` element, else UTF-8."""
    named = next((name for mark, name in MARKS if body.startswith(mark)), None)
    if named is None:
        head = body[:META_BYTES].decode("latin-1")
        found = _CHARSET.search(_value(http, "Content-Type") or "") or next((m for _, tag, _, attributes in markup_of(head) if tag == "meta" and (m := _CHARSET.search(attributes))), None)
        named = found[1] if found else "utf-8"
    try:
        return body.decode(named, "replace")
    except (LookupError, ValueError):  # no such encoding, or not one of text
        return body.decode("utf-8", "replace")


def response(url: str, page: str, date: str = DATE, *names: str) -> tuple[list[Header], bytes]:
    """A response record for a page that was fetched without keeping its head."""
    payload = page.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", url, date, digest(payload), *names)),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Length", str(len(block))),
    ]
    return headers, block


def derivatives(headers: list[Header], block: bytes) -> list[tuple[list[Header], bytes]]:
    """The metadata and the conversion record of a response record; a body that is no text, or could not be decoded, has no conversion."""
    status, http, payload = split_http(block)
    source = _value(headers, "WARC-Record-ID") or record_id("unnamed", digest(block))
    uri, date = _value(headers, "WARC-Target-URI") or "", _value(headers, "WARC-Date") or DATE
    payload_digest = _value(headers, "WARC-Payload-Digest") or digest(payload)
    body, undone, left = decoded(http, payload)
    kind = media_type(http)
    readable = not left and has_text(kind)
    page = text_of(http, body) if readable else ""
    head = PageHead(uri)
    marks = head.watch(markup_of(page))
    if kind and "html" not in kind and "xml" not in kind:
        text, _ = page, list(marks)
    else:
        text = "\n".join(b.text for b in blocks_of(marks))
    envelope = {
        "WARC-Header-Metadata": _by_name(headers),
        "HTTP-Response-Metadata": {
            "Status": status,
            "Headers": _by_name(http),
            "Entity-Length": len(payload),
            "Entity-Digest": payload_digest,
            **({"Decoded": undone} if undone else {}),
            **({"Not-Decoded": left} if left else {}),
            **({} if has_text(kind) else {"Not-Text": kind}),
            "HTML-Metadata": {"Title": head.title, "Links": head.links},
        },
    }
    made = []
    text = text.encode("utf-8", "replace")
    described = json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")
    for kind, content_type, content in (("metadata", "application/json", described), ("conversion", "text/plain; charset=utf-8", text)):
        if kind == "conversion" and not readable:
            continue
        made.append(
            (
                [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", record_id(kind, source)),
                    ("WARC-Refers-To", source),
                    ("WARC-Target-URI", uri),
                    ("WARC-Date", date),
                    ("Content-Type", content_type),
                    ("WARC-Block-Digest", digest(content)),
                    ("WARC-Source-Payload-Digest", payload_digest),
                    ("Content-Length", str(len(content))),
                ],
                content,
            )
        )
    return made


def _batch(ids: list, id_type, records: list[tuple[list[Header], bytes]], id_name: str | None) -> pa.RecordBatch:
    columns, names = [], []
    if id_name:
        columns.append(pa.array(ids, id_type))
        names.append(id_name)
    named = [{name.lower(): value for name, value in reversed(h)} for h, _ in records]  # of a repeated name the first counts
    for field in _FIELDS:
        values = [n.get(field.lower()) for n in named]
        if field == "WARC-Payload-Digest":
            values = [v or n.get("warc-source-payload-digest") for v, n in zip(values, named, strict=True)]
        columns.append(pa.array([None if v is None else int(v) for v in values], pa.int64()) if field == "Content-Length" else pa.array(values, pa.string()))
    columns.append(pa.array([[{"name": n, "value": v} for n, v in h] for h, _ in records], _HEADER))
    columns.append(pa.array([b for _, b in records], pa.binary()))
    names += ["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", "headers", "block"]
    return pa.RecordBatch.from_arrays(columns, names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path`` (a file, folder or pattern), in ``RECORD_SCHEMA``.

    A task streams each of its files through a filesystem that pyarrow knows, and holds a few megabytes or one record.  Empty
    files have no records; a cut last record is an error.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, at = FileSystem.from_uri(file_uri(name))
                with store.open_input_stream(at, compression=None) as stream:
                    held, size = [], 0
                    for record in parse(stream):
                        held.append(record)
                        size += len(record[1])
                        if size > 8 << 20:
                            yield _batch([], None, held, None)
                            held, size = [], 0
                    yield _batch([], None, held, None)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(records, RECORD_SCHEMA)


def responses_from_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (with ``page_id``) for fetched pages; null urls and pages read as empty."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            rows = zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)
            records = [response(url or "", page or "", DATE, str(page_id)) for page_id, url, page in rows]
            yield _batch(part.column("page_id").to_pylist(), part.schema.field("page_id").type, records, "page_id")

    narrow = df.select(df[id_col].alias("page_id"), df[url_col].alias("url"), df[html_col].alias("html"))
    return narrow.mapInArrow(build, f"page_id {narrow.schema['page_id'].dataType.simpleString()}, {RECORD_SCHEMA}")


def build_derivatives(records: DataFrame, id_col: str | None = None) -> DataFrame:
    """Two records (``RECORD_SCHEMA``, after ``id_col`` if given) for every row of type ``response``, or the metadata alone where the body
    has no text to convert; other types give none.

    Null headers or blocks read as empty; blocks of any length are taken whole.  Repeated rows give repeated, equal records; an
    empty table gives none.  Other columns are not read, whatever their names.
    """
    names = ([id_col] if id_col else []) + ["headers", "block"]

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "block"):
            ids = part.column(id_col).to_pylist() if id_col else [None] * part.num_rows
            out_ids, out = [], []
            for ident, headers, block in zip(ids, part.column("headers").to_pylist(), part.column("block").to_pylist(), strict=True):
                made = derivatives([(h["name"], h["value"]) for h in headers or ()], block or b"")
                out += made
                out_ids += [ident] * len(made)
            yield _batch(out_ids, part.schema.field(id_col).type if id_col else None, out, id_col)

    prefix = f"`{id_col}` {records.schema[id_col].dataType.simpleString()}, " if id_col else ""
    return records.where("warc_type = 'response'").select(*names).mapInArrow(derive, prefix + RECORD_SCHEMA)


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Write the records as gzipped WARC files, one for each partition, into the folder ``path``, which all executors see; their
    names with the number of records.

    A member a record, in the partition's order.  A file gets its name when it is whole, so a task that is run again replaces
    what it left and nothing is written twice; an empty partition makes no file.  Nothing goes through the driver but names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = FileSystem.from_uri(file_uri(path))
        store.create_dir(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        draft = f"{folder}/.{name}.{task.taskAttemptId()}"
        n = 0
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for headers, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist(), strict=True):
                    out.write(gzip.compress(serialise([(h["name"], h["value"]) for h in headers or ()], block or b""), mtime=0))
                    n += 1
        if n:
            store.move(draft, f"{folder}/{name}")
        else:
            store.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([name] * bool(n), pa.string()), pa.array([n] * bool(n), pa.int64())], ["file", "records"])

    return materialise(records.select("headers", "block").mapInArrow(write, "file string, records long"), "written")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all ``pages``."""
    return build_derivatives(responses_from_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html")), "page_id")

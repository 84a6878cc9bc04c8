"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response becomes two records that point back to it.  A metadata record
(application/warc-fields) keeps the response's HTTP status and headers, its digests
and its length; a conversion record holds the plain text of an HTML or text body.
Both carry WARC-Refers-To with the source's record id, its target URI and date, and
digests of their own blocks.  Record ids are name-based on the source's id, so the
same response gives the same records on every run and after a lost executor.

``parse`` reads records from the bytes of a WARC file, plain or gzip, one record per
member or not; ``serialise`` writes one.  ``read_records`` streams the files of a
folder, one record in memory at a time.

Defined cases.  A null or empty html is a response with an empty body: its metadata
record says so and its conversion is empty.  A null url is an empty target URI; line
ends and other control characters of a url are percent-encoded.  A null page id is
written as such in the record id's name.  A null record gives nothing.  Repeated rows
give equal records; ties cannot arise.  An empty table gives an empty one.  Only the
columns named are read and passed on, so others may have any name.  A text of any
length is converted whole, in time linear in its length.  A response without an HTTP
head keeps its whole block as the body.  A body whose type isn't text has no
conversion.  A damaged record (a length that is no number or beyond the data, a
gzip member that does not inflate) is left out of ``parse`` and the next one is looked
for; ``read_records`` returns a row with its problem.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

SLICE_BYTES = 2 << 20
VERSION = "WARC/1.1"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*+>|\Z)", re.S | re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|aside|blockquote|pre|title|form|figure|dd|dt)|br)\b" + tx.TAG_REST, re.I)
_TAG = re.compile(r"<[a-zA-Z/!?]" + tx.TAG_REST)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def digest(block: bytes) -> str:
    """``sha1:`` and the base32 form, as WARC writers use."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, name)}>"


def serialise(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; the length field is added last."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def inflate(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members in pieces; a member that is damaged ends there and the next is looked for."""
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        member, start = zlib.decompressobj(31), at
        try:
            while at < len(data) and not member.eof:
                piece = view[at : at + 65536]
                at += len(piece)
                yield member.decompress(piece)
                at -= len(member.unused_data)
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", start + 1)


def fields_of(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names lower-cased, without its version line."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode(errors="replace").strip().lower()] = value.decode(errors="replace").strip()
    return out


def length_of(fields: dict[str, str]) -> int | None:
    """The block's length, or None if what is given is no number."""
    text = fields.get("content-length", "0")
    return int(text) if re.fullmatch(r"[0-9]{1,18}", text) else None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields (names lower-cased) and block of each record that is whole."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(inflate(data))
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        if data.startswith(b"WARC/", at):
            fields = fields_of(data[at:end])
            size = length_of(fields)
            if size is not None and end + 4 + size <= len(data):
                yield fields, data[end + 4 : end + 4 + size]
                at = end + 4 + size
                continue
        at = data.find(b"\r\n\r\nWARC/", at)  # damaged: go on with what looks like the next
        if at < 0:
            return


def plain_text(source: str) -> str:
    """Visible text: no scripts, styles or comments, a line per block, spaces merged."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", source)))
    return _LINES.sub("\n", _SPACE.sub(" ", tx.unescape(text))).strip()


def response(page_id: object, url: str | None, body: str | None, date: str) -> bytes:
    """A response record of a stored page."""
    url = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    payload = (body or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id(f"{page_id}|{url}|response|{date}")),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
    ]
    return serialise(fields, block)


def derive(fields: dict[str, str], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata record and, for text, the conversion record of a response."""
    head, cut, payload = block.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"HTTP/"):
        head, payload = b"", block
    lines = head.decode(errors="replace").split("\r\n")
    headers = [tuple(" ".join(x.split()) for x in line.split(":", 1)) for line in lines[1:] if ":" in line]
    kind = next((v for k, v in headers if k.lower() == "content-type"), fields.get("content-type", "")).lower()
    source = fields.get("warc-record-id", "")
    common = [
        ("WARC-Target-URI", fields.get("warc-target-uri", "")),
        ("WARC-Date", fields.get("warc-date", "")),
        ("WARC-Refers-To", source),
        ("WARC-Refers-To-Target-URI", fields.get("warc-target-uri", "")),
        ("WARC-Refers-To-Date", fields.get("warc-date", "")),
    ]
    notes = [("source-status", lines[0])] if head else []
    notes += [(f"source-header-{k.lower()}", v) for k, v in headers]
    notes += [(f"source-{k.removeprefix('warc-')}", fields[k]) for k in ("warc-payload-digest", "warc-block-digest", "content-length") if k in fields]
    verified = digest(payload) == fields.get("warc-payload-digest") if "warc-payload-digest" in fields else None
    notes.append(("source-payload-length", str(len(payload))))
    if verified is not None:
        notes.append(("source-payload-digest-verified", str(verified).lower()))
    note = "".join(f"{k}: {v}\r\n" for k, v in notes).encode()
    out = [([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(source + "|metadata")), *common, ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(note))], note)]
    if not kind or kind.startswith("text/") or "html" in kind:
        charset = re.search(r"charset=\"?([\w-]+)", kind)
        try:
            body = payload.decode(charset[1] if charset else "utf-8", errors="replace")
        except LookupError:
            body = payload.decode(errors="replace")
        text = (plain_text(body) if "html" in kind or not kind else body).encode()
        out.append(([("WARC-Type", "conversion"), ("WARC-Record-ID", record_id(source + "|conversion")), *common, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(text))], text))
    return out


_OUT = "source_id string, record_id string, type string, target_uri string, date string, refers_to string, block_digest string, source_payload_digest string, content_length long, record binary"


def _responses(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, "html", SLICE_BYTES):
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([response(*r, date) for r in rows], pa.binary())], ["page_id", "record"])


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``(page_id, record)``: stored pages as response records. The capture date is a parameter."""
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: tx.lean(_responses(it, date)), "page_id long, record binary")


def _derivatives(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    names = [*keys, *(x.split()[0] for x in _OUT.split(", "))]
    for batch in tx.text_slices(batches, "record", SLICE_BYTES):
        at: list[int] = []
        rows: list[tuple] = []
        for i, data in enumerate(batch.column("record").to_pylist()):
            for fields, block in parse(data or b""):
                if fields.get("warc-type") != "response":
                    continue
                for made, text in derive(fields, block):
                    f = dict(made)
                    at.append(i)
                    rows.append((fields.get("warc-record-id"), f["WARC-Record-ID"], f["WARC-Type"], f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Refers-To"], f["WARC-Block-Digest"], fields.get("warc-payload-digest"), len(text), serialise(made, text)))
        if rows:
            kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]
            made_columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in keys), *made_columns], names)


def derivatives(records: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The derivative records of a ``record`` column, with the columns ``keys`` of their rows."""
    slim = records.select(*keys, "record")
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "record")
    return slim.mapInArrow(lambda it: tx.lean(_derivatives(it, list(keys))), f"{given}, {_OUT}" if given else _OUT)


def write_records(records: DataFrame, path: str) -> None:
    """Write text records as gzip WARC files, one per task: each ends with the empty lines that part records."""
    text = F.regexp_replace(F.col("record").cast("string"), r"\r\n\r\n\z", "")
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from what lies between separators; a block that holds separators is put together again."""
    held, source = b"", None  # a record that still lacks some of its block
    names = ["file", "record_id", "type", "refers_to", "block", "problem"]
    kinds = [pa.string()] * 4 + [pa.binary(), pa.string()]

    def rows(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    def record(piece: bytes, file: str | None, last: bool) -> tuple | None:
        head, cut, block = piece.partition(b"\r\n\r\n")
        fields = fields_of(head)
        size = length_of(fields)
        if cut and size is not None and len(block) < size and not last:
            return None
        named = [fields.get(k) for k in ("warc-record-id", "warc-type", "warc-refers-to")]
        if not cut or size is None or len(block) < size:
            return (file, *named, None, "no head" if not cut else "no length" if size is None else "cut short")
        return (file, *named, block[:size], None)

    for batch in tx.text_slices(batches, "content", SLICE_BYTES):
        out = []
        for file, piece in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if held and file != source:
                out.append(record(held, source, True))
                held = b""
            if held:
                piece = held + SEPARATOR.encode() + piece
            elif not piece.strip():
                continue
            made = record(piece, file, False)
            held, source = (piece, file) if made is None else (b"", None)
            if made is not None:
                out.append(made)
        if out:
            yield rows(out)
    if held:
        yield rows([record(held, source, True)])


#: What stands between the records of a file.
SEPARATOR = "\r\n\r\nWARC/"


def read_records(spark, path: str) -> DataFrame:
    """``(file, record_id, type, refers_to, block, problem)`` of all WARC files in a folder.

    Files are read as text parted by what ends a record and starts the next, so a plain
    file is split between tasks, a gzip file is inflated as a stream, and no more than a
    record is held.  A record that isn't whole has a ``problem`` and a null block; so has
    one with a separator inside its block just where two tasks meet in a plain file.
    """
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("content"))
    return pieces.mapInArrow(_read, "file string, record_id string, type string, refers_to string, block binary, problem string")


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    return gzip.compress(record, mtime=0)


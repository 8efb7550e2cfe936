"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Both derivatives name their source in WARC-Refers-To and keep its target, date and digests; the metadata record also
lists the source's HTTP status and headers. Record ids follow from the source's id and the kind of derivative, so a
repeated run gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, headers string, block binary, block_digest string, payload_digest string"
DATE = "2024-01-01T00:00:00Z"

#: Elements whose content is not text, and elements that begin a new line.
HIDDEN = "script|style|noscript|template|iframe|object|svg|math"
LINE = "address|article|aside|blockquote|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|select|table|td|th|title|tr|ul"

_TAG_BODY = r"""(?>[^<>"']+|"[^"<]*"|'[^'<]*')*+>"""
_MARKUP = re.compile(rf"(?is)<!--(?:.*?-->|.*)|<({HIDDEN})\b(?:{_TAG_BODY}|[^<>]*>?)(?:.*?</\1\s*>|.*)|<(/?[a-z][a-z0-9]*)\b(?:{_TAG_BODY}|[^<>]*>?)|<[!?/][^<>]*>?")
_LINE = re.compile(rf"(?i)/?(?:{LINE})\Z")
_TITLE = re.compile(r"(?is)<title\b[^<>]*>([^<]*)")
_LANG = re.compile(r"""(?i)<html\b[^<>]*?\blang\s*=\s*["']?([a-z0-9-]+)""")
_HREF = re.compile(r"""(?i)<a\b[^<>]*?\bhref\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'<>]+))""")
_CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([a-z0-9_-]+)")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


def html_text(page: str) -> str:
    """Visible text: markup and hidden elements out, a line per block element, entities resolved, white space folded."""
    out = _MARKUP.sub(lambda m: "\n" if m[2] and _LINE.match(m[2]) else ("" if m[2] else " "), page)
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(out).replace("\r", "\n"))).strip()


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response; without a header section everything is payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        head, mark, payload = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    pairs = [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines[1:]) if sep]
    return lines[0], pairs, payload


def decode_payload(payload: bytes, headers: list[tuple[str, str]]) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    named = _CHARSET.search(kind) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _clean(value: str) -> str:
    return " ".join(value.split())


def warc_header(fields: list[tuple[str, str | None]], length: int) -> str:
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in fields if v), f"Content-Length: {length}"]
    return "\r\n".join(lines) + "\r\n\r\n"


def derive_one(source_id: str, uri: str, date: str, block: bytes, payload_digest: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = split_http(block)
    page = decode_payload(payload, headers)
    title = _TITLE.search(page)
    lang = _LANG.search(page)
    links = [html.unescape(next(x for x in m.groups() if x is not None)) for m in _HREF.finditer(page)]
    text = html_text(page).encode()
    source_payload, source_block = payload_digest or digest(payload), digest(block)
    conversion_id = derived_id(source_id, "conversion")
    about = [
        ("source-block-digest", source_block),
        ("source-payload-digest", source_payload),
        ("conversion-record", conversion_id),
        ("http-status", status),
        *((f"http-header-{k.lower()}", v) for k, v in headers),
        ("title", html.unescape(title[1]) if title else ""),
        ("language", lang[1] if lang else ""),
        ("payload-bytes", str(len(payload))),
        ("text-bytes", str(len(text))),
        *(("outlink", x) for x in links),
    ]
    notes = "".join(f"{k}: {_clean(v)}\r\n" for k, v in about if _clean(v)).encode()
    out = []
    for kind, content_type, body in (("metadata", "application/warc-fields", notes), ("conversion", "text/plain; charset=utf-8", text)):
        own = conversion_id if kind == "conversion" else derived_id(source_id, kind)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source_id), ("WARC-Block-Digest", digest(body)), ("WARC-Source-Payload-Digest", source_payload), ("Content-Type", content_type)]
        out.append((own, kind, source_id, uri, date, content_type, warc_header(fields, len(body)), body, digest(body), source_payload))
    return out


_SCHEMA = pa.schema([(n.split()[0], pa.binary() if n.split()[1] == "binary" else pa.string()) for n in RECORD.split(", ")])


def _batch(rows: list[tuple], lead: list[pa.Array] | None = None, names: list[str] | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([*(lead or []), *(pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True))], [*(names or []), *_SCHEMA.names])


def _respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, body in zip(batch.column("_id").to_pylist(), batch.column("_url").to_pylist(), batch.column("_body").to_pylist(), strict=True):
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
            block, uri = head + body, url or ""
            own = derived_id(f"{page_id}|{uri}", "response")
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")]
            rows.append((own, "response", None, uri, DATE, "application/http; msgtype=response", warc_header(fields, len(block)), block, digest(block), digest(body)))
        yield _batch(rows, [batch.column("_id")], ["page_id"])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record per page, with the page's id beside it. Null pages are empty payloads, null urls empty ones."""
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("_body"))
    return src.mapInArrow(_respond, f"page_id {src.schema['_id'].dataType.simpleString()}, {RECORD}").withColumnRenamed("page_id", id_col)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, names = [], ("record_id", "target_uri", "date", "block", "payload_digest")
        keys = []
        for k, values in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
            source, uri, date, block, payload = values
            if source is None:
                continue
            rows += derive_one(source, uri or "", date or "", block or b"", payload)
            keys += [k, k]
        yield _batch(rows, [batch.column("_key").take(pa.array(keys, pa.int64()))], ["_key"])


def derivatives(records: DataFrame, key_col: str | None = None) -> DataFrame:
    """Metadata and conversion records of all responses in records, two rows each; other record types are passed over.

    key_col names a column of records that is kept beside the derivatives. Records without an id give nothing, empty
    blocks give an empty text. Repeated responses give repeated derivatives. Columns beside those of a record are not read,
    whatever their names; an empty table gives an empty result. A very long page is converted whole. No shuffle.
    """
    key = F.col(key_col) if key_col else F.lit(0)
    src = records.where("record_type = 'response'").select(key.alias("_key"), "record_id", "target_uri", "date", "block", "payload_digest")
    out = src.mapInArrow(_derive, f"_key {src.schema['_key'].dataType.simpleString()}, {RECORD}")
    return out.withColumnRenamed("_key", key_col) if key_col else out.drop("_key")


_START = re.compile(rb"(?:\A|\n)WARC/[0-9.]+\r?\n")


def _members(data: bytes) -> Iterator[bytes | None]:
    """Contents of gzip members in pieces; None where a member is damaged, and on from the next one that begins well."""
    at = 0
    while at < len(data):
        engine, here = zlib.decompressobj(31), at
        try:
            while not engine.eof and here < len(data):
                piece = data[here : here + (1 << 16)]
                here += len(piece)
                if out := engine.decompress(piece):
                    yield out
            if not engine.eof:
                raise zlib.error("torn")
            at = here - len(engine.unused_data)
        except zlib.error:
            yield None
            following = data.find(b"\x1f\x8b\x08", at + 1)
            at = following if following >= 0 else len(data)


def _complete(held: bytes, final: bool) -> Iterator[tuple[int, tuple | None]]:
    """(end, record) of the records at the head of held; what is no record is passed over up to the next one's first line.

    A record that isn't all there waits for more, or is passed over when there is no more.
    """
    at = 0
    while found := _START.search(held, at):
        begin = found.start() + (held[found.start()] == 10)
        blank = re.compile(rb"\r?\n\r?\n").search(held, found.end() - 2)
        if not blank:
            if not final:
                return
            at = found.end() - 1
            continue
        fields = {}
        for line in held[found.end() : blank.start()].splitlines():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        end = blank.end() + int(size) if size.isascii() and size.isdigit() else -1
        if end > len(held) and not final:
            yield begin, None
            return
        if end < 0 or end > len(held):
            at = found.end() - 1
            continue
        get, head = fields.get, held[begin : blank.end()].decode("utf-8", "replace")
        yield end, (get("warc-record-id"), get("warc-type"), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), get("content-type"), head, held[blank.end() : end], get("warc-block-digest"), get("warc-payload-digest"))
        at = end


def parse_records(data: bytes) -> Iterator[tuple]:
    """Records of a WARC file, plain or gzipped in any number of members.

    A record without a usable length, a torn one or a damaged member costs that record alone: reading goes on at the next
    line that begins a record, or at the next member.
    """
    held = b""
    for piece in _members(data) if data[:2] == b"\x1f\x8b" else [data]:
        held += piece or b""
        end = 0
        for end, record in _complete(held, piece is None):  # noqa: B007
            if record:
                yield record
        held = b"" if piece is None else held[end:]
    for _, record in _complete(held, True):
        if record:
            yield record


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            size = 0
            for record in parse_records(content.as_py()):
                rows.append(record)
                size += len(record[7])
                if size > 16 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under path, a task per file; Spark hands a file over whole, so it must be below 2 GB."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write text records (derivatives) as WARC files, one per partition; blocks are UTF-8 text."""
    record = F.concat(F.col("headers"), F.col("block").cast("string"))
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)

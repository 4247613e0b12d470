"""Legacy archives (ARC, versions 1 and 2) and their conversion to WARC.

Archives are written by Spark's text writer, a record to a row, so they work on
any store that Spark can write: ARC records end with one line feed, WARC
records with two CRLF, which is the writer's line separator.  Files are
compressed whole and small enough to be read by one task each.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches, fresh_path, given_back, is_small, stage

#: Bytes of payload that one archive file holds, about.
FILE_BYTES = 8 << 20
#: Revisits (about 100 bytes each, long urls apart) that may be broadcast.
BROADCAST_ROWS = 200_000
_CRLF = "\r\n"
#: Fields of a record's header line by the version that the file's first record names.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}


def _escaped(url: str | None) -> str:
    """A header line is cut at blanks, so blanks and controls in a url are percent-encoded; null is ``-``."""
    return "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in url.encode("latin-1", "xmlcharrefreplace")) if url else "-"


def arc_file(version: int, records: Iterator[tuple[str | None, str | None, bytes]], date: str = "20260101000000") -> Iterator[bytes]:
    """Records of one ARC file: the version block, then (page, url, payload) as HTTP responses."""
    names = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}[f] for f in FIELDS[version])
    block = f"{version} 0 weftline\n{names}\n"
    # the version block is itself a record of the file's version
    given = {"url": "filedesc://pages.arc", "ip": "0.0.0.0", "date": date, "type": "text/plain", "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "pages.arc", "length": str(len(block))}
    yield (" ".join(given[f] for f in FIELDS[version]) + "\n" + block).encode()
    for page, url, payload in records:
        head = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_CRLF}" + (f"X-Page-Id: {page}{_CRLF}" if page is not None else "") + _CRLF
        given |= {"url": _escaped(url), "ip": "0.0.0.0", "type": "text/html", "length": str(len(head) + len(payload))}
        yield (" ".join(given[f] for f in FIELDS[version]) + "\n" + head).encode() + payload


def _line(raw: bytes) -> str:
    """A header line; old archives have some that are no UTF-8."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record; lengths are as declared. The version block comes first, its version under ``arc``."""
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = _line(data[at:end])
        if not line:
            at = end + 1
            continue
        parts = line.split(" ")
        if fields is None:
            length = int(parts[-1])
            version = int(data[end + 1 : end + 2])
            if version not in FIELDS or len(parts) != len(FIELDS[version]):
                raise ValueError(f"unknown version block: {line}")
            fields = FIELDS[version]
            yield dict(zip(fields, parts, strict=True)) | {"arc": str(version)}, data[end + 1 : end + 1 + length]
        else:
            if len(parts) != len(fields):
                raise ValueError(f"a header line has {len(parts)} fields instead of {len(fields)}")
            length = int(parts[-1])
            block = data[end + 1 : end + 1 + length]
            if len(block) != length:
                raise ValueError("a record is cut short")
            yield dict(zip(fields, parts, strict=True)), block
        at = end + 1 + length + 1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head (with its blank line), header fields by lower-case name, body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(_CRLF)
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return head + gap, named, body


def warc_date(arc_date: str) -> str:
    d = (arc_date + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page: str | None, url: str, date: str, digest: str) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {date} {digest}')}>"


def record_kind(header: dict[str, str], block: bytes) -> str:
    """What a record of an archive becomes: warcinfo of the version block, response where HTTP was spoken, else resource."""
    return "warcinfo" if "arc" in header else "response" if block.startswith(b"HTTP/") else "resource"


def _page(header: dict[str, str], block: bytes) -> int | None:
    """The page that a response names."""
    page = http_parts(block)[1].get("x-page-id") if record_kind(header, block) == "response" else None
    return None if page is None else int(page)


def _payload(header: dict[str, str], block: bytes) -> bytes:
    return http_parts(block)[2] if record_kind(header, block) == "response" else block


def other_record(header: dict[str, str], block: bytes) -> bytes:
    """A warcinfo or resource record, whose block is its payload; without the final CRLFs."""
    kind, date = record_kind(header, block), warc_date(header["date"])
    if kind == "warcinfo":
        told = {"format": "WARC File Format 1.1", "arc-version": header["arc"], "arc-fields": _line(block.partition(b"\n")[2].partition(b"\n")[0]), "arc-name": header["url"]}
        block = "".join(f"{k}: {v}{_CRLF}" for k, v in told.items()).encode()
    digest = payload_digest(block)
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(None, header["url"], date, digest), "WARC-Date": date}
    if kind == "warcinfo":
        fields |= {"WARC-Filename": header["url"].rpartition("/")[2], "Content-Type": "application/warc-fields"}
    else:
        fields |= {"WARC-Target-URI": header["url"], "WARC-IP-Address": header["ip"], "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "text/dns" if header["url"].startswith("dns:") else header["type"]}
    fields |= {"WARC-Block-Digest": f"sha1:{digest}", "Content-Length": str(len(block))}
    return ("WARC/1.1" + _CRLF + "".join(f"{k}: {v}{_CRLF}" for k, v in fields.items()) + _CRLF).encode() + block


def warc_record(header: dict[str, str], block: bytes, original: dict[str, str] | None) -> bytes:
    """A response, or a revisit of ``original`` (page, url, date, digest) which keeps the HTTP head only; other kinds as they are; without the final CRLFs."""
    if record_kind(header, block) != "response":
        return other_record(header, block)
    head, named, body = http_parts(block)
    digest = payload_digest(body)
    page = named.get("x-page-id")
    date = warc_date(header["date"])
    fields = {
        "WARC-Type": "revisit" if original else "response",
        "WARC-Record-ID": record_id(page, header["url"], date, digest),
        "WARC-Date": date,
        "WARC-Target-URI": header["url"],
        "WARC-IP-Address": header["ip"],
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if original:
        block = head
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(original["page"], original["url"], original["date"], digest),
            "WARC-Refers-To-Target-URI": original["url"],
            "WARC-Refers-To-Date": original["date"],
            "X-Refers-To-Page": original["page"],
        }
    fields |= {"WARC-Block-Digest": f"sha1:{payload_digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1" + _CRLF + "".join(f"{k}: {v}{_CRLF}" for k, v in fields.items()) + _CRLF).encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(_CRLF)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(header["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield header, block
        at = end + 8 + length


def _write(files: DataFrame, path: str, separator: str) -> None:
    """Each row is the content of a file, but for the separator at its end. Markup shrinks well at gzip's lowest level."""
    files.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", separator).option("maxRecordsPerFile", 1).text(path)


def _contents(pieces: list[bytes], separator: str) -> pa.RecordBatch:
    # bytes of any kind go through the text writer, which looks at none of them
    return pa.RecordBatch.from_arrays([pa.array([separator.encode().join(pieces)], pa.binary()).view(pa.string())], names=["value"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def write_arc(pages: DataFrame, path: str, version: int = 1, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """A legacy archive of the pages (null bodies: empty), a file for about FILE_BYTES of payload."""
    bounded_batches(pages.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page, url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                held.append((page, url, body.as_py() or b""))
                size += len(held[-1][2])
                if size >= FILE_BYTES:
                    yield _contents(list(arc_file(version, iter(held))), "\n")
                    held, size = [], 0
        if held:
            yield _contents(list(arc_file(version, iter(held))), "\n")

    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))
    _write(rows.mapInArrow(given_back(run), "value string"), path, "\n")


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 0) -> None:
    """WARC records equivalent to those of an archive: its version block as warcinfo, HTTP as responses and revisits, others as resources.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes that
    with the largest page number is the response, the others revisit it; records
    without a number are responses always.  Page numbers may repeat, with other
    payloads too: a record is told by its number and digest.  A first pass takes
    headers and digests only, and finds the originals; where these are too many
    to broadcast, the second pass deals the records by number and digest.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                digests, pages, urls, dates = [], [], [], []
                for header, block in read_arc(gzip.decompress(content.as_py())):
                    page, body = _page(header, block), _payload(header, block)
                    if page is not None and len(body) >= min_revisit_bytes:
                        digests.append(payload_digest(body)), pages.append(page), urls.append(header["url"]), dates.append(warc_date(header["date"]))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(pages, pa.int64()), pa.array(urls, pa.string()), pa.array(dates, pa.string())], names=["digest", "page", "url", "date"])

    files = _files(spark, arc_path)
    seen = files.mapInArrow(given_back(index), "digest string, page long, url string, date string")
    seen = stage(seen, "arc-index")
    last = stage(seen.groupBy("digest").agg(F.max(F.struct("page", "url", "date")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1"), "originals")
    refers = seen.join(F.broadcast(last) if is_small(last, BROADCAST_ROWS) else last, "digest").where("page <> o.page").select("page", "digest", F.col("o.page").cast("string").alias("o_page"), F.col("o.url").alias("o_url"), F.col("o.date").alias("o_date"))
    refers = stage(refers.select(F.col("page").alias("p"), F.col("digest").alias("d"), "o_page", "o_url", "o_date").dropDuplicates(["p", "d"]), "revisits")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                size = 0
                for header, block in read_arc(gzip.decompress(content.as_py())):
                    rows.append((_page(header, block), payload_digest(_payload(header, block)), header, block))
                    size += len(block)
                    if size > FILE_BYTES:
                        yield _unpacked(rows)
                        rows, size = [], 0
                yield _unpacked(rows)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for header, block, page, url, date in zip(*batch.columns, strict=True):
                original = {"page": page.as_py(), "url": url.as_py(), "date": date.as_py()} if page.is_valid else None
                held.append(warc_record(dict(header.as_py()), block.as_py(), original))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield _contents(held, _CRLF * 2)
                    held, size = [], 0
        if held:
            yield _contents(held, _CRLF * 2)

    records = files.mapInArrow(given_back(unpack), "page long, digest string, header map<string, string>, block binary")
    joined = records.join(F.broadcast(refers) if is_small(refers, BROADCAST_ROWS) else refers, F.expr("page = p AND digest = d"), "left").select("header", "block", "o_page", "o_url", "o_date")
    _write(joined.mapInArrow(given_back(convert), "value string"), warc_path, _CRLF * 2)


def _unpacked(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([list(r[k].items()) if k == 2 else r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["page", "digest", "header", "block"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each WARC record but warcinfo; digests of blocks and payloads are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for header, block in read_warc(gzip.decompress(content.as_py())):
                    if header["warc-block-digest"] != f"sha1:{payload_digest(block)}":
                        raise ValueError("a block does not match its digest")
                    if header["warc-type"] == "warcinfo":
                        continue
                    if header["warc-type"] == "resource":
                        rows.append((None, len(block), payload_digest(block), "resource", None))
                        continue
                    _, named, body = http_parts(block)
                    digest = header["warc-payload-digest"].removeprefix("sha1:")
                    if header["warc-type"] == "response" and digest != payload_digest(body):
                        raise ValueError("a payload does not match its digest")
                    page, refers = named.get("x-page-id"), header.get("x-refers-to-page")
                    rows.append((None if page is None else int(page), int(named["content-length"]), digest, header["warc-type"], None if refers is None else int(refers)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _files(spark, path).mapInArrow(given_back(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", version: int = 1) -> DataFrame:
    """Pages to a legacy archive, converted to WARC and read back.

    Null bodies are empty payloads.  Null ids come back as null and are always
    responses.  Rows that repeat an id are judged each by its own payload; where
    the largest id repeats with its payload, all of its rows are responses.
    Bodies and urls may be of any length.  No pages give an empty table.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, version, id_col, url_col, body_col)
    convert_arc(spark, arc, warc)
    return read_records(spark, warc)

"""Legacy web archives: write and read ARC files, convert them to WARC, read WARC files.

ARC files open with a ``filedesc`` record that states the version; every record is one header line (five fields in
version 1, ten in version 2, the declared length last) and that many bytes. The converter gives each record what WARC
asks for: an identifier made from archive name, offset, address and date, an ISO timestamp, a type (warcinfo,
response, resource, revisit), and SHA-1 digests of block and payload. Of records with equal payloads of at least
``LEAST`` bytes the one with the largest key stays a response, the others become revisits of it.

Archives are real files in the folder given, gzipped, written and read by Spark only. Each is about ``ARCHIVE_BYTES``
long before compression, so a task holds one archive at a time. Only digests, never payloads, are grouped.

Defined cases: a null payload is empty; a null or empty address becomes ``about:blank``; white space in addresses is
percent-encoded; records listed twice are two records, of which one is the response if they are long enough; a
declared length beyond the file's end gives a record marked as truncated; lines that are no header are skipped; an
empty table gives archives without pages and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.storage import shared_dir, stored

from .batches import arrow_types, rows_to_batches

ARCHIVE_BYTES = 8 << 20
LEAST = 1000
KEY_HEADER = "X-Archive-Key"
#: A date for pages without one.
NO_DATE = "19700101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The header fields of the two ARC versions.
ARC_FIELDS = {1: ("url", "ip", "date", "type", "length"),
              2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length")}


class Record(NamedTuple):
    offset: int
    version: int
    url: str
    ip: str
    date: str
    type: str
    block: bytes
    truncated: bool


# Writing ARC


def _address(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "about:blank"


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, offset: int, name: str) -> bytes:
    more = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} {ip} {date} {kind}{more} {length}\n".encode()


def arc_opening(version: int, name: str, date: str = NO_DATE) -> bytes:
    names = {1: "URL IP-address Archive-date Content-type Archive-length",
             2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 millrace\n{names[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), 0, name) + body


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
              version: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC files of HTTP responses, one record per row; the key travels in a response header."""
    payload = F.coalesce(col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(col(key_col).cast("string").alias("key"), col(url_col).cast("string").alias("url"), payload.alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"archive-{TaskContext.get().partitionId():06d}.arc"
        offset = 0

        def records() -> Iterator[tuple]:
            nonlocal offset
            opening = arc_opening(version, name)
            offset = len(opening) + 1
            yield opening, ()
            for batch in batches:
                for key, url, body in zip(*batch.columns):
                    body = body.as_py()
                    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
                            f"{KEY_HEADER}: {key.as_py() or ''}\r\n\r\n").encode()
                    line = arc_header(version, _address(url.as_py()), "0.0.0.0", NO_DATE, "text/html", len(head) + len(body), offset, name)
                    yield line + head + body, ()
                    offset += len(line) + len(head) + len(body) + 1

        yield from rows_to_batches(records(), [("value", pa.binary())], 256)

    archives = rows.repartition(max(1, -(-total // archive_bytes))).mapInArrow(run, "value binary")
    # cast() keeps the bytes as they are, and the text writer writes them so
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


# Reading ARC


def unpacked(content: bytes) -> bytes:
    """The bytes of a file of gzip members, or of a plain file."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def read_arc(data: bytes) -> tuple[str, list[Record]]:
    """The archive's own name and its records, the opening one included."""
    at, version, name, records = 0, 1, "", []
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").strip()
        opening = line.startswith("filedesc://")
        if opening:
            version = 2 if len(line.split(" ")) >= 10 else 1
        fields = ARC_FIELDS[version]
        parts = line.rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields) or not parts[-1].isdigit() or not re.fullmatch(r"\d{4,14}", parts[2]):
            at = end + 1
            continue
        got = dict(zip(fields, parts))
        length = int(got["length"])
        block = data[end + 1:end + 1 + length]
        records.append(Record(at, version, got["url"], got["ip"], got["date"], got["type"], block, len(block) < length))
        if opening:
            name = got["url"].removeprefix("filedesc://")
        at = end + 1 + length
    return name, records


# Conversion


def timestamp(date: str) -> str:
    """ARC's YYYYMMDDhhmmss, or its first digits, as WARC's ISO form."""
    d = date + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int, url: str, date: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{name} {offset} {url} {date}'.encode()).digest()[:16], version=5)}"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its closing empty line, and body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [i + len(x) for x in (b"\r\n\r\n", b"\n\n") if (i := block.find(x)) >= 0]
    cut = min(ends, default=len(block))
    return block[:cut], block[cut:]


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"^" + name.encode() + rb":[ \t]*([^\r\n]*)", head, re.M | re.I)
    return m[1].decode("utf-8", "replace").strip() if m else None


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def warc_type(r: Record) -> tuple[str, str]:
    """WARC type and content type."""
    if r.url.startswith("filedesc://"):
        return "warcinfo", "application/warc-fields"
    if r.block.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", "text/dns" if r.url.startswith("dns:") else r.type


def warc_record(name: str, r: Record, refers: dict | None) -> bytes:
    """One WARC record without the two line ends that close it; ``refers`` describes the response it revisits."""
    kind, content = warc_type(r)
    head, body = split_http(r.block)
    block = r.block
    if kind == "warcinfo":
        block = f"software: millrace\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode()
    elif refers:
        kind, block = "revisit", head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(name, r.offset, r.url, r.date)}>"), ("WARC-Date", timestamp(r.date)),
              ("WARC-Filename", name) if kind == "warcinfo" else ("WARC-Target-URI", r.url)]
    if kind != "warcinfo":
        fields += [("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", digest(body))]
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers['record_id']}>"), ("WARC-Refers-To-Target-URI", refers["url"]),
                   ("WARC-Refers-To-Date", timestamp(refers["date"])), ("X-Refers-To-Key", "" if refers["key"] is None else str(refers["key"]))]
    if r.truncated:
        fields.append(("WARC-Truncated", "unspecified"))
    fields += [("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the archives in a folder, one row per file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


_FOUND = "name string, offset long, record_id string, url string, date string, key long, payload_bytes long, payload_digest string, type string"


def arc_records(files: DataFrame) -> DataFrame:
    """One row per ARC record of the files, without the payload."""
    spark = files.sparkSession
    schema = spark.createDataFrame([], f"path string, {_FOUND}").schema
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column("path"), batch.column("content")):
                    name, records = read_arc(unpacked(content.as_py()))
                    for r in records:
                        head, body = split_http(r.block)
                        yield path, (name, r.offset, record_id(name, r.offset, r.url, r.date), r.url, r.date, _number(http_field(head, KEY_HEADER)),
                                     len(body), hashlib.sha1(body).hexdigest(), warc_type(r)[0])

        yield from rows_to_batches(rows(), types)

    return files.mapInArrow(run, schema)


def revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """path and ``refers``: for each record that repeats another's payload, its offset and the response it revisits."""
    same = ["payload_digest", "payload_bytes"]
    responses = records.filter((F.col("type") == "response") & (F.col("payload_bytes") >= least))
    best = F.max(F.struct("key", "path", "offset", "record_id", "url", "date"))
    first = responses.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), best.alias("first")).filter("n > 1")
    other = (F.col("first.path") != F.col("path")) | (F.col("first.offset") != F.col("offset"))
    return (responses.join(first, same).filter(other)
            .groupBy("path").agg(F.collect_list(F.struct("offset", "first.key", "first.record_id", "first.url", "first.date")).alias("refers")))


def convert(files: DataFrame, refers: DataFrame) -> DataFrame:
    """The WARC records (``value``, bytes) of ARC files, each file's in its order, given ``revisits`` of its records."""
    joined = files.join(refers, "path", "left").select("content", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for batch in batches:
                for content, listed in zip(batch.column("content"), batch.column("refers")):
                    by_offset = {x["offset"]: x for x in listed.as_py() or ()}
                    name, found = read_arc(unpacked(content.as_py()))
                    for r in found:
                        yield warc_record(name, r, by_offset.get(r.offset)), ()

        yield from rows_to_batches(records(), [("value", pa.binary())], 256)

    return joined.mapInArrow(run, "value binary")


def write_warc(records: DataFrame, path: str) -> None:
    value = F.col("value").cast("string")  # the same bytes
    records.select(value).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> None:
    """Convert a folder of ARC files to WARC files."""
    files = archive_files(spark, arc_path)
    write_warc(convert(files, stored(revisits(stored(arc_records(files), "arc-records"), least), "revisits")), warc_path)


# Reading WARC


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields.get("content-length", 0))
        yield fields, data[end + 4:end + 4 + length]
        at = end + 4 + length


_WARC_ROW = "record_type string, target_uri string, date string, key long, payload_bytes long, payload_digest string, refers_to string, refers_to_key long, intact boolean"


def warc_records(files: DataFrame) -> DataFrame:
    """One row per record of WARC files. ``intact``: the block, and a response's payload, have the digests stated."""
    spark = files.sparkSession
    schema = spark.createDataFrame([], f"record_id string, {_WARC_ROW}").schema
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column("content"):
                    for f, block in read_warc(unpacked(content.as_py())):
                        head, body = split_http(block)
                        kind, stated = f.get("warc-type"), f.get("warc-payload-digest", "")
                        revisit = kind == "revisit"
                        length = _number(http_field(head, "Content-Length")) if revisit else len(body)
                        ok = f.get("warc-block-digest") in (None, digest(block)) and (revisit or not stated or stated == digest(body))
                        told = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated.startswith("sha1:") else None
                        yield f.get("warc-record-id", "").strip("<>"), (
                            kind, f.get("warc-target-uri"), f.get("warc-date"), _number(http_field(head, KEY_HEADER)), length, told,
                            f.get("warc-refers-to", "").strip("<>") or None, _number(f.get("x-refers-to-key")), ok)

        yield from rows_to_batches(rows(), types)

    return files.select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int = 1,
                  least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the rows of ``warc_records`` read back from them (warcinfo left out)."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc", key_col, url_col, payload_col, version, archive_bytes)
    arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", least)
    return warc_records(archive_files(spark, f"{folder}/warc")).filter(_is_page())


def _is_page() -> Column:
    return F.col("record_type").isin("response", "revisit")

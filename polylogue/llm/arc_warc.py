"""WARC: converter of legacy ARC archives.

An ARC file begins with a version block, whose second line says how the header
line of each record reads: five fields in version 1, ten in version 2, the declared
length last. Records are cut by that length and become WARC records: identifiers
are named after address, date and number, 14-digit dates become timestamps, the
type follows the scheme and the body, digests are computed. Of records with equal
payloads the one with the smallest number is written whole and the others as
revisits of it. Archives are written and read by Spark, each of a bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload of a written archive, and of a legacy archive made from pages.
ARCHIVE_BYTES, ARC_BYTES = 16 << 20, 1 << 20

#: The header fields of both versions of ARC.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_NUMBER = re.compile(rb"(?im)^X-Record-Number: *(-?\d+)")
_LENGTH = re.compile(rb"(?im)^Content-Length: *(\d+)")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _unzipped(data: bytes) -> bytes:
    """The content of all members of a gzip file, or what is not compressed as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, the version block first: its header fields by name, body, whether it is cut short and whether it is the version block.

    A header line with too few fields or without a length ends the file with a ValueError.
    Blank lines between records are skipped; spaces in an address belong to it.
    """
    at, version = 0, 0
    while at < len(data):
        about = not version
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        at = end + 1 if end >= 0 else len(data)
        if about:
            version = int(data[at:at + 1] or b"0") if data[at:at + 1].isdigit() else 0
            if version not in ARC_FIELDS or not line.startswith("filedesc:"):
                raise ValueError(f"not an ARC version block: {line[:80]!r}")
            # a version 2 file may describe itself by the short line
            names = ARC_FIELDS[version] if len(line.split(" ")) >= len(ARC_FIELDS[version]) else ARC_FIELDS[1]
        else:
            names = ARC_FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"bad ARC header line: {line[:80]!r}")
        size = int(parts[-1])
        body = data[at:at + size]
        yield dict(zip(names, parts, strict=True)) | {"body": body, "cut": len(body) < size, "about": about}
        at += size


def warc_date(date: str) -> str:
    """The ISO form of an ARC date of up to 14 digits; missing parts are the earliest."""
    digits = re.sub(r"\D", "", date)[:14]
    full = digits + "00000101000000"[len(digits):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def as_warc(record: dict) -> dict:
    """The equivalent WARC record of an ARC record, before revisits are resolved.

    The version block, which becomes the warcinfo record, is known by ``about``; without that field, by its address.
    """
    body, url = record["body"], record["URL"]
    head, payload, kind, mime = b"", body, "resource", record["Content-type"] or "application/octet-stream"
    if record.get("about", url.startswith("filedesc:")):
        kind, mime = "warcinfo", "application/warc-fields"
        payload = b"software: ARC converter\r\nformat: WARC File Format 1.1\r\n"
    elif body.startswith(b"HTTP/"):
        kind, mime = "response", "application/http; msgtype=response"
        cut = re.search(rb"\r?\n\r?\n", body)
        at = cut.end() if cut else len(body)
        head, payload = body[:at], body[at:]
    number = _NUMBER.search(head)
    digest = sha1_base32(payload)
    name = f"{url} {record['Archive-date']} {number[1].decode() if number else sha1_base32(body)} {digest}"  # other payloads are other records
    return {"record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", "type": kind, "date": warc_date(record["Archive-date"]), "uri": url,
            "ip": record["IP-address"], "mime": mime, "number": int(number[1]) if number else None, "head": head, "payload": payload,
            "digest": digest, "size": len(payload), "cut": record["cut"]}


_RECORD = "record_id string, type string, date string, uri string, ip string, mime string, number long, head binary, payload binary, digest string, size long, cut boolean"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t])
                    for n, t in (x.split() for x in _RECORD.split(", "))])


def _batches(rows: Iterator[dict], schema: pa.Schema, size: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 500 + len(row.get(size) or b"")
        if n >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def convert(arcs: DataFrame) -> DataFrame:
    """WARC records of the ARC files in ``arcs`` (content, as the binaryFile reader gives it; gzip or plain)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                records = (as_warc(r) for r in parse_arc(_unzipped(content.as_py() or b"")))
                yield from _batches(records, _ARROW, "payload")

    return arcs.select("content").mapInArrow(run, _RECORD)


def with_revisits(records: DataFrame) -> DataFrame:
    """``records`` with refers_to: of equal payloads of responses the one with the smallest number stays whole; one without a number stays only where none has one."""
    own = records.where("type = 'response'").select("digest", "number", "record_id", "date", "uri")
    named = F.when(F.col("number").isNotNull(), F.struct("number", "record_id", "date", "uri"))
    first = own.groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = (own.select("digest", "number", "record_id").join(first, "digest").where(~F.col("number").eqNullSafe(F.col("first.number")))
             .select("record_id", F.col("first").alias("refers_to")).dropDuplicates(["record_id"]))
    return records.join(again, "record_id", "left")


def _record_text() -> F.Column:
    """A whole WARC record but for the last line end, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    fields = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("type"))), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("uri"), F.col("type") != "warcinfo"),
        line("WARC-IP-Address", F.col("ip"), F.col("type") == "response"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), F.col("type") != "warcinfo"),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to.record_id", F.lit(">")), revisit), line("WARC-Refers-To-Target-URI", F.col("refers_to.uri"), revisit),
        line("WARC-Refers-To-Date", F.col("refers_to.date"), revisit), line("X-Refers-To-Record-Number", F.col("refers_to.number").cast("string"), revisit),
        line("WARC-Truncated", F.lit("length"), F.col("cut")),
        line("Content-Type", F.col("mime")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return F.concat(fields.cast("binary"), block, F.lit("\r\n").cast("binary")).cast("string")


def write_warcs(records: DataFrame, path: str, archives: int) -> None:
    """Write ``records`` as about ``archives`` compressed WARC files below ``path``, equal payloads as revisits.

    Payloads move once: the partitions by record_id that hold an archive each are also what the revisits join.
    """
    with_revisits(records.repartition(archives, "record_id")).select(_record_text().alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file: header fields by lower-case name, block."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"bad WARC record: {lines[0][:80]!r}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields | {"block": data[end + 4:end + 4 + size]}
        at = end + 4 + size + 4


_READ = "record_id string, type string, date string, uri string, number long, refers_to_id string, refers_to_number long, payload_bytes long, payload_digest string, payload binary"
_READ_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _READ.split(", "))])


def read_warcs(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the WARC files below ``path``; with ``payloads`` false the bytes are only measured.

    Size and digest are those of the payload as stored; a revisit has the length that its HTTP header
    declares and the digest of its record header.
    """
    def rows(content: bytes) -> Iterator[dict]:
        for r in parse_warc(_unzipped(content)):
            block, kind = r["block"], r["warc-type"]
            payload, head = block, b""
            if kind in ("response", "revisit"):
                cut = re.search(rb"\r?\n\r?\n", block)
                head, payload = (block[:cut.end()], block[cut.end():]) if cut else (block, b"")
            number, length = _NUMBER.search(head), _LENGTH.search(head)
            size, digest = len(payload), sha1_base32(payload)
            if kind == "revisit":
                size, digest = int(length[1]) if length else None, r.get("warc-payload-digest", "").removeprefix("sha1:")
            yield {"record_id": r["warc-record-id"].strip("<>"), "type": kind, "date": r.get("warc-date"), "uri": r.get("warc-target-uri"), "number": int(number[1]) if number else None,
                   "refers_to_id": r["warc-refers-to"].strip("<>") if "warc-refers-to" in r else None,
                   "refers_to_number": int(r["x-refers-to-record-number"]) if "x-refers-to-record-number" in r else None, "payload_bytes": size, "payload_digest": digest,
                   "payload": payload if payloads and kind != "revisit" else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(rows(content.as_py()), _READ_ARROW, "payload")

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _READ)


def legacy_archives(pages: DataFrame) -> DataFrame:
    """(content): ARC files of about ARC_BYTES made from ``pages`` (page_id, url, html), versions 1 and 2 in turn.

    Each page is an HTTP response whose header holds the page's number and length; null html is an
    empty body and a null address "about:blank". A row with a null page_id has no number.
    """
    epoch = datetime(2000, 1, 1)

    def arc(version: int, records: list[tuple[int, str, bytes]]) -> bytes:
        fields = ARC_FIELDS[version]
        about = f"{version} 0 legacy\n{' '.join(fields)}\n\n".encode()
        out = [f"filedesc://legacy.arc 0.0.0.0 20000101000000 text/plain {len(about)}\n".encode() + about + b"\n"]
        for number, url, html in records:
            named = "" if number is None else f"X-Record-Number: {number}\r\n"
            body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{named}\r\n".encode() + html
            date = (epoch + timedelta(seconds=abs(number or 0) % (1 << 32))).strftime("%Y%m%d%H%M%S")
            more = "" if version == 1 else " 200 - - 0 legacy.arc"
            out.append(f"{url} 0.0.0.0 {date} text/html{more} {len(body)}\n".encode() + body + b"\n")
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            held, n = [], 0
            ids = batch.column("page_id").to_pylist()
            for i, (number, url) in enumerate(zip(ids, batch.column("url").to_pylist(), strict=True)):
                html = (batch.column("html")[i].as_py() or "").encode()
                held.append((number, re.sub(r"[\r\n]", "", url or "about:blank"), html))
                n += len(html)
                if n >= ARC_BYTES or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([arc(1 + made % 2, held)], pa.binary())], ["content"])
                    held, n, made = [], 0, made + 1

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return pages.mapInArrow(run, "content binary")


def pages_through_warc(pages: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages, converted to WARC files below ``path`` and read back.

    Equal payloads of 0 bytes or more are revisits of the smallest page_id, also where ids repeat: rows of one id with other
    payloads are records of their own, and rows that repeat id and payload are each a response or each a revisit.
    A row with a null page_id is a revisit where a row with an id has its payload, else a response. Pages of any
    length pass whole. An empty table gives an empty result.

    A revisit's header names the record it refers to and its number, so nothing is joined after reading.
    """
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length("html")).alias("n")).first()["n"] or 0
    records = convert(legacy_archives(pages)).where("type <> 'warcinfo'")
    write_warcs(records, path, max(1, -(-total // ARCHIVE_BYTES)))
    return read_warcs(spark, path, payloads=False).select(
        F.col("number").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_number").alias("refers_to"))

"""WARC archives from legacy ARC archives.

``write_arc`` writes pages as ARC files of version 1 or 2.  ``read_arc`` parses such files: the version block
names the version, which tells the fields of the header lines, and the declared lengths tell where records end.
``convert`` synthesises WARC records: an identifier derived from the record, the timestamp in ISO form, the digests, and the
type, where records that repeat a large payload become revisits.  ``read_warc`` reads WARC files back.

Files are written by Spark's text writer, whose line separator is the end of a record, so that writing
goes through Spark's commit protocol to any file system.  ``records_per_file`` bounds the files, and every file begins
with its version block or warcinfo record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_PER_FILE = 2000
MIN_REVISIT_BYTES = 1000
BATCH_CHARS = 1 << 20
_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_WARC_END = "\r\n\r\n"


def _field(value: str | None) -> str:
    """A header field without white space: what would break the line is percent-encoded; nothing is '-'."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "") or "-"


def _texts(rows: Iterator[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``BATCH_CHARS``, or of one longer row."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row)
        if n >= BATCH_CHARS:
            yield pa.record_batch([pa.array(held, pa.string())], names=["value"])
            held, n = [], 0
    if held:
        yield pa.record_batch([pa.array(held, pa.string())], names=["value"])


def write_arc(pages: DataFrame, path: str, version: int = 1, records_per_file: int = RECORDS_PER_FILE, date: str = "20240131200000") -> None:
    """Writes (page_id, url, html) as gzipped ARC files of the version.  A null html is an empty body."""
    fields = _FIELDS[version]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        n = 0
        for b in batches:
            for page_id, url, body in zip(*[b.column(k) for k in range(3)]):
                page_id, url, body = page_id.as_py(), url.as_py(), body.as_py() or ""
                if n % records_per_file == 0:
                    block = f"{version} 0 origin\n{' '.join(fields)}\n"
                    rest = "" if version == 1 else "200 - - 0 pages.arc "
                    yield f"filedesc://pages-{n}.arc 0.0.0.0 {date} text/plain {rest}{len(block)}\n{block}"
                    n += 1
                doc = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n{body}"
                size = len(doc.encode())
                rest = "" if version == 1 else "200 - - 0 pages.arc "
                yield f"{_field(url)} 0.0.0.0 {date} text/html {rest}{size}\n{doc}"
                n += 1

    lines = pages.select("page_id", "url", "html").mapInArrow(lambda batches: _texts(records(batches)), "value string")
    # These files are read back soon, so they are compressed for speed.
    lines.write.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).option("lineSep", "\n").option("compression", "gzip").text(path)


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths)).select("content")


def arc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, network document) of all records after the version block."""
    file = io.BytesIO(raw)
    names: list[str] = []
    while line := file.readline():
        if not line.strip():
            continue
        values = line.decode().rstrip("\r\n").split(" ")
        body = file.read(int(values[-1]))
        if values[0].startswith("filedesc:"):
            own, listed = body.decode().split("\n")[:2]
            version = int(own.split(" ")[0])
            if version not in _FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            names = listed.split(" ")
            continue
        if len(values) != len(names):
            raise ValueError(f"an ARC header line has {len(values)} fields where its version block names {len(names)}")
        yield dict(zip(names, values)), body


def _http(doc: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    head, _, body = doc.partition(b"\r\n\r\n")
    pairs = [x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    return head, body, {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def read_arc(spark: SparkSession, *paths: str) -> DataFrame:
    """(page_id, url, date, head, payload, digest) of all records of the ARC files."""
    names = ["page_id", "url", "date", "head", "payload", "digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows: list[tuple] = []
                for header, doc in arc_records(gzip.decompress(raw.as_py())):
                    head, body, fields = _http(doc)
                    key = fields.get("x-page-id", "").strip()
                    rows.append((int(key) if key else None, header["URL"], header["Archive-date"], head.decode(), body, hashlib.sha1(body).hexdigest()))
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return _files(spark, *paths).mapInArrow(parse, "page_id bigint, url string, date string, head string, payload binary, digest string")


def _record_id(url: str, date: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {page_id} {digest}')}>"


def _b32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def convert(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes the records as gzipped WARC files.

    Of records with equal payloads (digest and length) of ``MIN_REVISIT_BYTES`` or more, that with the largest page_id
    is the response and the others are revisits of it; null identifiers lose, and rows that repeat the winner's identifier are responses too.
    """
    size = F.octet_length("payload")
    slim = records.select("page_id", "digest", size.alias("size"), "url", "date")
    winners = (
        slim.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest", "size")
        .agg(F.max(F.struct("page_id", "url", "date")).alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", "size", "of")
    )
    marked = records.withColumn("size", size).join(winners, ["digest", "size"], "left").select(
        "page_id", "url", "date", "head", "payload", "digest", "of.page_id", "of.url", "of.date", F.col("of").isNotNull().alias("again")
    ).toDF("page_id", "url", "date", "head", "payload", "digest", "of_id", "of_url", "of_date", "again")

    def synthesise(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        n = 0
        for b in batches:
            for row in zip(*b.columns):
                page_id, url, date, head, payload, digest, of_id, of_url, of_date, again = (x.as_py() for x in row)
                if n % records_per_file == 0:
                    info = "software: hourloom\r\nformat: WARC File Format 1.1\r\n"
                    yield f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {page_id} {n}')}>\r\nWARC-Date: {_iso(date)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}"
                    n += 1
                revisit = again and page_id != of_id
                head = f"{head}\r\nContent-Length: {len(payload)}\r\n\r\n"
                block = head if revisit else head + payload.decode()
                lines = [
                    "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(url, date, page_id, digest)}", f"WARC-Target-URI: {url}", f"WARC-Date: {_iso(date)}",
                    f"WARC-Payload-Digest: sha1:{_b32(digest)}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block.encode()).digest()).decode()}",
                ]
                if revisit:
                    lines += [
                        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(of_url, of_date, of_id, digest)}",
                        f"WARC-Refers-To-Target-URI: {of_url}", f"WARC-Refers-To-Date: {_iso(of_date)}", f"X-Refers-To-Page: {of_id}",
                    ]
                lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
                yield "\r\n".join(lines) + "\r\n\r\n" + block
                n += 1

    out = marked.mapInArrow(lambda batches: _texts(synthesise(batches)), "value string")
    out.write.option("maxRecordsPerFile", records_per_file).option("lineSep", _WARC_END).option("compression", "gzip").text(path)


def _iso(date: str) -> str:
    d = (date if date.isdigit() else "").ljust(14, "0")
    return f"{d[:4]}-{max(d[4:6], '01')}-{max(d[6:8], '01')}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of all records; the declared lengths tell where they end."""
    file = io.BytesIO(raw)
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        yield fields, file.read(int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of all response and revisit records.

    The digest of a response is computed from its payload and must be the one its header states.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows: list[tuple] = []
                for fields, block in warc_records(gzip.decompress(raw.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    _, body, http = _http(block)
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload and digest of {fields['warc-record-id']} differ")
                    key, of = http.get("x-page-id", "").strip(), fields.get("x-refers-to-page")
                    rows.append((int(key) if key else None, fields["warc-target-uri"], int(http["content-length"]), digest, kind, int(of) if of and of != "None" else None))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return _files(spark, path).mapInArrow(parse, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")

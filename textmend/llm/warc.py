"""WARC archives from legacy ARC archives, written and read by Spark.

An ARC file is a version block and records, each a header line (of 5 fields in version 1, of 10 in version 2) and as many
bytes as it declares. The converter makes WARC records of them, with identifiers, timestamps, types and digests that the
old format lacks. Archives are files in a shared folder; a record that repeats an earlier payload is a revisit of it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import lean, pieces
from .exchange import shared_folder

FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


class ArcError(ValueError):
    """The bytes aren't an ARC archive, or not from here on."""


def arc_header(version: int, values: dict) -> bytes:
    return " ".join(str("-" if values.get(f) is None else values[f]) for f in FIELDS[version]).encode() + b"\n"


def write_arc(records: list[tuple[dict, bytes]], version: int = 1, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An archive of (header values, content)."""
    body = f"{version} 0 textmend\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'type': 'Content-type', 'result': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'filename': 'Filename', 'length': 'Archive-length'}[f] for f in FIELDS[version])}\n".encode()
    out = [arc_header(version, {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "result": 200, "filename": name, "length": len(body)}), body]
    at = sum(map(len, out))
    for values, content in records:
        head = b"\n" + arc_header(version, {**values, "offset": at + 1, "filename": name, "length": len(content)})
        out += [head, content]
        at += len(head) + len(content)
    return b"".join(out) + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header values and content of each record, the version block first. A url may hold spaces. Raises ArcError where a
    header is malformed or less is there than declared."""
    at, version = 0, 0
    while at < len(data):
        if data[at] in b"\r\n":  # records are parted by empty lines
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "surrogateescape")
        if end < 0:
            raise ArcError(f"no end of the header at {at}")
        first = not version
        if first:
            if not line.startswith("filedesc://"):
                raise ArcError("no version block")
            told = data[end + 1 : end + 2].decode("ascii", "replace")
            if told not in ("1", "2"):
                raise ArcError(f"unknown version {told!r}")
            version = int(told)
            # the version block's own header has either form
            wide = len(line.split(" ")) >= len(FIELDS[2])
        names = FIELDS[version if not first or wide or version == 1 else 1]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ArcError(f"malformed header at {at}: {line[:80]!r}")
        values = dict(zip(names, parts))
        at = end + 1 + int(parts[-1])
        if at > len(data):
            raise ArcError(f"{at - len(data)} bytes missing in the record of {values['url']}")
        yield values | {"version": version, "first": first}, data[end + 1 : at]


def warc_date(date: str) -> str:
    """Of the 14 digits (or the first 4 to 13) of an ARC date."""
    d = (re.match(r"\d*", date)[0] + "00000101000000"[len(re.match(r"\d*", date)[0]) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(digest: str, key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {key}')}>"


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Head with its empty line, and payload; all is payload if it isn't an HTTP response."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (i := content.find(mark)) >= 0:
            return content[: i + len(mark)], content[i + len(mark) :]
    return content, b""


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block


def convert(values: dict, content: bytes, key: object = None, refers_to: object = None, page: bool = False) -> bytes:
    """The WARC record of an ARC record. key: makes identifiers unique among equal payloads (by default the url and date);
    refers_to: the key of the response that a revisit repeats. page: keys are page ids, kept in fields of their own."""
    head, payload = http_parts(content)
    digest = hashlib.sha256(payload).hexdigest()
    key = f"{values['url']} {values['date']}" if key is None else key
    fields: list = []
    if values.get("first"):
        kind, mime = "warcinfo", "text/plain"
    elif head:
        kind, mime = "response", "application/http; msgtype=response"
    else:
        kind, mime = ("response" if values["url"].startswith("dns:") else "resource"), values["type"]
    if refers_to is not None:
        kind, content = "revisit", head
        fields = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(digest, refers_to))]
    ident = [("Page-ID", key), ("Refers-To-Page-ID", refers_to)] if page else []
    uri = None if kind == "warcinfo" else values["url"]
    return warc_record(
        [("WARC-Type", kind), ("WARC-Record-ID", record_id(digest, key)), ("WARC-Date", warc_date(values["date"])), ("WARC-Target-URI", uri), ("WARC-IP-Address", values["ip"] if kind != "warcinfo" and values["ip"] not in ("-", "0.0.0.0") else None), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(content).hexdigest()}"), *fields, *ident, ("Content-Type", mime)],
        content,
    )


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        at = end + 4 + size
        if at > len(data):
            raise ValueError(f"{at - len(data)} bytes missing in {fields.get('warc-record-id')}")
        yield fields, data[end + 4 : at]


MEMBER = 1 << 23


def members(record: bytes) -> bytes:
    """A record with its line ends, as a gzip member; one of more than MEMBER bytes as several. The last byte of a member is the
    highest of its size, which is 0 for so few bytes."""
    record += END.encode()
    return b"".join(gzip.compress(record[i : i + MEMBER], 6, mtime=0) for i in range(0, len(record), MEMBER))


def unzipped(data, step: int = 1 << 14) -> bytes:
    """All members of a gzip file. It's read in small steps, as what a member leaves of its last step is copied."""
    data, at, out = memoryview(data), 0, []
    while at < len(data):
        reader = zlib.decompressobj(31)
        while not reader.eof:
            if at >= len(data):
                raise ValueError("the last member isn't whole")
            out.append(reader.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(reader.unused_data)
    return b"".join(out)


def task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def page_record(page_id: object, url: str | None, body: bytes, date: str = "20240101000000", ip: str = "192.0.2.1") -> tuple[dict, bytes]:
    """ARC header values and content of a page. White space and control characters of a url are escaped."""
    head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    return {"url": url, "ip": ip, "date": date, "type": "text/html", "result": 200}, head.encode() + body


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, file_bytes: int = 16 << 20, archive_bytes: int = 2 << 20, date: str = "20240101000000", ip: str = "192.0.2.1") -> None:
    """Writes pages to WARC archives in folder, by way of ARC archives of archive_bytes or one page at least. Each ARC archive's
    version block becomes a warcinfo record, and each record is a gzip member of its own. As pages tell neither, all have
    the given date and address.

    Of pages with equal payloads of least_bytes or more, that with the smallest id is a response (all of them, if the id
    occurs again) and the others are revisits of it; a null id is larger than any other. Null html is an empty payload.
    Payloads of any length are written whole. Other columns, whatever their names, are left out."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", F.when(F.octet_length("body") >= least_bytes, F.sha2("body", 256)))
    first = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    # payloads that are too small to be revisited get keys that match nothing, and so lie apart
    rows = rows.withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("page_id", "url", "body").cast("string"))))
    known = rows.join(first, "digest", "left")
    known = known.select("page_id", "url", "body", F.when((F.col("page_id") > F.col("least")) | F.col("page_id").isNull(), F.col("least")).alias("refers_to"))

    def each(batches):
        lean()
        count = 0
        for batch in batches:
            for part in pieces(batch, 2, archive_bytes):
                ids, urls, bodies, refers = (c.to_pylist() for c in part.columns)
                archive = write_arc([page_record(*x, date, ip) for x in zip(ids, urls, bodies)], 1 + count % 2, f"pages-{task()}-{count}.arc", date)
                count += 1
                del part, urls, bodies
                keys, found, out = iter(zip(ids, refers)), read_arc(archive), []
                for values, content in found:
                    key, refers_to = (None, None) if values["first"] else next(keys)
                    record = convert(values, content) if values["first"] else convert(values, content, "null" if key is None else key, refers_to, True)
                    out.append(members(record))
                del archive
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["archive"])

    archives = known.mapInArrow(each, "archive binary").select(F.col("archive").cast("string").alias("value"))
    # the byte that Spark writes after each row is the last one of its last member
    writer = archives.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, file_bytes // archive_bytes))
    writer.text(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null in revisits) of all records in a
    folder's archives. A response whose payload doesn't have its record's digest ends the reading with an error."""

    def each(batches):
        lean()
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                rows: list = []
                for fields, block in read_warc(unzipped(data.as_buffer())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = http_parts(block)
                    digest = fields["warc-payload-digest"].partition(":")[2]
                    if kind == "revisit":
                        size, payload = int(re.search(rb"(?i)content-length:\s*(\d+)", head)[1]), None
                    else:
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {fields['warc-record-id']}")
                    page, refers = fields["page-id"], fields.get("refers-to-page-id")
                    rows.append((None if page == "null" else int(page), size, digest, kind, None if refers is None else int(refers), fields["warc-target-uri"], payload))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("content")
    return files.mapInArrow(each, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; the archives go when the session ends."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    write_pages(pages, folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return read_pages(spark, folder)

r"""Legacy archive converter: ARC in, WARC out, and both read back.

ARC. A file begins with a version block: `filedesc://name ip date text/plain length`, then `1 0 origin` or `2 0 origin` and
the line that names the fields of every later header line. Version 1 has URL, IP-address, Archive-date, Content-type and
Archive-length; version 2 adds result code, checksum, location, offset and file name before the length. Each record is a
header line, as many bytes as it declares, and a line end.

WARC. Each record gets an identifier (a UUID from a SHA-1 over its key, so a repeated run gives the same), the ISO date of
the ARC date, a type (warcinfo for the version block, response for HTTP, resource for others, revisit for a payload that
another record holds) and SHA-1 digests of block and payload.

Files are written by Spark's text sink, which puts bytes and a separator one after the other: with CRLF CRLF as separator a
file is a valid sequence of WARC records. They are read as binary files, decompressed and cut as a stream, so a task holds
one compressed file and one record. Everything goes through Spark's file systems; nothing is written locally.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm import common

#: Fields of ARC header lines by version (fixed values of the format).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CRLF = b"\r\n"
BATCH_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY_HEADER = "X-Record-Key"
RECORD = "url string, ip string, date string, mime string, key string, head binary, payload binary, n_bytes long, digest string, refers_to string"


class Stream:
    """Bytes of a file, gzip or plain, with several members or one."""

    def __init__(self, content: memoryview | bytes, step: int = 1 << 16):
        self.content, self.at, self.step, self.buffer = memoryview(content), 0, step, bytearray()
        self.zip = zlib.decompressobj(31) if bytes(self.content[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        part = self.content[self.at : self.at + self.step]
        self.at += len(part)
        if self.zip is None:
            self.buffer += part
            return True
        data = bytes(part)
        while data:
            self.buffer += self.zip.decompress(data)
            data = self.zip.unused_data if self.zip.eof else b""
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """Up to and without the line end; None at the end."""
        seen = 0
        while (i := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                if not self.buffer:
                    return None
                i = len(self.buffer)
                break
        out = bytes(self.buffer[:i])
        del self.buffer[: i + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError(f"the archive ends {n - len(self.buffer)} bytes before the declared length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


# ---- ARC ---------------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str = "20000101000000") -> bytes:
    body = f"{version} 0 skuforge\n{' '.join(ARC_FIELDS[version])}\n".encode()
    known = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(known.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, url: str, document: bytes, *, ip: str = "0.0.0.0", date: str = "20000101000000", mime: str = "text/html", status: str = "200") -> bytes:
    """A header line and the document; the line end that follows is the sink's separator."""
    quoted = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) or "about:blank"
    known = {"URL": quoted, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": status, "Archive-length": str(len(document))}
    return " ".join(known.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + document


def read_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file: the header's fields by name, `document` and `version`. A header line without the version's
    fields or length, or fewer bytes than declared, is an error: nothing after it can be told apart."""
    stream = Stream(content)
    fields = None
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            body = stream.take(int(parts[-1]))
            version = int(body.split(b" ", 1)[0])
            named = body.split(b"\n")[1].decode().split()
            fields = tuple(named) if named else ARC_FIELDS[version]
            yield {"version": version, "URL": parts[0], "Archive-date": parts[2], "Content-type": "text/plain", "document": body}
            continue
        if len(parts) != len(fields):
            raise ValueError(f"not a version {version} header line: {line[:80]!r}")
        got = dict(zip(fields, parts, strict=True))
        yield got | {"version": version, "document": stream.take(int(got["Archive-length"]))}


def write_arc(pages: DataFrame, folder: str, *, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> None:
    """An ARC file for each partition of pages. The document is an HTTP response whose body is the html in UTF-8 (null: empty).
    The key goes along as an HTTP header; a null key has none. Other columns aren't read."""
    df = common.only(pages, key=key_col, url=url_col, html=html_col).select(F.col("key").cast("string"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches(pa.schema([("record", pa.binary())]))
        yield from out.add((arc_version_block(version, "pages"),), 100)
        for batch in batches:
            keys, urls, htmls = (c.to_pylist() for c in batch.columns)
            for key, url, html in zip(keys, urls, htmls, strict=True):
                head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(html)}", *([] if key is None else [f"{KEY_HEADER}: {key}"])]
                document = "\r\n".join(head).encode() + CRLF + CRLF + html
                yield from out.add((arc_record(version, url or "", document),), len(document))
        yield from out.rest()

    df.transform(common.arrow, run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(folder)


class _Batches:
    """Rows as record batches of about BATCH_BYTES."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


def split_http(document: bytes) -> tuple[bytes, bytes]:
    """(status line and headers, body); no headers where it isn't an HTTP response."""
    if document.startswith(b"HTTP/"):
        for mark in (b"\r\n\r\n", b"\n\n"):
            if (i := document.find(mark)) >= 0:
                return document[: i + len(mark)], document[i + len(mark) :]
    return b"", document


def header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n"):
        if line.lower().startswith(name.lower().encode() + b":"):
            return line.split(b":", 1)[1].strip().decode("utf-8", "replace")
    return None


def _files(spark: SparkSession, folder: str, parse: Callable[[bytes], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches(schema)
        for batch in batches:
            for content in batch.column(0):
                for row in parse(content.as_buffer()):
                    yield from out.add(row, sum(len(x) for x in row if isinstance(x, bytes)) + 200)
        yield from out.rest()

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").transform(common.arrow, run, ddl)


def arc_records(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Records of the ARC files in folder, without version blocks; payloads=False leaves heads and payloads null."""

    def parse(content) -> Iterator[tuple]:
        for r in read_arc(content):
            if not r["URL"].startswith("filedesc:"):
                head, payload = split_http(r["document"])
                yield r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], header(head, KEY_HEADER), head if payloads else None, payload if payloads else None, len(payload), hashlib.sha1(payload).hexdigest()

    names = [("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("key", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("digest", pa.string())]
    return _files(spark, folder, parse, pa.schema(names), RECORD.removesuffix(", refers_to string"))


# ---- WARC --------------------------------------------------------------------------------------------------------------


def record_id(*parts: object) -> str:
    return uuid.UUID(bytes=hashlib.sha1("\x1f".join(map(str, parts)).encode()).digest()[:16], version=5).urn


def iso_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or the first part of it, as YYYY-MM-DDThh:mm:ssZ."""
    d = arc_date[:14] if arc_date[:14].isdigit() else ""
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest_field(raw: bytes) -> str:
    return f"sha1:{base64.b32encode(raw).decode()}"


def warc_record(kind: str, block: bytes, fields: dict[str, str], identifier: str, date: str) -> bytes:
    """A record without the two line ends after it; these are the sink's separator."""
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{identifier}>", "WARC-Date": date, **fields, "WARC-Block-Digest": digest_field(hashlib.sha1(block).digest()), "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()).encode() + CRLF + block


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record, by declared lengths. Another first line than WARC/ is an error."""
    stream = Stream(content)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        yield fields, stream.take(int(fields["Content-Length"]))


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, work: common.Workspace, *, least_bytes: int = 1000) -> None:
    """WARC files from ARC files, a file for each task that reads.

    Of records with equal payloads of least_bytes or more, those with the largest key are responses and the others revisit
    them. Which payloads are repeated is counted first, from digests alone and before a shuffle; records then look theirs up
    (broadcast by Spark only if the table of repeated digests is small, else a join that splits skewed digests). Keys are
    whole numbers; a null key is below all others and gets no revisit to it.
    """
    seen = arc_records(spark, arc_folder, payloads=False).filter(F.col("n_bytes") >= least_bytes)
    repeated = seen.groupBy("digest", "n_bytes").agg(F.max(F.col("key").cast("long")).alias("first_key"), F.count("*").alias("n")).filter("n > 1 and first_key is not null")
    repeated = work.save(repeated.select("digest", "n_bytes", "first_key"), "repeated")
    records = arc_records(spark, arc_folder).join(repeated, ["digest", "n_bytes"], "left")
    refers = F.when(F.col("key").cast("long").eqNullSafe(F.col("first_key")), None).otherwise(F.col("first_key")).cast("string")
    records = records.select("url", "ip", "date", "mime", "key", "head", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches(pa.schema([("record", pa.binary())]))
        info = b"software: skuforge\r\nformat: WARC File Format 1.0\r\n"
        yield from out.add((warc_record("warcinfo", info, {"Content-Type": "application/warc-fields"}, record_id("warcinfo", "skuforge"), iso_date("")),), 500)
        for batch in batches:
            for r in batch.to_pylist():
                raw = bytes.fromhex(r["digest"])
                fields = {"WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": digest_field(raw)}
                key = r["key"] if r["key"] is not None else (r["url"], r["date"], r["digest"])
                kind, block = "response" if r["head"] else "resource", r["head"] + r["payload"]
                if r["refers_to"] is not None:
                    kind, block = "revisit", r["head"]
                    fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{record_id(r['refers_to'])}>", "X-Refers-To-Key": r["refers_to"], "X-Payload-Length": str(len(r["payload"]))}
                if r["key"] is not None:
                    fields[KEY_HEADER] = r["key"]
                fields["Content-Type"] = "application/http; msgtype=response" if r["head"] else r["mime"]
                yield from out.add((warc_record(kind, block, fields, record_id(key), iso_date(r["date"])),), len(block) + 500)
        yield from out.rest()

    records.transform(common.arrow, run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_folder)


def warc_records(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Records of the WARC files in folder, without warcinfo: record_id, record_type, url, date, key, refers_to (key), and
    payload_bytes and payload_digest of the full payload, checked against the payload where the record holds it."""

    def parse(content) -> Iterator[tuple]:
        for fields, block in read_warc(content):
            kind = fields["WARC-Type"]
            if kind == "warcinfo":
                continue
            _, payload = split_http(block)
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            n = int(fields["X-Payload-Length"]) if kind == "revisit" else len(payload)
            if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload digest of {fields['WARC-Record-ID']} doesn't hold")
            yield fields["WARC-Record-ID"].strip("<>"), kind, fields.get("WARC-Target-URI"), fields["WARC-Date"], fields.get(KEY_HEADER), fields.get("X-Refers-To-Key"), n, digest, payload if payloads and kind != "revisit" else None

    names = [(c, pa.string()) for c in ("record_id", "record_type", "url", "date", "key", "refers_to")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    return _files(spark, folder, parse, pa.schema(names), "record_id string, record_type string, url string, date string, key string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def archive(pages: DataFrame, *, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1, work: common.Workspace | None = None) -> DataFrame:
    """pages as ARC files, converted to WARC files, and read back: key_col, payload_bytes, payload_digest, record_type,
    refers_to. A row for each page; a null html is an empty payload, a null url about:blank, a null key stays null."""
    spark = pages.sparkSession
    work = work or common.Workspace(spark, "warc")
    arc, warc = work.folder("arc"), work.folder("warc")
    write_arc(pages, arc, key_col=key_col, url_col=url_col, html_col=html_col, version=version)
    convert(spark, arc, warc, work)
    work.delete(arc)
    kind = pages.schema[key_col].dataType
    return warc_records(spark, warc, payloads=False).select(F.col("key").cast(kind).alias(key_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

"""Legacy archive converter: ARC files in, equivalent WARC files out.

ARC files come in two versions. Version 1 describes a document by five fields (URL, IP address, 14-digit date, content type,
length), version 2 by ten (result code, checksum, location, offset and file name come before the length). The version block
that opens a file says which; only the declared length tells where a record ends. The converter synthesises what WARC needs
and ARC lacks: record identifiers (name-based UUIDs), ISO timestamps, record types and SHA-1 digests.

Of the records whose payloads are equal and at least ``MIN_REVISIT`` bytes long, the one with the greatest key is a
``response`` and the others are ``revisit`` records that refer to it; all others are ``response`` records.

Archives are files in the shared folder: a task gathers records up to ``ARCHIVE_BYTES`` and hands Spark's writer one file's
bytes at a time (one gzip member a record, as is usual); they are read back through Spark's binary files reader. Who
revisits whom is decided on slim rows (key, digest, length): groups of equal payloads are folded by partial aggregation and
joined back on a salted digest, so a hot payload is spread. The few decisions meet the records by a join on the key.

Defined cases: null payloads are empty; a null URL is written as ``unknown:``; blanks in URLs are percent-encoded; a record
without a readable header line ends its file's reading with an error that names the offset; keys that repeat (null ones too), and
rows that are equal, are records of their own with ids of their own, which the place in the ARC file tells apart; of equal keys the
later place is the greater; a payload of any length is one record; a table without rows gives no files; columns besides key, URL
and payload are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, new_path, small_batches

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
#: Bytes handed to the decompressor at once.
PIECE = 1 << 13
#: Salts over which the rows of one digest are spread.
SALTS = 64
#: Decisions up to this number are broadcast (about 100 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 100_000
KEY_HEADER = "X-Page-Id"
DATE = "20240101000000"
LEVEL = 4
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of names that are URLs


@dataclass
class ArcRecord:
    """A record of an ARC file: its header line's fields, and the bytes that its length covers."""

    version: int
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    place: str

    def split(self) -> tuple[bytes, bytes]:
        """HTTP head (with its blank line) and payload; no head if the content isn't an HTTP response."""
        if self.content.startswith(b"HTTP/"):
            head, mark, body = self.content.partition(b"\r\n\r\n")
            if mark:
                return head + mark, body
        return b"", self.content


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, mark, value = line.partition(b":")
        if mark and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def arc_version_block(version: int, name: str, date: str = DATE) -> bytes:
    fields = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 millrace\n{fields}\n\n".encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str, content: bytes, date: str = DATE, mime: str = "text/html") -> bytes:
    middle = "" if version == 1 else f"200 {hashlib.md5(content, usedforsecurity=False).hexdigest()} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} {mime} {middle}{len(content)}\n".encode() + content + b"\n"


def members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """The gzip members of a file with their offsets; plain files are one member. Zeros after the last are padding."""
    if raw[:2] != b"\x1f\x8b":
        yield 0, raw
        return
    at, view = 0, memoryview(raw)
    while at < len(raw) and raw[at : at + 2] == b"\x1f\x8b":
        inflate, parts, pos = zlib.decompressobj(31), [], at
        while not inflate.eof and pos < len(raw):  # in pieces: what is left over after a member is copied
            parts.append(inflate.decompress(view[pos : pos + PIECE]))
            pos += PIECE
        yield at, b"".join(parts)
        at = min(pos, len(raw)) - len(inflate.unused_data)


def parse_arc(raw: bytes, name: str) -> Iterator[ArcRecord]:
    """Records of an ARC file after its version block; the block's first digit says how header lines are laid out."""
    version = 1
    for at, data in members(raw):
        pos = 0
        while pos < len(data):
            if data[pos : pos + 1] in (b"\n", b"\r"):
                pos += 1
                continue
            end = data.find(b"\n", pos)
            line = data[pos:end].decode("utf-8", "replace").split(" ") if end >= 0 else []
            if line and line[0].startswith("filedesc://"):
                length = int(line[-1])
                version = int(data[end + 1 : end + 2])
                pos = end + 1 + length
                continue
            if len(line) != (5 if version == 1 else 10) or not line[-1].isdigit():
                raise ValueError(f"{name}: no version {version} header line at member {at}, byte {pos}")
            length = int(line[-1])
            content = data[end + 1 : end + 1 + length]
            if len(content) != length:
                raise ValueError(f"{name}: member {at} ends before the {length} bytes declared at byte {pos}")
            yield ArcRecord(version, line[0], line[1], line[2], line[3], content, f"{name}#{at}+{pos}")
            pos = end + 1 + length


def record_id(place: str) -> str:
    """The id of the record that lies at ``place`` of an ARC file: the same at each conversion, and another for each record."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, place)}>"


def iso_date(date: str) -> str:
    """A 14-digit ARC date (shorter ones are filled up) as a WARC date."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_label(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of a WARC file."""
    for at, data in members(raw):
        pos = 0
        while pos < len(data):
            if not data.startswith(b"WARC/", pos):
                raise ValueError(f"no WARC record at member {at}, byte {pos}")
            end = data.index(b"\r\n\r\n", pos)
            lines = data[pos:end].decode("utf-8").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = int(fields["content-length"])
            yield fields, data[end + 4 : end + 4 + length]
            pos = end + 4 + length + 4


def _gzip(raw: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def _archive(parts: list[bytes]) -> pa.RecordBatch:
    """A file of gzip members without its last byte, a zero, which ``_write_files`` adds again.

    A member ends with the four bytes of its size, low ones first, so the last is zero unless the member has 16 MB or more:
    then a member of size 0 follows.
    """
    last = parts[-1] if parts[-1].endswith(b"\0") else parts[-1] + _gzip(b"")
    return pa.RecordBatch.from_arrays([pa.array([b"".join([*parts[:-1], last[:-1]])], pa.binary())], names=["bytes"])


def _write_files(archives: DataFrame, path: str) -> None:
    """One file for each row of ``archives`` (column ``bytes``), which Spark's text writer ends with a zero byte and names ``.txt``."""
    text = archives.select(F.col("bytes").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def write_arc(df: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", target: int = ARCHIVE_BYTES) -> None:
    """Write rows as ARC files: both versions in turn, HTTP responses whose head carries the key."""
    small_batches(df.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"\s", "%20")
    src = df.select(F.col(key_col).cast("string").alias("key"), F.when(url == "", "unknown:").otherwise(url).alias("url"), payload.alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, parts, size, name, version = TaskContext.get().partitionId(), 0, [], 0, "", 1
        for batch in batches:
            for key, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                if not parts:
                    version, name = 1 + (part + number) % 2, f"part-{part:05d}-{number:04d}.arc"
                    parts = [_gzip(arc_version_block(version, name))]
                    size = len(parts[0])
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{KEY_HEADER}: {key}\r\n" if key is not None else "") + f"Content-Length: {len(body)}\r\n\r\n"
                parts.append(_gzip(arc_record(version, name, size, url, head.encode() + body)))
                size += len(parts[-1])
                if size >= target:
                    yield _archive(parts)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield _archive(parts)

    _write_files(src.mapInArrow(run, "bytes binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


_ARC = "place string, key string, version int, url string, ip string, date string, mime string, head binary, payload binary, length long, digest string"


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ARC files with their payloads' lengths and SHA-1 digests; without ``payloads`` head and payload are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for r in parse_arc(content.as_py(), name.as_py()):
                    head, payload = r.split()
                    keep = (head, payload) if payloads else (None, None)
                    rows.append((r.place, http_field(head, KEY_HEADER), r.version, r.url, r.ip, r.date, r.mime, *keep, len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest()))
                for k in range(0, len(rows), 400):
                    columns = zip(*rows[k : k + 400])
                    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _ARC.split(", ")])

    return _files(spark, path).mapInArrow(run, _ARC)


def decide(slim: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """The records (``place``) that revisit another, and that one's place, key, URL and date; ``slim`` has place, key, url, date, length, digest."""
    order = F.struct(F.expr("try_cast(key as long)").alias("number"), F.col("key"), F.col("place"))
    long = slim.where(F.col("length") >= min_bytes).withColumn("order", order).withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int"))
    top = F.max_by(F.struct("place", "key", "url", "date"), "order")
    groups = long.groupBy("digest", "length").agg(F.count("*").alias("records"), top.alias("top")).where("records > 1")
    groups = materialise(groups, "archive-groups")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = long.join(spread, ["digest", "length", "salt"]).where(F.col("place") != F.col("top.place"))
    return pairs.select("place", F.col("top.place").alias("to_place"), F.col("top.key").alias("to_key"), F.col("top.url").alias("to_url"), F.col("top.date").alias("to_date"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, target: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT) -> None:
    """Write the WARC files that are equivalent to the ARC files of ``arc_path``."""
    slim = materialise(read_arc(spark, arc_path, payloads=False).select("place", "key", "url", "date", "length", "digest"), "archive-slim")
    decisions = materialise(decide(slim, min_bytes), "archive-revisits")
    records = read_arc(spark, arc_path)
    if decisions.count() <= BROADCAST_ROWS:
        decisions = F.broadcast(decisions)
    joined = records.join(decisions, "place", "left").select("place", "url", "ip", "date", "mime", "head", "payload", "digest", "to_place", "to_key", "to_url", "to_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                parts += [_gzip(_converted(row))] if parts else [_gzip(_warcinfo(row["place"])), _gzip(_converted(row))]
                size += len(parts[-1])
                if size >= target:
                    yield _archive(parts)
                    parts, size = [], 0
        if parts:
            yield _archive(parts)

    _write_files(joined.mapInArrow(run, "bytes binary"), warc_path)


def _warcinfo(place: str) -> bytes:
    """The record that opens a file; its id comes from the place of the file's first record."""
    body = b"software: millrace\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"warcinfo {place}")), ("WARC-Date", iso_date(DATE)), ("Content-Type", "application/warc-fields")]
    return warc_record(fields, body)


def _converted(row: dict) -> bytes:
    """One ARC record as a WARC record."""
    revisit = row["to_place"] is not None
    payload_label = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
    http = bool(row["head"])
    block = row["head"] if revisit else row["head"] + row["payload"]
    kind = "revisit" if revisit else "response" if http else "resource"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(row["place"])),
        ("WARC-Date", iso_date(row["date"])),
        ("WARC-Target-URI", row["url"]),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Payload-Digest", payload_label),
        ("WARC-Block-Digest", sha1_label(block)),
        ("Content-Type", "application/http; msgtype=response" if http else row["mime"]),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(row["to_place"])),
            ("WARC-Refers-To-Target-URI", row["to_url"]),
            ("WARC-Refers-To-Date", iso_date(row["to_date"])),
        ]
        fields += [("X-Refers-To-Key", row["to_key"])] if row["to_key"] is not None else []
    return warc_record(fields, block)


_WARC = "record_id string, record_type string, date string, uri string, key string, refers_to_id string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, warcinfo left out. ``payload_bytes`` and ``payload_digest`` (hex SHA-1) are of the full
    payload: taken from the bytes of responses, from HTTP head and label of revisits. ``intact``: the block's digest holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for f, block in parse_warc(content.as_py()):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, mark, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    if f["warc-type"] == "revisit":
                        size, digest = int(http_field(head, "Content-Length") or 0), base64.b32decode(f["warc-payload-digest"][5:]).hex()
                    else:
                        size, digest = len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                    rows.append((f["warc-record-id"], f["warc-type"], f["warc-date"], f["warc-target-uri"], http_field(head, KEY_HEADER), f.get("warc-refers-to"), f.get("x-refers-to-key"), size, digest, sha1_label(block) == f["warc-block-digest"]))
                if rows:
                    kinds = [*[pa.string()] * 7, pa.int64(), pa.string(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _WARC.split(", ")])

    return _files(spark, path).mapInArrow(run, _WARC)


def op3_archive(spark, sf_dir: str) -> DataFrame:
    arc, warc = new_path(spark, "pages-arc"), new_path(spark, "pages-warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""

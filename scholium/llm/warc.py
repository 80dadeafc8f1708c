"""WARC archives as a Spark data source, for reading and writing.

Reading (``spark.read.format("warc")``): the files below a path are packed into partitions by size. A record's
headers are parsed first, from the first kilobytes of its gzip member; record-type and header predicates that
Catalyst pushes down are tested there, and a record that fails, or whose payload the schema does not ask for, is
skipped without inflating its payload. Members written here carry their compressed length in the gzip extra field
``sl``, so skipping is a seek; in other files the member is inflated piecewise and thrown away.

Writing (``df.write.format("warc")``): a task writes its records to a file of its own, and the commit lists the
files of the successful attempts in ``_manifest-*``; a reader that finds manifests reads only what they list, so
what a lost executor or a retried task left behind is never read.

Paths go through ``pyarrow.fs`` (file, s3, gs, hdfs, viewfs): the archives need no Spark reader.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Column of each named header; "headers" has them all, by lower-case name.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in HEADERS]
    + [T.StructField("content_length", T.LongType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField("http_headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType())]
)
TARGET = 64 << 20
BATCH = 8 << 20
ROLL = 1 << 30
STEP = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("level", 4)))


def parse_headers(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of a repeated field counts, folded lines are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


class Member:
    """One gzip member, or one plain record, of an open file; inflates no more than is asked for."""

    def __init__(self, f, at: int):
        self.f, self.at, self.raw, self.end = f, at, b"", None
        self.plain = False
        head = f.read(12)
        if not head:
            raise EOFError
        if head[:2] != b"\x1f\x8b":
            self.plain, self.buffer, self.done = True, head, False
            return
        flags, extra = head[3], 0
        consumed = 10
        if flags & 4:
            extra = struct.unpack("<H", head[10:12])[0]
            field = f.read(extra)
            consumed = 12 + extra
            i = 0
            while i + 4 <= len(field):
                size = struct.unpack("<H", field[i + 2 : i + 4])[0]
                if field[i : i + 2] == b"sl" and size >= 8:
                    self.end = at + struct.unpack("<I", field[i + 4 : i + 8])[0]
                i += 4 + size
            rest = b""
        else:
            rest = head[10:]
        for flag in (8, 16):  # name and comment
            while flags & flag:
                zero = rest.find(b"\0")
                if zero >= 0:
                    consumed += zero + 1
                    rest = rest[zero + 1 :]
                    break
                more = f.read(64)
                if not more:
                    raise EOFError
                rest += more
        if flags & 2:
            rest += f.read(max(0, 2 - len(rest)))
            consumed += 2
            rest = rest[2:]
        self.pending, self.z, self.buffer, self.done = rest, zlib.decompressobj(-15), b"", False
        self.consumed = consumed

    def more(self, n: int = STEP) -> bool:
        """Up to n more bytes into the buffer; False at the end."""
        if self.done:
            return False
        if self.plain:
            got = self.f.read(n)
            self.buffer += got
            self.done = not got
            return bool(got)
        source = self.pending or self.f.read(min(n, STEP))
        if not source:
            self.done = True
            return False
        self.buffer += self.z.decompress(source, n)
        self.pending = self.z.unconsumed_tail
        if self.z.eof:
            self.done = True
            self.end = self.f.tell() - len(self.z.unused_data) + 8
        return True

    def trimmed(self, head: int) -> int:
        """Bytes of a plain record's head with the empty lines before it."""
        self.f.seek(self.at)
        front = self.f.read(64)
        return head + len(front) - len(front.lstrip(b"\r\n"))

    def skip(self, block: int, head: int) -> int:
        """Where the next member starts."""
        if self.plain:
            return self.at + head + block + 4
        if self.end is None:
            while not self.done:
                self.buffer = b""
                self.more()
        return self.end if self.end is not None else self.f.tell()


def length(headers: dict[str, str]) -> int | None:
    """Bytes of a record's block; None if the header says no number."""
    value = headers.get("content-length", "0") or "0"
    return int(value) if value.isascii() and value.isdigit() else None


def following(f, at: int) -> int | None:
    """Where the next line that opens a record starts, from ``at`` on."""
    f.seek(at)
    held, base = b"", at
    while more := f.read(1 << 16):
        held += more
        found = held.find(b"\nWARC/")
        if found >= 0:
            return base + found + 1
        base += max(0, len(held) - 5)
        held = held[-5:]
    return None


def records(f, wanted, payload: bool) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes | None]]:
    """(offset, headers, HTTP headers, payload) of the records whose headers pass ``wanted``.

    A member may hold one record or many. A record whose Content-Length is no number is left out, and what follows is read
    from the next member or, where nothing is compressed, from the next line that opens a record. Where a member
    cannot be inflated the file ends, with a record that has no type and one header, ``x-error``, so that it can be counted.
    """
    at = 0
    while True:
        f.seek(at)
        try:
            m = Member(f, at)
        except (EOFError, struct.error):
            return
        here, alone = None, m.plain or m.end is not None
        try:
            while True:
                m.buffer = m.buffer.lstrip(b"\r\n")
                while (cut := m.buffer.find(b"\r\n\r\n")) < 0 and m.more(4096):
                    m.buffer = m.buffer.lstrip(b"\r\n")
                if cut < 0 or not m.buffer.startswith(b"WARC/"):
                    here = None
                    break
                headers = parse_headers(m.buffer[:cut])
                size, start = length(headers), cut + 4
                here = size
                if size is None:
                    break
                if wanted(headers):
                    yield (at, *_block(m, headers, start, size, payload))
                if alone:
                    break
                left = start + size  # a member without a stated length may go on
                while left > len(m.buffer):
                    left -= len(m.buffer)
                    m.buffer = b""
                    if not m.more():
                        break
                m.buffer = m.buffer[left:]
        except (zlib.error, EOFError) as e:
            broken = {"x-error": str(e) or type(e).__name__}
            if wanted(broken):
                yield at, broken, {}, None
            return
        if not m.plain:
            at = m.skip(0, 0)
            continue
        step = following(f, at) if here is None else at + m.trimmed(cut + 4) + here
        if step is None:
            return
        at = step


def _block(m: Member, headers: dict[str, str], start: int, size: int, payload: bool) -> tuple[dict[str, str], dict[str, str], bytes | None]:
    """Headers, HTTP headers and, if asked for, payload of the record at the front of a member's buffer."""
    http: dict[str, str] = {}
    end = -1
    is_http = headers.get("content-type", "").replace(" ", "").startswith("application/http")
    if is_http:
        while (end := m.buffer.find(b"\r\n\r\n", start)) < 0 and len(m.buffer) < start + size and m.more(4096):
            pass
        if 0 <= end < start + size:
            http = parse_headers(m.buffer[start:end])
    if not payload:
        return headers, http, None
    parts, have = [m.buffer], len(m.buffer)
    while have < start + size:
        m.buffer = b""
        if not m.more():
            break
        parts.append(m.buffer)
        have += len(m.buffer)
    m.buffer = b"".join(parts)
    return headers, http, m.buffer[end + 4 if 0 <= end < start + size else start : start + size]


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.path = schema, options["path"]
        self.target = int(options.get("targetBytes", TARGET))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes predicates on header columns; gives back the rest."""
        for f in filters:
            column = f.attribute
            name = HEADERS.get(column[0]) if len(column) == 1 else column[1] if column[0] == "headers" and len(column) == 2 else None
            kind = {EqualTo: "eq", EqualNullSafe: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", IsNotNull: "there"}.get(type(f))
            if name is None or kind is None or (kind == "eq" and f.value is None):
                yield f
            else:
                self.tests.append((name, kind, getattr(f, "value", None)))

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            x = headers.get(name)
            if x is None or not (kind == "there" or kind == "eq" and x == value or kind == "in" and x in value or kind == "starts" and x.startswith(value) or kind == "ends" and x.endswith(value) or kind == "has" and value in x):
                return False
        return True

    def partitions(self):
        system, base = where(self.path)
        found = system.get_file_info(fs.FileSelector(base, recursive=True)) if system.get_file_info(base).type == fs.FileType.Directory else [system.get_file_info(base)]
        manifests = [i for i in found if i.base_name.startswith("_manifest-")]
        sizes = {i.path: i.size for i in found if i.type == fs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))}
        if manifests:
            listed = set()
            for i in manifests:
                with system.open_input_stream(i.path) as f:
                    listed |= set(json.loads(f.read()))
            sizes = {p: s for p, s in sizes.items() if p.rpartition("/")[2] in listed}
        groups: list[list[str]] = []
        room = 0
        for p, s in sorted(sizes.items()):
            if not groups or room < s:
                groups.append([])
                room = self.target
            groups[-1].append(p)
            room -= s
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        system, _ = where(self.path)
        arrow = to_arrow_schema(self.schema)
        names = self.schema.names
        rows: list[list] = [[] for _ in names]
        held = 0

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, arrow.types, strict=True)], schema=arrow)
            for c in rows:
                c.clear()
            return out

        for path in partition.files:
            with system.open_input_file(path) as raw:
                for offset, headers, http, body in records(io.BufferedReader(raw, 1 << 18), self.wanted, "payload" in names):
                    other = {"headers": lambda: list(headers.items()), "http_headers": lambda: list(http.items()), "content_length": lambda: length(headers), "payload": lambda: body, "file": lambda: path, "offset": lambda: offset}
                    for c, n in zip(rows, names, strict=True):
                        c.append(headers.get(HEADERS[n]) if n in HEADERS else other[n]())
                    held += len(body or b"") + 1000
                    if held >= BATCH:
                        yield batch()
                        held = 0
        if rows and rows[0]:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


def clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(record: bytes, level: int) -> bytes:
    """A gzip member that carries its own compressed and inflated length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    total = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_id, record_type, target_uri, refers_to, extra (map of further headers), payload (binary)."""

    def __init__(self, path: str, overwrite: bool, level: int):
        self.path, self.level = path, level
        system, base = where(path)
        if overwrite and system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir_contents(base)
        system.create_dir(base, recursive=True)

    def write(self, iterator):
        system, base = where(self.path)
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        files: list[str] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= ROLL:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = system.open_output_stream(f"{base}/{files[-1]}", compression=None)
                        out.write(self.info(files[-1], now))
                    out.write(self.record(row, now))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def info(self, name: str, now: str) -> bytes:
        body = b"software: scholium\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {now}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        return member(head.encode() + body + b"\r\n\r\n", self.level)

    def record(self, row: dict, now: str) -> bytes:
        payload, kind = row["payload"] or b"", row["record_type"]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        if kind != "revisit":
            body += payload
        fields = {"WARC-Type": kind, "WARC-Record-ID": row["record_id"], "WARC-Date": now, "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": f"sha1:{digest}"}
        if kind == "revisit":
            fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": row["refers_to"]}
        fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(body))} | dict(row["extra"] or {})
        head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
        return member(head.encode("utf-8", "replace") + body + b"\r\n\r\n", self.level)

    def commit(self, messages):
        system, base = where(self.path)
        with system.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages):
        system, base = where(self.path)
        for m in messages:
            for x in m.files if m else []:
                system.delete_file(f"{base}/{x}")


def read_warc(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(SCHEMA.names)) -> DataFrame:
    """Records below ``path`` with the columns asked for; leave out ``payload`` and no payload is inflated."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").schema(T.StructType([SCHEMA[c] for c in columns])).load(path)


# -- pages ---------------------------------------------------------------------------------------------------

#: Payloads from this size on are kept once.
LEAST = 1000
#: Up to so many repeated payloads (each a digest and two numbers, so under 16 MB) are broadcast; more are joined by a salted shuffle.
FEW, SALTS = 100_000, 32


def mark_revisits(pages: DataFrame, payload: str = "html", page_id: str = "page_id", least: int = LEAST, few: int = FEW) -> DataFrame:
    """``pages`` with payload (binary), record_type and refers_to: of equal payloads of ``least`` bytes or more, the row with the largest id is the response.

    Null payloads are empty. Rows without an id that repeat a payload are revisits of the largest id; where no
    row of a group has an id, and for rows that share the largest id, each is a response.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    groups = pages.select(F.col(page_id).cast("long").alias("__first"), body.alias("__body")).where(F.octet_length("__body") >= least).groupBy(F.sha1("__body").alias("__digest"), F.octet_length("__body").alias("__size")).agg(F.max("__first").alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first is not null").drop("__n")
    keyed = pages.withColumn("payload", body)
    big = F.octet_length("payload") >= least
    keyed = keyed.withColumn("__digest", F.when(big, F.sha1("payload"))).withColumn("__size", F.octet_length("payload"))
    if groups.limit(few + 1).count() <= few:
        joined = keyed.join(F.broadcast(groups), ["__digest", "__size"], "left")
    else:
        salt = F.when(big, F.pmod(F.xxhash64(page_id), F.lit(SALTS))).otherwise(F.pmod(F.xxhash64(page_id), F.lit(1 << 20)) + SALTS)
        copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = keyed.withColumn("__salt", salt.cast("long")).join(copies, ["__digest", "__size", "__salt"], "left").drop("__salt")
    again = F.col("__first").isNotNull() & ~F.coalesce(F.col(page_id).cast("long") == F.col("__first"), F.lit(False))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("__first"))).drop("__digest", "__size", "__first")


def write_pages(pages: DataFrame, path: str) -> None:
    """A record per row of ``pages`` (page_id, url, html), with revisits in place of repeated payloads."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)

    def urn(c: str | Column) -> Column:
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")) if isinstance(c, str) else c, F.lit(">"))

    chosen = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), "html")
    marked = mark_revisits(chosen)
    marked.select(
        F.when(F.col("page_id").isNull(), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).otherwise(urn("page_id")).alias("record_id"),
        "record_type",
        "target_uri",
        F.when(F.col("refers_to").isNotNull(), urn("refers_to")).alias("refers_to"),
        F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string")).alias("extra"),
        "payload",
    ).write.format("warc").mode("append").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page record below ``path``.

    Responses are read with their payloads, and size and digest are taken from those; revisits are read by their
    headers alone.
    """
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1), F.lit("")).cast("long")
    full = read_warc(spark, path, ("record_type", "record_id", "refers_to", "payload")).where("record_type = 'response'")
    full = full.select(number(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    brief = read_warc(spark, path, ("record_type", "record_id", "refers_to", "payload_digest", "http_headers")).where("record_type = 'revisit'")
    brief = brief.select(number(F.col("record_id")).alias("page_id"), F.col("http_headers")["content-length"].cast("long").alias("payload_bytes"), F.lower(F.hex(unbase32(F.split("payload_digest", ":")[1]))).alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))
    return full.unionByName(brief)


def unbase32(c: Column) -> Column:
    """Bytes of a base-32 text of 32 characters, with built-in functions."""
    # 8 characters are 5 bytes: conv has 5-bit digits 0-9 and a-v for base 32
    digits = F.translate(F.upper(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.unhex(F.concat(*[F.lpad(F.conv(F.substring(digits, 8 * i + 1, 8), 32, 16), 10, "0") for i in range(4)]))

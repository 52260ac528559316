"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from shelfwise.llm.shared import narrowed, settled, shared_folder

READ_SCHEMA = (
    "record_type string, record_id string, target_uri string, record_date string, content_type string, "
    "payload_digest string, refers_to string, headers map<string,string>, content_length long, payload_length long, payload binary"
)
WRITE_SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Columns that hold one WARC header each; predicates on them are tested before a payload is touched.
HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "record_date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
PART_BYTES = 64 << 20
_CHUNK = 1 << 16


def filesystem(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


# ---- writing -------------------------------------------------------------------------


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP head of the page it stands for, without the payload."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    digest = row["payload_digest"] or hashlib.sha1(payload).hexdigest()
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": row["record_id"],
        "WARC-Date": date,
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Refers-To": row["refers_to"],
        "WARC-Profile": SAME_PAYLOAD if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(head) + len(payload)),
    }
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_header(v)}\r\n" for k, v in fields.items() if v is not None)
    return text.encode() + b"\r\n" + head + payload + b"\r\n\r\n"


def zipped_member(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``SL`` holds its own and its unzipped size, so a reader can step over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    whole = 10 + 2 + 20 + len(body) + len(tail)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQQ", 20, b"SL", 16, whole, len(record)) + body + tail


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.level = options["path"].rstrip("/"), int(options.get("level", "1"))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One archive per task, under a name of this attempt; it gets its own name when all tasks have ended well."""
        fs, root = filesystem(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        place = Written(f"{root}/_{name}", f"{root}/{name}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(place.temporary, compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(zipped_member(record_bytes(row, self.date), self.level))
        return place

    def commit(self, messages: list) -> None:
        fs, _ = filesystem(self.path)
        for m in filter(None, messages):
            fs.move(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        fs, _ = filesystem(self.path)
        for m in filter(None, messages):
            fs.delete_file(m.temporary)


# ---- reading -------------------------------------------------------------------------


def _parsed(text: bytes) -> dict[str, str]:
    """Lower-cased header names and values of a head block; its first line is left out."""
    out = {}
    for line in text.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


class _Plain:
    """Bytes of one uncompressed archive or of one gzip member, read as far as asked."""

    def __init__(self, more: Callable[[], bytes]):
        self.more, self.have = more, b""

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and without ``mark``; None at the end of the data."""
        seen = 0
        while (at := self.have.find(mark, seen)) < 0:
            seen = max(0, len(self.have) - len(mark) + 1)
            if not (new := self.more()):
                return None
            self.have += new
        out, self.have = self.have[:at], self.have[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, size = [self.have], len(self.have)
        while size < n and (new := self.more()):
            parts.append(new)
            size += len(new)
        joined = b"".join(parts)
        self.have = joined[n:]
        return joined[:n]


def _record(source: _Plain, wanted, skip: Callable[[_Plain, int], None], with_payload: bool, name: str) -> tuple | None:
    """(headers, HTTP length, payload) of the next record, () for an unwanted one, None at the end."""
    text = source.until(b"\r\n\r\n")
    if text is None:
        if source.have.strip():
            raise ValueError(f"{name}: a record's head ends early")
        return None
    text = text.lstrip(b"\r\n")
    if not text.startswith(b"WARC/"):
        raise ValueError(f"{name}: no WARC record where one is due")
    headers = _parsed(text)
    length = int(headers.get("content-length", "0"))
    if not wanted(headers):
        skip(source, length + 4)
        return ()
    stated, payload = None, None
    http = headers.get("content-type", "").startswith("application/http")
    if not (with_payload or http):
        skip(source, length + 4)
        return headers, length, None
    block = source.take(length)
    if len(block) < length:
        raise ValueError(f"{name}: a record's block ends early")
    source.take(4)
    head, split, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    if http:
        stated = _parsed(head).get("content-length")
    payload = body if split or not http else b""
    return headers, int(stated) if stated and stated.isdigit() else len(payload), payload if with_payload else None


def records(file, name: str, wanted: Callable[[dict], bool], with_payload: bool = True) -> Iterator[tuple]:
    """(headers, payload length, payload) of the wanted records of one open archive, plain or one gzip member a record.

    Headers come first: an unwanted record is stepped over by a seek, in zipped archives where the
    member states its size, else by unzipping its bytes without keeping or parsing them.
    """
    start = file.read(2)
    file.seek(0)
    if start != b"\x1f\x8b":
        source = _Plain(lambda: file.read(_CHUNK))

        def forward(s: _Plain, n: int) -> None:
            beyond = n - len(s.have)
            s.have = s.have[n:]
            if beyond > 0:
                file.seek(beyond, 1)

        while (got := _record(source, wanted, forward, with_payload, name)) is not None:
            if got:
                yield got
        return
    at, size = 0, file.size()
    while at < size:
        file.seek(at)
        first = file.read(_CHUNK)
        whole = None
        if len(first) >= 32 and first[3] == 4 and first[12:14] == b"SL":
            whole = struct.unpack_from("<Q", first, 16)[0]
        unzip = zlib.decompressobj(31)
        queue = [first]

        def more() -> bytes:
            while not unzip.eof:
                data = unzip.unconsumed_tail or (queue.pop() if queue else file.read(_CHUNK))
                if not data:
                    raise ValueError(f"{name}: a zipped member ends early")
                if out := unzip.decompress(data, _CHUNK):
                    return out
            return b""

        def rest(s: _Plain, n: int) -> None:
            while whole is None and s.more():
                s.have = b""

        source = _Plain(more)
        if got := _record(source, wanted, rest, with_payload, name):
            yield got
        if whole is None:
            while more():
                pass
            whole = file.tell() - at - len(unzip.unused_data) - sum(map(len, queue))
        at += whole


class Archives(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


def _test(f) -> Callable[[dict], bool] | None:
    """The header test of a predicate on one header column, None for others."""
    if not hasattr(f, "attribute") or f.attribute[0] not in HEADER_OF or len(f.attribute) > 1:
        return None
    column, name = f.attribute[0], HEADER_OF[f.attribute[0]]
    show = _hex_digest if column == "payload_digest" else lambda x: x
    tests = {
        EqualTo: lambda v: v == f.value,
        In: lambda v: v in f.value,
        IsNotNull: lambda v: True,
        StringStartsWith: lambda v: v.startswith(f.value),
        StringEndsWith: lambda v: v.endswith(f.value),
        StringContains: lambda v: f.value in v,
    }
    passes = tests.get(type(f))
    return passes and (lambda headers: (v := show(headers.get(name))) is not None and passes(v))


def _hex_digest(value: str | None) -> str | None:
    """Bare lower-case hex of ``sha1:`` in base 32 or hex."""
    if not value or not value.lower().startswith("sha1:"):
        return value
    bare = value[5:]
    return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bare.lower()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Archives]:
        """Whole archives, small ones together up to 64 MB; names that begin with ``_`` or ``.`` are not read."""
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        here = fs.get_file_info(root)
        found = [here] if here.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and x.base_name[:1] not in "_.")
        groups: list[list[str]] = []
        room = 0
        for path, size in files:
            if room < size or not groups:
                groups.append([])
                room = PART_BYTES
            groups[-1].append(path)
            room -= size
        return [Archives(g) for g in groups] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        tests = [_test(f) for f in self.tests]
        names = [x.strip().split(" ")[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        fs, _ = filesystem(self.path)
        for path in partition.files:
            with fs.open_input_file(path) as file:
                for headers, length, payload in records(file, path, lambda h: all(t(h) for t in tests), self.with_payload):
                    fixed = [headers.get(HEADER_OF[n]) for n in names[:7]]
                    fixed[5] = _hex_digest(fixed[5])
                    rows.append((*fixed, list(headers.items()), int(headers.get("content-length", "0")), length, payload))
                    size += len(payload or b"") + 500
                    if size > 8 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark hand it predicates (a session setting that is off by default)."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages to archives and back ------------------------------------------------------

_NONE = "<urn:uuid:00000000-0000-8000-8000-000000000000>"
LEAST_SHARED = 1000


def _record_id(page_id):
    """A record id (a version 8 UUID) that holds the page id in its last 16 hex digits' payload; one fixed id for null."""
    digits = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    text = F.concat(
        F.lit("<urn:uuid:"), F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 4), F.lit("-8"),
        F.substring(digits, 13, 3), F.lit("-9"), F.substring(digits, 16, 1), F.lit("0-000000000000>"),
    )
    return F.coalesce(text, F.lit(_NONE))


def _page_id(record_id):
    digits = F.regexp_replace(record_id, r"<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-8([0-9a-f]{3})-9([0-9a-f])0-.*", "$1$2$3$4")
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.when(record_id != F.lit(_NONE), F.shiftleft(high, 32).bitwiseOR(low))


def with_record_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``page_id, url, html`` as rows to write: of equal payloads of ``least`` bytes or more only the largest page id keeps its own.

    Payloads are compared by SHA-1 and length. Pages are counted by digest map-side, so a payload
    that a third of all pages share is no hot group, and its join is one that Spark can split.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digested = narrowed(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha1(body).alias("payload_digest"), F.length(body).cast("long").alias("payload_length")
    )
    shared = settled(
        digested.filter(F.col("payload_length") >= least)
        .groupBy("payload_digest", "payload_length")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    again = F.coalesce(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))
    return digested.join(shared, ["payload_digest", "payload_length"], "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _record_id(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        "payload_digest",
        F.when(again, _record_id(F.col("keeper"))).alias("refers_to"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write one record per page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Digest and length of a response are taken from the payload read; a revisit's from its headers.

    Defined cases: a null html is an empty payload (a response); a null url leaves the header out;
    null page ids come back as null and never keep a shared payload for others unless all its pages
    lack an id, then each is a response; rows that repeat a page id are records of their own, all
    responses where that id is the largest; no pages make no archive and give no rows.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or f"{shared_folder(spark)}/archives"
    with_record_types(pages).write.format("warc").mode("append").option("path", path).save()
    read = spark.read.format("warc").option("path", path).load()
    responses = read.filter("record_type = 'response'").withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.length("payload").cast("long"))
    revisits = spark.read.format("warc").option("path", path).option("payload", "false").load().filter("record_type = 'revisit'")
    names = ["record_id", "payload_length", "payload_digest", "record_type", "refers_to", "target_uri"]
    both = responses.select(names).unionByName(revisits.select(names))
    return both.select(
        _page_id(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        _page_id(F.col("refers_to")).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )

"""WARC archives as a Python data source, ``spark.read.format("warc")`` and ``frame.write.format("warc")``.

Writing: each task writes files of its own, rolled at ``file_mb``; a record is one gzip member whose extra field holds its length
(subfield ``sl``), so a reader can step over it. Names of attempts that ended well reach the driver and go to a
``_committed-*.json`` beside the files; files of lost or repeated attempts are in no such list and are never read.

Reading: files (those of the lists, or all ``.warc`` and ``.warc.gz`` where there is none) are planned into partitions of about ``partition_mb``.
Predicates on columns that come from a record's header are pushed down. A record's header is inflated and parsed first; if a predicate fails,
the reader seeks to the next record and neither reads, inflates nor decodes the rest. With ``payload`` off that is so for every payload.
Archives of others, plain, of one member or of members without lengths, are read in sequence.

Options: ``path``, ``payload`` (true), ``verify`` (true: the digest given is that of the payload read, and has to agree with the header),
``partition_mb`` (64), ``file_mb`` (256), ``level`` (1, of the compression), ``date`` (of all records), ``mode`` (FAILFAST, or DROPMALFORMED: a file ends at its first broken record).

Payloads are what follows the HTTP head, as stored: no transfer or content coding is undone. A revisit has the head
of its response, so its length is known without a look-up.

Defined results: null payloads are empty, null ids and addresses have no header; line ends and control characters in an address are percent-encoded; equal rows
are records of their own (the one that counts as last is the response, the others revisit it); a payload of any length is one record, held once
in one task; no rows give a list without files; further columns of a written frame are ignored, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_batches

FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "record_date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "content_type": "Content-Type", "page_id": "X-Page-ID",
}
SCHEMA = "record_id string, record_type string, record_date string, target_uri string, payload_digest string, refers_to string, content_type string, page_id long, http_length long, payload binary"
ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (c.split() for c in SCHEMA.split(", "))])
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = struct.Struct("<4sIBBH2sHII")  # magic and flags, time, level, system, size of the extra field; its name, size, member's length, length inflated
FIRST = 2048  # compressed bytes in which a header is looked for at first


def location(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# --- records


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(row: dict, date: str) -> bytes:
    """A record as bytes. ``row``: record_id, record_type, target_uri, page_id, refers_to, sha1, http_length, payload."""
    uri = row["target_uri"] and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"])
    block = http_head(row["http_length"]) + (row["payload"] or b"")
    head = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": date, "WARC-Target-URI": uri, "X-Page-ID": row["page_id"], "WARC-Payload-Digest": f"sha1:{base32(row['sha1'])}",
        "WARC-Refers-To": row["refers_to"] and f"<{row['refers_to']}>", "WARC-Profile": SAME if row["record_type"] == "revisit" else None, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"".join((b"WARC/1.1\r\n", lines.encode(), b"\r\n", block, b"\r\n\r\n"))


def member(data: bytes, level: int) -> bytes:
    """``data`` as a gzip member that says how long it is."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, GZIP.size + len(body), len(data) & 0xFFFFFFFF) + body


def parse(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    version, _, rest = head.decode("utf-8", "replace").partition("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    lines = re.sub(r"\r\n[ \t]+", " ", rest).split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}


def columns(head: dict[str, str]) -> dict:
    """The columns that a header alone gives."""
    row = {name: head.get(field.lower()) for name, field in FIELDS.items()}
    for name in ("record_id", "refers_to"):
        row[name] = row[name] and row[name].strip("<>")
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rpartition(":")[2]
    row["page_id"] = int(row["page_id"]) if row["page_id"] and re.fullmatch(r"-?\d{1,19}", row["page_id"]) else None
    return row


# --- reading


class Member:
    """One gzip member of known length: read and inflated only as far as asked."""

    def __init__(self, file, size: int):
        self.file, self.left, self.inflate, self.text = file, size - GZIP.size, zlib.decompressobj(-15), bytearray()

    def upto(self, mark: bytes, start: int = 0) -> int:
        """Where ``mark`` ends in what is inflated so far or further on."""
        while (at := self.text.find(mark, start)) < 0:
            if not self.more(FIRST):
                raise ValueError("a record without the end of its header")
        return at + len(mark)

    def more(self, n: int) -> bool:
        got = self.file.read(min(n, self.left))
        self.left -= len(got)
        self.text += self.inflate.decompress(got)
        return bool(got)

    def whole(self) -> bytearray:
        self.more(self.left)
        if self.left or not self.inflate.eof:
            raise ValueError("a record ends too early")
        return self.text


class Sequence(Member):
    """The same over an inflated stream, where only the header's Content-Length tells where a record ends."""

    def __init__(self, file):
        self.file, self.text, self.end = file, bytearray(), None

    def more(self, n: int) -> bool:
        got = self.file.read(n if self.end is None else min(n, self.end - len(self.text)))
        self.text += got
        return bool(got)

    def whole(self) -> bytearray:
        while len(self.text) < self.end and self.more(1 << 20):
            pass
        if len(self.text) < self.end:
            raise ValueError("a record ends too early")
        return self.text


class Inflated:
    """The text of a gzip file of any number of members; what stands before a break is handed out before the break is told."""

    def __init__(self, file):
        self.file, self.out, self.rest, self.inflate, self.broken = file, bytearray(), b"", None, None

    def read(self, n: int) -> bytes:
        while len(self.out) < n and self.broken is None and self.fill():
            pass
        if not self.out and self.broken is not None:
            raise ValueError(self.broken)
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def fill(self) -> bool:
        data = self.rest or self.file.read(1 << 16)
        if not data and self.inflate is None:
            return False
        self.inflate = self.inflate or zlib.decompressobj(31)
        try:
            got = self.inflate.decompress(data, 1 << 20)
        except zlib.error as e:
            self.broken = str(e)
            return False
        self.out += got
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.inflate = None
        elif not data and not got:
            self.broken = "a gzip member ends too early"
        return True


def members(file, size: int) -> Iterator[Member]:
    at = 0
    while at < size:
        file.seek(at)
        fields = GZIP.unpack(file.read(GZIP.size))
        yield Member(file, fields[-2])
        at += fields[-2]


def sequence(file) -> Iterator[Member]:
    """Records one after the other; what a record has read too far is the start of the next."""
    rest = bytearray()
    while True:
        one = Sequence(file)
        one.text = rest
        while not one.text.strip() and one.more(FIRST):
            pass
        del one.text[: len(one.text) - len(one.text.lstrip())]
        if not one.text:
            return
        head = one.upto(b"\r\n\r\n")
        one.end = head + int(parse(bytes(one.text[: head - 4])).get("content-length", 0))
        rest, one.text = one.text[one.end :], one.text[: one.end]
        yield one
        skip = one.end - len(one.text)
        while skip > 0 and (got := len(file.read(min(skip, 1 << 20)))):
            skip -= got


def rows(one: Member, wanted: Callable[[dict], bool], payload: bool, verify: bool) -> dict | None:
    head = one.upto(b"\r\n\r\n")
    fields = parse(bytes(one.text[: head - 4]))
    row = columns(fields) | {"http_length": None, "payload": None}
    if not wanted(row):
        return None
    start, length = head, int(fields.get("content-length", 0))
    if (row["content_type"] or "").startswith("application/http") and length:
        start = one.upto(b"\r\n\r\n", head)
        said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", bytes(one.text[head:start]))
        row["http_length"] = int(said[1]) if said else None
    if payload and row["record_type"] != "revisit":
        row["payload"] = bytes(one.whole()[start : head + length])
        if len(row["payload"]) != head + length - start:
            raise ValueError("a record ends too early")
        if verify and row["payload_digest"] and row["payload_digest"] != base32(hashlib.sha1(row["payload"]).digest()):
            raise ValueError(f"record {row['record_id']}: the payload's digest differs")
    return row


def read_file(path: str, wanted: Callable[[dict], bool], payload: bool, verify: bool, strict: bool) -> Iterator[dict]:
    store, name = location(path)
    with store.open_input_file(name) as raw:
        size, file = raw.size(), io.BufferedReader(raw, 1 << 18)  # fewer requests where the store is far away
        start = file.read(GZIP.size)
        file.seek(0)
        sized = len(start) == GZIP.size and start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl"
        records = members(file, size) if sized else sequence(Inflated(file) if start[:2] == b"\x1f\x8b" else file)
        try:
            for one in records:
                if (row := rows(one, wanted, payload, verify)) is not None:
                    yield row
        except (ValueError, struct.error, zlib.error, EOFError, OSError) as e:
            if strict:
                raise ValueError(f"{path}: {e}") from e


#: Each predicate of a header's value; those of a null are false, as in SQL.
TESTS = {
    ds.EqualTo: lambda v, f: v == f.value, ds.In: lambda v, f: v in f.value, ds.GreaterThan: lambda v, f: v > f.value, ds.GreaterThanOrEqual: lambda v, f: v >= f.value, ds.LessThan: lambda v, f: v < f.value,
    ds.LessThanOrEqual: lambda v, f: v <= f.value, ds.IsNotNull: lambda v, f: True, ds.StringStartsWith: lambda v, f: v.startswith(f.value), ds.StringEndsWith: lambda v, f: v.endswith(f.value), ds.StringContains: lambda v, f: f.value in v,
}


def pushable(f: ds.Filter) -> bool:
    inner = f.child if isinstance(f, ds.Not) else f
    return type(inner) in (*TESTS, ds.IsNull) and len(inner.attribute) == 1 and inner.attribute[0] in FIELDS


def holds(f: ds.Filter, row: dict) -> bool:
    if isinstance(f, ds.Not):
        if isinstance(f.child, ds.IsNull | ds.IsNotNull):
            return not holds(f.child, row)
        return row[f.child.attribute[0]] is not None and not holds(f.child, row)
    value = row[f.attribute[0]]
    return value is None if isinstance(f, ds.IsNull) else value is not None and TESTS[type(f)](value, f)


@dataclass
class Files(ds.InputPartition):
    paths: tuple[str, ...]


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.filters = options["path"].rstrip("/"), []
        self.payload, self.verify = (options.get(k, "true").lower() == "true" for k in ("payload", "verify"))
        self.strict = options.get("mode", "FAILFAST").upper() != "DROPMALFORMED"
        self.share = int(options.get("partition_mb", 64)) << 20

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, place = location(self.path)
        found = {f.base_name: f.size for f in store.get_file_info(fs.FileSelector(place)) if f.is_file}
        lists = [n for n in found if n.startswith("_committed-")]
        if lists:
            names = [n for x in lists for n in json.loads(store.open_input_file(f"{place}/{x}").readall())]
        else:
            names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        groups, room = [], 0
        for n in sorted(names):
            if found[n] > room or not groups:
                groups.append([])
                room = self.share
            groups[-1].append(f"{self.path}/{n}")
            room -= found[n]
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        wanted = lambda row: all(holds(f, row) for f in self.filters)
        waiting, size = [], 0
        for path in partition.paths:
            for row in read_file(path, wanted, self.payload, self.verify, self.strict):
                waiting.append(row)
                size += 1000 + len(row["payload"] or b"")
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(waiting, ARROW)
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, ARROW)


# --- writing


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.level = options["path"].rstrip("/"), int(options.get("file_mb", 256)) << 20, int(options.get("level", 1))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, place = location(self.path)
        store.create_dir(place, recursive=True)
        task, attempt, names, file = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None or file.tell() >= self.most:
                    if file is not None:
                        file.close()
                    names.append(f"part-{task:05d}-{attempt}-{len(names)}.warc.gz")
                    file = store.open_output_stream(f"{place}/{names[-1]}", compression=None)
                file.write(member(record(row, self.date), self.level))
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        store, place = location(self.path)
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/_committed-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written]) -> None:
        """Nothing to do: files that no list names are not read."""


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to; take a new folder")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, and let Spark hand predicates to Python sources (off by default)."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """What ``write`` takes, from (page_id, url, html): of equal payloads of at least ``least`` bytes the last page is the response, the others revisit it.

    Only ids and digests meet by payload, so a payload that many pages share moves no pages; pages whose payload is written are dealt by row.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    kept = cut(pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("row")), "warc-pages")
    urn = lambda page, row: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))
    known = [urn(F.col("page_id"), F.col("row")).alias("record_id"), "target_uri", "page_id", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("http_length")]
    facts = cut(kept.select("row", F.unhex(F.sha2("payload", 256)).alias("digest"), *known), "warc-facts")
    last = facts.where(F.col("http_length") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("last"), F.count("*").alias("n")).where("n > 1")
    again = facts.join(last, "digest").where("row <> last.row")
    again = cut(again.withColumn("refers_to", urn(F.col("last.page_id"), F.col("last.row"))).drop("digest", "last", "n"), "warc-revisits")
    first = kept.join(again.select("row"), "row", "left_anti").select(F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "payload", *known)
    return first.unionByName(again.select(F.lit("revisit").alias("record_type"), "refers_to", F.lit(None).cast("binary").alias("payload"), *facts.columns[2:]))


def write(rows: DataFrame, path: str | None = None, **options) -> str:
    """Archives of ``rows`` (see ``records``); where they are. Without ``path``: a new folder in the shared one."""
    spark = rows.sparkSession
    register(spark)
    small_batches(spark)
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows.write.format("warc").mode("append").options(**options).save(path)
    return path


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records at ``path``, columns as in ``SCHEMA``; ``where`` on header columns is decided before a payload is touched."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)

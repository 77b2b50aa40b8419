"""Web archives of the request log, packed in ZIP files and read by ranges.

Every logged request becomes a WARC record (address_id, raw_input as the target, output_json
as the payload, created_at). Records are gzip members of ``archive/data.warc.gz``; a ZIP
file stores that member and ``indexes/index.cdx`` uncompressed, so a record can be read by
its range of bytes without unpacking anything. The reader parses the end record, its ZIP64
form and the central directory, finds the stored members through their local headers, reads
the index and then only the ranges asked for.

Payloads of at least ``LEAST_REVISIT`` bytes that are equal are stored once: the row with
the largest id is the response, the others are revisit records that refer to it.

Archives are written by the tasks of a Spark job to the shared folder through
``pyarrow.fs`` (local paths, and every store that it opens by a URI), each under a name of
its own attempt; only archives listed in the manifest table, which Spark commits, count. So
a lost executor or a repeated task leaves at most an unlisted file.

Cases: a null payload is empty; null targets and dates are left out of a record; repeated
rows are records of their own, and rows that share both a payload and its largest id are
all responses, as a revisit could not say which of them it means; rows with a null id take part as the smallest; an empty table gives no archive
and an empty result; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alamatika.plans.gazetteer import new_folder, written

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond this size
RANGE_BYTES = 4 << 20  # neighbouring records are read together up to this size
RANGES_PER_TASK = 32
TAIL_BYTES = 1 << 16
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Fixed values of the ZIP format: signatures, and fields that hand over to ZIP64.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """A stored member: its name, where its local header begins, its size."""

    name: str
    header: int
    size: int


# --- ZIP -----------------------------------------------------------------------------

class ZipWriter:
    """Stored members, one after another, with ZIP64 fields throughout."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A member whose size follows it in a data descriptor."""
        self.name, self.header, self.crc = name.encode(), self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(struct.pack(
            "<IHHHHHIIIHH", LOCAL, 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(self.name), len(extra)
        ) + self.name + extra)
        self.start = self.at

    def add(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.write(data)

    def end(self) -> None:
        size = self.at - self.start
        self.write(struct.pack("<IIQQ", 0x08074B50, self.crc, size, size))
        self.members.append((self.name, self.header, size, self.crc))

    def close(self) -> None:
        start = self.at
        for name, header, size, crc in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self.write(struct.pack(
                "<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8, 0, 0, 33, crc, FULL32, FULL32,
                len(name), len(extra), 0, 0, 0, 0, FULL32,
            ) + name + extra)
        end64, n = self.at, len(self.members)
        self.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, end64 - start, start))
        self.write(struct.pack("<IIQI", LOCATOR, 0, end64, 1))
        self.write(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def central_directory(file) -> list[Member]:
    """Stored members of an open ZIP file, from its end record (or the ZIP64 one)."""
    size = file.size()
    tail_at = max(0, size - TAIL_BYTES - 22)
    tail = file.read_at(size - tail_at, tail_at)
    k = tail.rfind(struct.pack("<I", END))
    while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(struct.pack("<I", END), 0, k)
    if k < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if FULL16 == count or FULL32 in (length, start):
        place = tail_at + k - 20
        signature, _, end64, _ = struct.unpack("<IIQI", file.read_at(20, place))
        if signature != LOCATOR:
            raise ValueError("no ZIP64 locator")
        record = file.read_at(56, end64)
        if struct.unpack_from("<I", record)[0] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, members = file.read_at(length, start), 0, []
    for _ in range(count):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if fields[0] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_comment, header = (fields[i] for i in (4, 8, 9, 10, 11, 12, 16))
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide = _wide_fields(extra)
        if plain == FULL32:
            plain = wide.pop(0)
        if packed == FULL32:
            packed = wide.pop(0)
        if header == FULL32:
            header = wide.pop(0)
        if method == 0:  # only stored members have ranges to read
            members.append(Member(name, header, plain))
        at += 46 + n_name + n_extra + n_comment
    return members


def _wide_fields(extra: bytes) -> list[int]:
    """The 64-bit numbers of a ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
        at += 4 + size
    return []


def data_start(file, member: Member) -> int:
    """Where a member's bytes begin: behind its local header, whose fields may differ in
    length from the central ones.
    """
    head = file.read_at(30, member.header)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


# --- WARC ----------------------------------------------------------------------------

def _record(kind: str, number: str, target: str | None, date: str | None, digest: str, payload: bytes, size: int, refers: str | None) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:address:{number}>"]
    if target is not None:
        # A line break in a target would end its field.
        head.append("WARC-Target-URI: " + target.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if date is not None:
        head.append(f"WARC-Date: {date}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:address:{refers}>")
    body = f"HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, str | bytes | int | None]:
    """Fields and payload of one record."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    name = lambda value: None if value is None else value[len("<urn:address:") : -1]
    target = fields.get("WARC-Target-URI")
    return {
        "address_id": name(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "raw_input": None if target is None else target.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "payload_bytes": int(http_fields["Content-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": name(fields.get("WARC-Refers-To")),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


# --- Spark ---------------------------------------------------------------------------

def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def _with_roles(log: DataFrame) -> DataFrame:
    """Log rows with their digest and, for a revisit, ``refers_to``.

    Only groups of equal large payloads are joined back; their table is written first, so
    that Spark can split a payload that a third of all rows has.
    """
    payload = F.coalesce("output_json", F.lit(""))
    rows = log.select(
        F.col("address_id").alias("id"), "raw_input", "created_at", payload.alias("payload"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    repeated = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(
        F.max("id").alias("head"), F.count("*").alias("n")
    ).where("n > 1")
    heads = written(repeated.select(F.col("digest").alias("of"), "head"), "heads")
    return rows.join(
        heads, (F.col("digest") == F.col("of")) & (F.col("size") >= LEAST_REVISIT), "left"
    ).select(
        "id", "raw_input", "created_at", "digest", "size",
        F.when(~F.col("head").eqNullSafe(F.col("id")), F.col("head")).alias("refers_to"), "payload",
    ).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def write_archives(log: DataFrame, folder: str) -> DataFrame:
    """Archives of a request log (address_id, raw_input, output_json, created_at) under
    ``folder``; returns their manifest (path, n_records).
    """
    rows = _with_roles(log).select(
        F.col("id").cast("string").alias("id"), "raw_input",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        "digest", "size", F.col("refers_to").cast("string").alias("refers_to"), "payload",
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        zipped = out = None
        index: list[str] = []

        def close() -> pa.RecordBatch:
            zipped.end()
            zipped.begin(INDEX)
            zipped.add("".join(index).encode("utf-8", "surrogatepass"))
            zipped.end()
            zipped.close()
            out.close()
            done = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], ["path", "n_records"])
            index.clear()
            return done

        for part in parts:
            for row in zip(*(part.column(k) for k in range(7))):
                number, target, date, digest, size, refers, payload = (x.as_py() for x in row)
                if zipped is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}")
                    zipped = ZipWriter(out)
                    zipped.begin(DATA)
                kind = "response" if refers is None else "revisit"
                data = (payload or "").encode("utf-8", "surrogatepass")
                record = gzip.compress(_record(
                    kind, "" if number is None else number, target, date, digest, data, size, refers
                ), 6, mtime=0)
                index.append(f"{zipped.at - zipped.start} {len(record)} {kind} {digest}\n")
                zipped.add(record)
                if zipped.at > ARCHIVE_BYTES:
                    yield close()
                    zipped = None
        if zipped is not None:
            yield close()

    return rows.mapInArrow(run, "path string, n_records bigint")


def locate_records(archives: DataFrame) -> DataFrame:
    """Ranges of records in archives (path): (path, start, lengths), neighbours together up
    to ``RANGE_BYTES``.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column("path").to_pylist():
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    members = {m.name: m for m in central_directory(file)}
                    data, index = members[DATA], members[INDEX]
                    first = data_start(file, data)
                    lines = file.read_at(index.size, data_start(file, index)).decode().splitlines()
                starts, groups, total = [], [], RANGE_BYTES
                for line in lines:
                    at, length = map(int, line.split(" ")[:2])
                    if total + length > RANGE_BYTES:
                        starts.append(first + at)
                        groups.append([])
                        total = 0
                    groups[-1].append(length)
                    total += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(starts)), pa.array(starts, pa.int64()), pa.array(groups, pa.list_(pa.int64()))],
                    ["path", "start", "lengths"],
                )

    return archives.select("path").mapInArrow(run, "path string, start bigint, lengths array<bigint>")


def read_records(ranges: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ranges (path, start, lengths). The digest of every response is checked
    against its payload, and a record that fails ends the job.
    """
    names = ["address_id", "raw_input", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, start, lengths in zip(*(part.column(k).to_pylist() for k in range(3))):
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    block = file.read_at(sum(lengths), start)
                records, at = [], 0
                for length in lengths:
                    record = parse_record(gzip.decompress(block[at : at + length]))
                    at += length
                    payload = record["payload"]
                    if payload is not None and hashlib.sha1(payload).hexdigest() != record["payload_digest"]:
                        raise ValueError(f"broken payload in {path}: {record['address_id']}")
                    records.append(record)
                columns = [pa.array([r[c] for r in records], k) for c, k in zip(names, kinds)]
                if with_payload:
                    columns.append(pa.array([
                        None if r["payload"] is None else r["payload"].decode("utf-8", "surrogatepass") for r in records
                    ], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names + ["output_json"] * with_payload)

    schema = (
        "address_id string, raw_input string, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to string" + ", output_json string" * with_payload
    )
    return ranges.select("path", "start", "lengths").mapInArrow(run, schema)


def archive_round_trip(spark: SparkSession, log: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write archives of a log to the shared folder and read every record back by range."""
    folder = new_folder(spark)
    manifest = written(write_archives(log, folder), "manifest")
    located = written(locate_records(_dealt(manifest, "path")), "ranges")
    return read_records(_dealt(located, "path", "start"), with_payload)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that name much more data than they hold, dealt out by number: adaptive execution
    would gather them in one task by their own size.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, rows.count() // RANGES_PER_TASK + 1), *keys)

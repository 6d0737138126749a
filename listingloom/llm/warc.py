"""WARC archives as a data source: files are planned as partitions, headers are read first, payloads only where wanted."""

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from listingloom.llm import files

VERSION = b"WARC/1.1\r\n"
#: A record's time is fixed, so that a task that runs again writes the same bytes.
NO_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file that a reader asks for at once, and of payloads in one batch.
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
#: Packed bytes that are unpacked at once, and unpacked bytes asked for while a header is looked for.
PIECE_BYTES, HEAD_BYTES = 1 << 16, 1 << 12

#: Columns that come from the headers alone, with the filters that are tested on them before a payload is touched.
HEADER_COLUMNS = ("record_id", "record_type", "url", "payload_digest", "refers_to", "payload_bytes")


def record_uri(key: int | None) -> str:
    return f"urn:record:{'' if key is None else key}"


def key_of(uri: str | None) -> int | None:
    last = (uri or "").removeprefix("urn:record:")
    return int(last) if last else None


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit of another record without it."""
    size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    address = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_uri(key)}>",
        f"WARC-Date: {NO_DATE}",
        *([f"WARC-Target-URI: {address}"] if url is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(raw: bytes, level: int) -> bytes:
    """One gzip member. Its extra field "sl" (of the WARC format's annex on compression) states the sizes of the member and
    of what is in it, so that a reader can pass over it; it is left out where a size needs more than 32 bits."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    size = 24 + len(body)
    if max(size, len(raw)) >= 1 << 32:
        return struct.pack("<4BIBB", 31, 139, 8, 0, 0, 0, 255) + body
    return struct.pack("<4BIBBH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(raw)) + body


def _stated_size(head: bytes) -> int | None:
    """The packed size of a member that begins with these bytes, where its only extra field states it."""
    if len(head) < 24 or not head[3] & 4 or head[10:16] != struct.pack("<H2sH", 12, b"sl", 8):
        return None
    return struct.unpack_from("<I", head, 16)[0]


class _Stream:
    """The unpacked bytes of a file of gzip members, only as far as they are asked for."""

    def __init__(self, file):
        self.file, self.total = file, file.seek(0, 2)
        file.seek(0)
        self.raw, self.at_raw, self.base = b"", 0, 0
        self.member, self.ends, self.ready, self.at, self.unpacked = None, None, bytearray(), 0, 0

    def _load(self, n: int) -> bytes:
        """The next n packed bytes, or what is left of the file."""
        while len(self.raw) - self.at_raw < n and (more := self.file.read(CHUNK_BYTES)):
            self.base += self.at_raw
            self.raw, self.at_raw = self.raw[self.at_raw :] + more, 0
        return self.raw[self.at_raw : self.at_raw + n]

    def _more(self, most: int = CHUNK_BYTES) -> bool:
        """Unpacks some more of the member that is being read; False at its end."""
        if self.member is None or self.member.eof:
            return False
        piece = self._load(1) and self._load(PIECE_BYTES)
        if not piece:
            raise ValueError("the archive ends within a record")
        out = self.member.decompress(piece, most)
        self.at_raw += len(piece) - len(self.member.unconsumed_tail or self.member.unused_data)
        self.ready += out
        self.unpacked += len(out)
        return True

    def start(self) -> bool:
        """Goes to the next member; False at the end of the file. The rest of the last one is passed over, packed, where
        its size is stated."""
        if self.ends is not None:
            if self.ends > self.total:
                raise ValueError("the archive ends within a record")
            if self.ends <= self.base + len(self.raw):
                self.at_raw = self.ends - self.base
            else:
                self.file.seek(self.ends)
                self.raw, self.at_raw, self.base = b"", 0, self.ends
        while self.ends is None and self._more():
            self.ready.clear()
        head = self._load(24)
        size = _stated_size(head)
        self.ends = None if size is None else self.base + self.at_raw + size
        self.member, self.ready, self.at = zlib.decompressobj(31), bytearray(), 0
        return bool(head)

    def goes_on(self, rest: int) -> bool:
        """Whether another record follows in this member, past the rest of the last block. Members of a stated size hold one."""
        if self.member is None or self.ends is not None:
            return False
        while rest:
            step = min(rest, len(self.ready) - self.at)
            self.at, rest = self.at + step, rest - step
            if rest:
                self._forget()
                if not self._more():
                    raise ValueError("a record is shorter than its header says")
        while True:
            while self.at < len(self.ready) and self.ready[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.ready):
                return True
            self._forget()
            if not self._more(HEAD_BYTES):
                return False

    def _forget(self) -> None:
        del self.ready[: self.at]
        self.at = 0

    def until(self, sign: bytes, within: int | None = None) -> bytes | None:
        """The bytes up to a sign, which is passed over; None, and nothing is passed over, if it is not within so many bytes."""
        self._forget()
        looked = 0
        while (end := self.ready.find(sign, looked, within)) < 0:
            looked = max(0, len(self.ready) - len(sign) + 1)
            if within is not None and len(self.ready) >= within:
                return None
            if not self._more(HEAD_BYTES):
                if within is not None:
                    return None
                raise ValueError("a record without the end of its header")
        found = bytes(self.ready[:end])
        self.at = end + len(sign)
        return found

    def take(self, n: int) -> bytes:
        while len(self.ready) < self.at + n and self._more():
            pass
        if len(self.ready) < self.at + n:
            raise ValueError("a record is shorter than its header says")
        found = bytes(self.ready[self.at : self.at + n])
        self.at += n
        return found


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _passes(value, test: Filter) -> bool:
    if isinstance(test, IsNull):
        return value is None
    if value is None:
        return False
    match test:
        case EqualTo():
            return value == test.value
        case In():
            return value in test.value
        case GreaterThan():
            return value > test.value
        case GreaterThanOrEqual():
            return value >= test.value
        case LessThan():
            return value < test.value
        case LessThanOrEqual():
            return value <= test.value
        case StringStartsWith():
            return value.startswith(test.value)
    return True


_TESTS = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, IsNull, IsNotNull)


def _uri(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def records(file, columns: list[str], tests: list[Filter], counter: dict[str, int] | None = None) -> Iterator[dict]:
    """The records of one archive that pass the tests on their headers.

    The WARC header is parsed and tested first. Blocks of HTTP begin with a header of their own, which is parsed only for
    records that passed; the payload is what follows it, as stored (a chunked body stays chunked), and of other blocks
    all of it. payload_bytes is its size; for a revisit, the size that its HTTP header states, or null. Header lines that
    a record does not have are null. A payload that no column asks for is not kept, nor is it unpacked where its member
    states its size, as those of write_warc do; members of other makers are unpacked to find the next. A member may hold
    many records. A payload that is read must have its SHA-1 digest, if its header states one in base32 and no transfer coding.
    """
    stream = _Stream(file)
    wants_payload = "payload" in columns
    rest = 0
    while stream.goes_on(rest) or stream.start():
        warc = _headers(stream.until(b"\r\n\r\n"))
        rest = size = int(warc.get("content-length", 0))
        digest = warc.get("warc-payload-digest")
        row = {
            "record_id": _uri(warc.get("warc-record-id")), "record_type": warc.get("warc-type"), "url": _uri(warc.get("warc-target-uri")),
            "payload_digest": None if digest is None else digest.removeprefix("sha1:"), "refers_to": _uri(warc.get("warc-refers-to")),
        }
        if not all(_passes(row[x.attribute[0]], x) for x in tests if x.attribute[0] != "payload_bytes"):
            continue
        http: dict[str, str] = {}
        if warc.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            head = stream.until(b"\r\n\r\n", size)
            if head is not None:
                http, rest = _headers(head), size - len(head) - 4
        stated = http.get("content-length", "")
        row["payload_bytes"] = rest if row["record_type"] != "revisit" else int(stated) if stated.isdecimal() else None
        row["payload"] = None
        if not all(_passes(row[x.attribute[0]], x) for x in tests if x.attribute[0] == "payload_bytes"):
            continue
        if wants_payload and row["record_type"] != "revisit":
            row["payload"], rest = stream.take(rest), 0
            if counter is not None:
                counter["payloads"] = counter.get("payloads", 0) + 1
            sha1 = digest is not None and digest.startswith("sha1:") and len(digest) == 37 and "transfer-encoding" not in http
            if sha1 and payload_digest(row["payload"]) != row["payload_digest"]:
                raise ValueError(f"{row['record_id']}: the payload does not have the digest of its header")
        if counter is not None:
            counter["unpacked"] = stream.unpacked
        yield row


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, home: str, file_bytes: int, level: int):
        self.home, self.file_bytes, self.level = home, file_bytes, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, folder = files.created(self.home)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(c) for c in ("record_key", "url", "payload", "refers_to_key", "is_revisit")]
            for i in range(batch.num_rows):
                key, url, payload, target, revisit = (c[i].as_py() for c in columns)
                payload = (payload or "").encode()
                refers_to = record_uri(target) if revisit else None
                raw = member(record(key, url, payload, payload_digest(payload), refers_to), self.level)
                if out is None or size + len(raw) > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"part-{part:08d}-{attempt}-{len(names):05d}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                out.write(raw)
                size += len(raw)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files.created(self.home)
        files.write_json(f"{self.home}/manifest.json", sorted(n for m in messages if m for n in m.names))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for name in m.names if m else ():
                files.drop(f"{self.home}/{name}")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, home: str, schema: StructType):
        self.home, self.columns, self.tests = home, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, _TESTS) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """The archives that the manifest names, or, of other makers' folders, all files *.warc.gz; one task each."""
        system, folder = files.opened(self.home)
        if system.get_file_info(f"{folder}/manifest.json").type == fs.FileType.File:
            return [_File(f"{self.home}/{n}") for n in files.read_json(f"{self.home}/manifest.json")]
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        below = sorted(f.path.removeprefix(folder).lstrip("/") for f in found if f.path.endswith(".warc.gz"))
        return [_File(f"{self.home}/{p}") for p in below]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        system, path = files.opened(partition.path)
        rows, size = [], 0
        with system.open_input_file(path) as file:
            for row in records(file, self.columns, self.tests):
                rows.append({c: row[c] for c in self.columns})
                size += 400 + len(row["payload"] or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Warc(DataSource):
    """Format "warc_records". Read: the columns of schema(), or those of them that .schema(...) names; without the column
    payload, payloads are not unpacked (see records()). Tests on the other columns are pushed to the headers. Needs
    spark.sql.python.filterPushdown.enabled for that; without it Spark tests the rows itself."""

    @classmethod
    def name(cls) -> str:
        return "warc_records"

    def schema(self) -> str:
        return (
            "record_id string, record_type string, url string, payload_digest string, refers_to string, "
            "payload_bytes long, payload binary"
        )

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("file_bytes", str(512 << 20))), int(self.options.get("level", "1")))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


def write_warc(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> None:
    """Writes one record per row: a response, or a revisit without payload of the row with an equal payload and the
    smallest key, where payloads have at least `least_bytes` bytes.

    A null payload counts as an empty one. Rows that share both the payload and its smallest key are all responses. A
    row without a key comes after all keys, and revisits; payloads whose rows all lack a key are all responses.
    Payloads are compared by SHA-256. First the narrow pairs (digest, key) are reduced per task and then per digest; only
    digests that occur twice go on. They meet the rows by an equi-join in which Spark splits a digest of very many rows.
    """
    df.sparkSession.dataSource.register(Warc)
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("record_key"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    kinds = (
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("record_key").alias("refers_to_key"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("refers_to_key").isNotNull()).select(F.col("digest").alias("same"), "refers_to_key")
    )
    first = F.col("same").isNull() | F.coalesce(F.col("record_key") == F.col("refers_to_key"), F.lit(False))
    joined = rows.join(kinds, rows.digest == kinds.same, "left")
    out = joined.select("record_key", "url", "payload", "refers_to_key", (~first).alias("is_revisit"))
    out.write.format("warc_records").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, columns: tuple[str, ...] = (*HEADER_COLUMNS, "payload")) -> DataFrame:
    """The records of the archives in a folder. payload is null for revisits; payload_bytes is the size of the full one.

    Sets spark.sql.python.filterPushdown.enabled for the session."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = {"payload_bytes": "long", "payload": "binary"}
    return spark.read.format("warc_records").schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)).load(folder)

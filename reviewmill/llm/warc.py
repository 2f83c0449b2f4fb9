"""WARC archives compressed with Zstandard: one frame per record, a dictionary in the leading skippable frame.

Archives are files in a shared folder that Python workers open by URI. Each writing task names its files by its attempt and
reports them only when it is done; the settled list of reported files is the archive set, so a lost or repeated task leaves
no record twice. The reader goes through an archive frame by frame in bounded memory, decodes one record per frame and
checks its headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.session import new_path, settle

# Frame magics and the version line.
DICTIONARY_MAGIC, FRAME_MAGIC, SKIPPABLE_MAGICS = 0x184D2A5D, 0xFD2FB528, range(0x184D2A50, 0x184D2A60)
VERSION = b"WARC/1.1"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
ID_START, ID_END = "<urn:page:", ">"

ROLL_BYTES, SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 32 << 20, 256, 16_384, 1 << 16
RECORD = (
    "archive string, record_type string, page_id long, refers_to long, target_uri string, payload binary,"
    " payload_bytes long, payload_digest string, error string"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(payloads: list[bytes]) -> bytes:
    """A dictionary from sample payloads; empty if they are too few or too short to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def record(page_id, url: str | None, payload: bytes, revisit: bool, refers_to, date: str) -> bytes:
    """The bytes of a response record, or of a revisit record that has the head of the response only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC-Type: " + ("revisit" if revisit else "response"),
        f"WARC-Record-ID: {ID_START}{'' if page_id is None else page_id}{ID_END}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {ID_START}{refers_to}{ID_END}")
    return b"\r\n".join([VERSION, *(line.encode() for line in lines)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


class BrokenArchive(ValueError):
    """Bytes that are no whole frame: nothing after them can be found."""


def exactly(stream: BinaryIO, n: int) -> bytes:
    found = stream.read(n)
    if len(found) != n:
        raise BrokenArchive("archive ends within a frame")
    return found


def frames(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(magic, bytes) of each frame: the content of a skippable frame, a data frame as it is. Lengths come from the block headers."""
    while start := stream.read(4):
        if len(start) < 4:
            raise BrokenArchive("archive ends within a frame")
        magic = struct.unpack("<I", start)[0]
        if magic in SKIPPABLE_MAGICS:
            yield magic, exactly(stream, struct.unpack("<I", exactly(stream, 4))[0])
            continue
        if magic != FRAME_MAGIC:
            raise BrokenArchive(f"no frame starts with {magic:#x}")
        flags = exactly(stream, 1)
        single, checksum = flags[0] >> 5 & 1, flags[0] >> 2 & 1
        header = (1 - single) + (0, 1, 2, 4)[flags[0] & 3] + (single, 2, 4, 8)[flags[0] >> 6]
        parts, last = [start, flags, exactly(stream, header)], 0
        while not last:
            head = exactly(stream, 3)
            value = int.from_bytes(head, "little")
            last, kind = value & 1, value >> 1 & 3
            if kind == 3:
                raise BrokenArchive("reserved block type")
            parts += [head, exactly(stream, 1 if kind == 1 else value >> 3)]
        if checksum:
            parts.append(exactly(stream, 4))
        yield magic, b"".join(parts)


def parse(data: bytes) -> dict:
    """Checked fields of one record; ``error`` says what is wrong with a broken one."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        return {"error": "no record head"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return {"error": f"bad header line {line[:80]!r}"}
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    missing = [name for name in NEEDED if not fields.get(name)]
    if missing:
        return {"error": "missing " + ", ".join(missing)}
    found = {
        "record_type": fields["warc-type"], "page_id": id_of(fields["warc-record-id"]),
        "refers_to": id_of(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri"),
    }
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return found | {"error": "content length and block differ"}
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    if not mark:
        return found | {"error": "no end of the HTTP head"}
    sizes = [line.split(b":", 1)[1].strip() for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if not sizes or not sizes[0].isdigit():
        return found | {"error": "no length in the HTTP head"}
    found |= {"payload_bytes": int(sizes[0]), "payload_digest": stated}
    if found["record_type"] == "revisit":
        return found | ({"error": "a revisit has a payload"} if payload else {})
    if len(payload) != int(sizes[0]):
        return found | {"error": "HTTP length and payload differ"}
    if stated and digest(payload) != stated:
        return found | {"error": "payload digest differs"}
    return found | {"payload": payload, "payload_digest": stated or digest(payload)}


def id_of(value: str | None) -> int | None:
    number = (value or "").removeprefix(ID_START).removesuffix(ID_END)
    return int(number) if number.lstrip("-").isdigit() else None


def arrow_uri(uri: str) -> str:
    """``uri`` as pyarrow names it: Spark's schemes of S3 are one there, and DBFS is a mounted folder."""
    scheme, mark, rest = uri.partition(":")
    if mark and scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    return "file:///dbfs/" + rest.lstrip("/") if mark and scheme == "dbfs" else uri


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI. Tasks write and read archives themselves, by pyarrow: file, s3 (s3a, s3n), gs, abfs,
    abfss and dbfs URIs work as they are, hdfs and viewfs where the workers have libhdfs."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def with_roles(pages: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``_first``: of rows whose payloads are equal and not below ``min_bytes``, the smallest key.

    Keys are aggregated by digest before they are joined to the payloads.
    """
    content = F.coalesce(payload, F.lit(""))
    marked = pages.withColumn("_digest", F.sha2(content, 256))
    groups = marked.filter(F.octet_length(content) >= min_bytes).groupBy("_digest").agg(
        F.min(key).alias("_first"), F.count("*").alias("_n")
    )
    return marked.join(groups.filter("_n > 1").drop("_n"), "_digest", "left").drop("_digest")


def sample_payloads(pages: DataFrame, key: str, payload: str) -> list[bytes]:
    """The starts of at most ``SAMPLES`` payloads, for the dictionary only; chosen by a hash of the key.

    Rows are first thinned to about twice that many, so all tasks together send no more to the driver.
    """
    place = F.xxhash64(key)
    share = min(1.0, (2 * SAMPLES + 100) / max(1, pages.count()))
    starts = pages.filter(place.cast("double") <= (share * 2 - 1) * 2.0**63)
    starts = starts.select(place.alias("place"), F.substring(payload, 1, SAMPLE_CHARS).alias("start")).filter("length(start) > 0")
    return [row["start"].encode() for row in starts.orderBy("place", "start").limit(SAMPLES).collect()]


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write a record per row below ``folder``, a URI that all workers reach; returns the settled list (archive, records).

    A null payload is written as an empty one, a null url has no target header. Of rows with equal payloads of at least
    ``min_bytes`` the one with the smallest key is the response and the others revisit it; rows that repeat that key are
    responses too. Rows without a key revisit the response if there is one. An empty table gives no archive.
    """
    dictionary = train(sample_payloads(pages, key, payload))
    first = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(key))
    columns: dict[str, Column] = {
        "key": F.col(key), "url": F.col(url), "payload": F.coalesce(payload, F.lit("")), "first": F.when(first, F.col("_first")),
    }

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        files, base = open_uri(folder)
        files.create_dir(base, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(dict_data=known, write_checksum=True) if known else zstandard.ZstdCompressor(write_checksum=True)
        done, stream, size, records = [], None, 0, 0
        for batch in batches:
            for page_id, address, content, refers_to in zip(*batch.columns):
                if stream is None:
                    done.append([f"{folder}/{name}-{len(done):04d}.warc.zst", 0])
                    stream = files.open_output_stream(f"{base}/{name}-{len(done) - 1:04d}.warc.zst", compression=None)
                    stream.write(leading_frame(dictionary))
                    size = 0
                target = refers_to.as_py()
                frame = press.compress(
                    record(page_id.as_py(), address.as_py(), content.as_py().encode(), target is not None, target, date)
                )
                stream.write(frame)
                size, done[-1][1] = size + len(frame), done[-1][1] + 1
                if size >= roll_bytes:
                    stream.close()
                    stream = None
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_pydict(
            {"archive": [x[0] for x in done], "records": pa.array([x[1] for x in done], pa.int64())},
            schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]),
        )

    rows = with_roles(pages, key, payload, min_bytes).select(*(c.alias(n) for n, c in columns.items()))
    return settle(rows.mapInArrow(write, "archive string, records long"), "archives")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive) of the files in a folder that somebody else wrote."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return found.select(F.col("path").alias("archive"))


def read_archives(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records of the listed archives, as in ``RECORD``. Broken records have an ``error``; after a broken frame the rest of
    that archive cannot be found, which is one row with an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RECORD.split(",")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, RECORD.split(","))])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, size = [], 0
                for found in records_of(archive):
                    rows.append({"archive": archive} | found)
                    size += len(found.get("payload") or b"")
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    listed = archives.select("archive")
    tasks = tasks or max(1, listed.count())
    return listed.repartition(tasks).mapInArrow(read, RECORD)


def records_of(archive: str) -> Iterator[dict]:
    files, path = open_uri(archive)
    with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
        press = zstandard.ZstdDecompressor()
        try:
            for number, (magic, content) in enumerate(frames(stream)):
                if magic in SKIPPABLE_MAGICS:
                    if number == 0 and magic == DICTIONARY_MAGIC:
                        packed = content[:4] == struct.pack("<I", FRAME_MAGIC)
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(content) if packed else content
                        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                    continue
                try:
                    yield parse(press.decompressobj().decompress(content))
                except zstandard.ZstdError as error:
                    yield {"error": f"frame cannot be decoded: {error}"}
        except BrokenArchive as error:
            yield {"error": str(error)}


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one, as a URI."""
    path = new_path(spark, "warc")
    return path if ":" in path.split("/")[0] else f"file://{path}"

"""Media columns: binary members in archives, written and read by every executor for itself.

``write_archives`` stores each row's payload as an 8-bit greyscale PNG, a member of a ZIP archive; ``MediaArchives`` is
a Spark data source that plans byte ranges over the archives of a folder.  A range owns the members whose local header
starts in it, found in the archive's own directory, so ranges need no exchange and no scan for boundaries.  Members are
read and retried one by one at their offsets, and streamed to Spark in Arrow batches of bounded bytes.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Samples in a row of the image; payloads are a positive multiple of it.
WIDTH = 576
FILL = b"\xff"
#: An archive is closed at either size; both stay far below what needs the 64-bit extension.
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 64 << 20, 50_000
BATCH_BYTES = 8 << 20
PNG = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``unit``."""
    return raw + FILL * (unit - len(raw) if not raw else -len(raw) % unit)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit greyscale image of the payload, ``WIDTH`` samples a row; a text chunk has the length without padding."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int | None]:
    """Samples of an 8-bit greyscale PNG (any row filter, not interlaced) and the length in its text chunk."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, length, head = 8, [], None, None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image without interlace")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if not rows[:, 0].any():
        return rows[:, 1:].tobytes(), length
    out = np.zeros((height + 1, width), dtype=np.uint8)
    for y in range(height):
        kind, line, above = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + above
        else:
            left = corner = 0
            for x in range(width):
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                left = out[y + 1, x] = (int(line[x]) + guess) & 255
                left, corner = int(left), up
    return out[1:].tobytes(), length


class ArchiveWriter:
    """A ZIP archive of stored (already compressed) members."""

    def __init__(self, stream):
        self.stream, self.at, self.members = stream, 0, []

    def add(self, name: bytes, data: bytes) -> None:
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, zlib.crc32(data), len(data), len(data), len(name), 0)
        self.members.append((common, name, self.at))
        local = b"PK\3\4" + common + name
        self.stream.write(local)
        self.stream.write(data)
        self.at += len(local) + len(data)

    def close(self) -> None:
        directory = b"".join(
            b"PK\1\2" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + name for common, name, at in self.members
        )
        n = len(self.members)
        self.stream.write(directory + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), self.at, 0))
        self.stream.close()


def read_directory(file, size: int) -> list[tuple[int, str, int, int]]:
    """(offset, name, bytes, checksum) of an archive's members, in order of offset."""
    tail_at = max(0, size - 65_557)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no archive directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    file.seek(start)
    raw, at, out = file.read(length), 0, []
    for _ in range(n):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged archive directory")
        crc, packed, _, name_n, extra_n, note_n = struct.unpack_from("<IIIHHH", raw, at + 16)
        offset = struct.unpack_from("<I", raw, at + 42)[0]
        out.append((offset, raw[at + 46 : at + 46 + name_n].decode(), packed, crc))
        at += 46 + name_n + extra_n + note_n
    return sorted(out)


def read_member(file, offset: int, size: int, crc: int) -> bytes:
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no member here")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    file.seek(offset + 30 + name_n + extra_n)
    data = file.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("damaged member")
    return data


def write_archives(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> int:
    """Store every row's text as a member of the archives in ``path``; the number of members.

    A null text counts as empty, a null key is written as such, repeated rows become members each.  A task writes its
    archives under a name of the attempt and renames them at the end to names that depend on the partition only, so a
    retried or speculative task leaves one set of archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        done: list[tuple[str, str]] = []
        writer, count = None, 0

        def finish() -> None:
            writer.close()

        for batch in batches:
            for doc_id, raw in zip(batch.column(0), batch.column(1)):
                raw = raw.as_py() or b""
                if writer is not None and (writer.at >= ARCHIVE_BYTES or len(writer.members) >= ARCHIVE_MEMBERS):
                    finish()
                    writer = None
                if writer is None:
                    temp = f"{base}/_{attempt}-{len(done)}"
                    done.append((temp, f"{base}/part-{part:06d}-{len(done):04d}.zip"))
                    writer = ArchiveWriter(fs.open_output_stream(temp))
                name = f"{count:09d}.{'' if doc_id.as_py() is None else doc_id.as_py()}.png"
                writer.add(name.encode(), encode_png(pad(raw), len(raw)))
                count += 1
        if writer is not None:
            finish()
        for temp, final in done:
            fs.move(temp, final)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["members"])

    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(key), F.col(text).cast("string").cast("binary")).mapInArrow(run, "members long")
    return rows.agg(F.sum("members")).first()[0] or 0


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int, size: int):
        super().__init__((archive, start, end))
        self.archive, self.start, self.end, self.size = archive, start, end, size


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 16 << 20)))
        self.retries = int(options.get("retries", 3))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[Range]:
        fs, base = pafs.FileSystem.from_uri(self.path)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.endswith(".zip"))
        return [Range(p, at, min(at + self.range_bytes, n), n) for p, n in files for at in range(0, n, self.range_bytes)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        held = 0
        file = fs.open_input_file(partition.archive)
        for offset, name, size, crc in read_directory(file, partition.size):
            if not partition.start <= offset < partition.end:
                continue
            data, error = None, None
            for attempt in range(self.retries + 1):
                try:
                    data, error = read_member(file, offset, size, crc), None
                    break
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                    if attempt < self.retries:
                        time.sleep(0.05 * 2**attempt)
                        file = fs.open_input_file(partition.archive)
            if error and not self.permissive:
                raise OSError(f"{partition.archive} at {offset} ({name}): {error}")
            rows.append((partition.archive, offset, name, data, error))
            held += size
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["archive", "offset", "member", "media", "error"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archive")``: one row for each member of the ZIP archives under ``path``.

    Options: ``rangeBytes`` (size of a planned range), ``retries`` (of a member, at its offset), ``mode``: ``failfast``
    raises once a member's retries are used up, ``permissive`` returns the row with null ``media`` and its ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema: StructType) -> MediaReader:
        return MediaReader(self.options)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").options(**options).load(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, mean step between neighbours, and a 16-bin histogram in thousandths."""
    x = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"{x.mean():.4f} {x.std():.4f} {step:.4f} " + ",".join(map(str, bins))


def media_features(archives: DataFrame) -> DataFrame:
    """Features of the stored bytes as read back, by ``doc_id`` (from the member's name; null where that has none).

    A member without media (permissive mode) has null features.
    """

    def one(name: str, media: bytes | None) -> tuple:
        doc_id = name.split(".")[-2]
        doc_id = int(doc_id) if doc_id else None
        if media is None:
            return (doc_id, *[None] * 7)
        payload, n_bytes = decode_png(media)
        return (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            if batch.num_rows:
                rows = [one(n.as_py(), m.as_py()) for n, m in zip(batch.column(0), batch.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return archives.select("member", "media").mapInArrow(run, FEATURES)

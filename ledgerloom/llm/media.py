"""Media columns: texts as lossless 8-bit images in archives, read back by a Spark data source.

Writing is a narrow map: each task appends one PNG member (8-bit grey, 576 pixels a row) for each
row to archives of bounded size in shared storage. An archive is a run of members, a directory
(one fixed entry for each member: id, offset, length, unpadded length, CRC) and a footer. A task
that is retried writes archives under new names; only the archives that its last attempt
reports are ever read.

Reading is a Python data source. It plans byte ranges over the archives; a partition reads the
directory, takes the members that start in its range, and streams them as Arrow batches. A
member that fails (short read, CRC, image) is read again on its own, from its offset; one that
keeps failing yields a row with an error and holds up no other member.
"""

from __future__ import annotations

import os
import struct
import time
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.llm.shared import local_path, new_folder, texts

WIDTH = 576
#: id, whether the id is null, offset, stored length, unpadded length, CRC-32 of the stored form.
ENTRY = struct.Struct("<q?qqqI")
#: Offset of the directory, members, magic.
FOOTER = struct.Struct("<qq8s")
MAGIC = b"LLARCH01"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """The payload: 255 is appended up to a positive multiple of 576 bytes; it is no byte of UTF-8."""
    return raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """Grey 8-bit PNG, no interlace, no filter: a sample is a byte of the payload."""
    rows = len(payload) // WIDTH
    lines = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    return b"".join((_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)), _chunk(b"IDAT", zlib.compress(lines, level)), _chunk(b"IEND", b"")))


def decode_png(stored: bytes) -> bytes:
    """The samples of what ``encode_png`` wrote; ValueError if anything is amiss."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, width, rows, data = 8, 0, 0, []
    while at < len(stored):
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = zlib.decompress(b"".join(data))
    if len(lines) != rows * (width + 1):
        raise ValueError("wrong number of samples")
    return b"".join(lines[i + 1 : i + 1 + width] for i in range(0, len(lines), width + 1))


def _open(path: str, mode: str):
    """A local or shared file by its path, anything else through Arrow's file systems."""
    if at := local_path(path):
        return open(at, mode)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at) if "w" in mode else store.open_input_file(at)


def _make_folder(path: str) -> None:
    """Object stores and HDFS make folders as files are written."""
    if at := local_path(path):
        os.makedirs(at, exist_ok=True)


class ArchiveWriter:
    """Archives of about ``most`` bytes each, one member after another."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.file, self.done = folder, most, None, []

    def add(self, member_id: int | None, stored: bytes, n_bytes: int) -> None:
        if self.file is None:
            self.path, self.at, self.entries = f"{self.folder}/{uuid.uuid4().hex}.archive", 0, []
            self.file = _open(self.path, "wb")
        self.file.write(stored)
        self.entries.append(ENTRY.pack(member_id or 0, member_id is None, self.at, len(stored), n_bytes, zlib.crc32(stored)))
        self.at += len(stored)
        if self.at >= self.most:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.write(b"".join(self.entries) + FOOTER.pack(self.at, len(self.entries), MAGIC))
            self.file.close()
            self.done.append((self.path, self.at + ENTRY.size * len(self.entries) + FOOTER.size, len(self.entries)))
            self.file = None


def store(docs: DataFrame, *, id: str = "doc_id", text: str = "text", archive_bytes: int = 64 << 20) -> str:
    """Write every row's text as a member; returns where the list of archives (path, size, members) is written."""
    folder = new_folder(docs.sparkSession, "media")
    _make_folder(folder)

    def run(batches):
        writer = ArchiveWriter(folder, archive_bytes)
        for batch in batches:
            for member_id, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                writer.add(member_id, encode_png(padded(raw)), len(raw))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in writer.done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "members"])

    archives = docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(run, "path string, size bigint, members bigint")
    archives.write.parquet(at := new_folder(docs.sparkSession, "archives"))
    return at


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.list_path = options["list"]
        self.range_bytes = int(options.get("range_bytes", 0))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives that the list names. A range that starts beyond the last member is empty.

        They are of 8 MB, or of as much more as keeps their number at 100,000, if ``range_bytes`` is not given.
        """
        archives = list(archive_list(self.list_path))
        step = self.range_bytes or max(8 << 20, sum(size for _, size in archives) // 100_000)
        out = [ByteRange(path, at, min(size, at + step)) for path, size in archives for at in range(0, size, step)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        if not partition.path:
            return
        entries = self._directory(partition.path)
        members, rows, size = Members(partition.path, self.tries), [], 0
        for member_id, null, offset, length, n_bytes, crc in entries:
            if not partition.start <= offset < partition.end:
                continue
            stored, error = members.get(offset, length, crc)
            rows.append((None if null else member_id, n_bytes, stored, partition.path, offset, error))
            size += length
            if size >= self.batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _directory(self, path: str):
        return retried(lambda: _directory(path), self.tries)


class Members:
    """Members of one archive: the file is opened once and read in order, and opened again for each further try."""

    def __init__(self, path: str, tries: int):
        self.path, self.tries, self.file = path, tries, None

    def get(self, offset: int, length: int, crc: int) -> tuple[bytes | None, str | None]:
        try:
            return retried(lambda: self._one(offset, length, crc), self.tries), None
        except (OSError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"

    def _one(self, offset: int, length: int, crc: int) -> bytes:
        try:
            if self.file is None:
                self.file = _open(self.path, "rb")
            self.file.seek(offset)
            stored = self.file.read(length)
            if len(stored) != length or zlib.crc32(stored) != crc:
                raise ValueError(f"member at {offset} is damaged")
            return stored
        except (OSError, ValueError):
            file, self.file = self.file, None
            if file is not None:
                file.close()
            raise


def retried(f, tries: int):
    for k in range(tries):
        try:
            return f()
        except (OSError, ValueError):
            if k + 1 == tries:
                raise
            time.sleep(0.05 * 2**k)


def _directory(path: str) -> list[tuple]:
    with _open(path, "rb") as f:
        size = f.seek(0, 2)
        f.seek(size - FOOTER.size)
        at, n, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no archive")
        f.seek(at)
        return list(ENTRY.iter_unpack(f.read(n * ENTRY.size)))


_KINDS = {"member_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "archive": pa.string(), "offset": pa.int64(), "error": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS.values())], names=list(_KINDS))


def archive_list(path: str):
    """(path, size) of each archive that the written list names."""
    import pyarrow.dataset as ds

    data = ds.dataset(local_path(path) or path, format="parquet")
    if data.schema.names:
        for batch in data.to_batches(columns=["path", "size"]):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").option("list", folder of the written list)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member_id bigint, n_bytes bigint, media binary, archive string, offset bigint, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def load(spark: SparkSession, list_path: str, **options: object) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(list=list_path, **{k: str(v) for k, v in options.items()}).load()


def media_columns(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store and read back: member_id, n_bytes, media, archive, offset, error.

    One row for each row of ``docs``: null and empty texts are 576 bytes of 255, repeated rows and
    null ids are members like any other, an empty table gives none. Ids are cast to bigint. Other columns are
    ignored, whatever they are called.
    """
    return load(docs.sparkSession, store(docs, id=id, text=text))


def features(payload: bytes) -> str:
    """Of the samples read back: mean, deviation, entropy of the grey levels, mean step along a row and between rows."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    image = x.reshape(-1, WIDTH).astype(np.int16)
    across = np.abs(np.diff(image, axis=1)).mean()
    down = np.abs(np.diff(image, axis=0)).mean() if len(image) > 1 else 0.0
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};across={across:.4f};down={down:.4f}"


def described(media: DataFrame) -> DataFrame:
    """Per member: digests of the payload decoded from the stored form, and features. A member in error has nulls."""
    import hashlib

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"

    def run(batches):
        for batch in batches:
            out = []
            for member_id, n_bytes, stored, error in zip(*(batch.column(i) for i in range(4)), strict=True):
                stored = stored.as_py()
                if stored is None:
                    out.append((member_id.as_py(), n_bytes.as_py(), None, None, None, None, None, None, error.as_py()))
                    continue
                payload = decode_png(stored)
                out.append((member_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload), None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return media.select("member_id", "n_bytes", "media", "error").mapInArrow(run, schema)

"""BSON files, plain or xz-compressed: a Python data source with splits at document boundaries, and a writer.

A BSON document begins with its length, so boundaries can't be found from the middle of a file. A Spark job walks each plain file
once (a task a file, reading lengths as a stream) and writes where splits of about ``split_bytes`` begin; the data source then plans a
partition for each split, and tasks decode their splits alone. An xz file is one split, unpacked as a stream. Documents are given as JSON text
(object ids as hexadecimal digits, dates as ISO text in UTC, binary values in base64, decimals as text), with file and position.
A document that can't be decoded gives a row with an error, and ends its split; other splits are read on.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import lzma
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.operators.graph import cut

LENGTH = struct.Struct("<i")
#: Fixed value: the largest document that the format's databases take is 16 MB; lengths beyond this are damage.
MOST = 64 << 20


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _open(path: str, mode: str):
    if at := _local(path):
        return open(at, mode)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at) if "w" in mode else store.open_input_file(at)


# Documents


def _text(raw: bytes, at: int) -> tuple[str, int]:
    end = raw.index(b"\0", at)
    return raw[at:end].decode("utf-8", "replace"), end + 1


def _decimal(raw: bytes) -> str:
    """A 128-bit decimal: sign, exponent and coefficient in the usual form; infinities and no-numbers by name."""
    low, high = struct.unpack("<2Q", raw)
    sign, top = high >> 63, high >> 58 & 0x1F
    if top >= 0x1E:
        return "NaN" if top == 0x1F else "-Infinity" if sign else "Infinity"
    if high >> 61 & 3 == 3:
        exponent, digits = high >> 47 & 0x3FFF, 0  # a coefficient of this form is out of range, and counts as 0
    else:
        exponent, digits = high >> 49 & 0x3FFF, (high & (1 << 49) - 1) << 64 | low
    return str(decimal.Decimal((sign, tuple(map(int, str(digits))), exponent - 6176)))


def _value(kind: int, raw: bytes, at: int) -> tuple[object, int]:
    if kind == 0x01:
        (x,) = struct.unpack_from("<d", raw, at)
        return (x if x - x == 0 else str(x)), at + 8
    if kind in (0x02, 0x0D, 0x0E):
        (n,) = LENGTH.unpack_from(raw, at)
        return raw[at + 4 : at + 3 + n].decode("utf-8", "replace"), at + 4 + n
    if kind in (0x03, 0x04):
        (n,) = LENGTH.unpack_from(raw, at)
        inner = document(raw[at : at + n])
        return (list(inner.values()) if kind == 0x04 else inner), at + n
    if kind == 0x05:
        (n,) = LENGTH.unpack_from(raw, at)
        return base64.b64encode(raw[at + 5 : at + 5 + n]).decode(), at + 5 + n
    if kind == 0x07:
        return raw[at : at + 12].hex(), at + 12
    if kind == 0x08:
        return raw[at] != 0, at + 1
    if kind == 0x09:
        (ms,) = struct.unpack_from("<q", raw, at)
        return (datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)).isoformat(timespec="milliseconds") + "Z", at + 8
    if kind in (0x06, 0x0A, 0x7F, 0xFF):
        return None, at
    if kind == 0x0B:
        pattern, at = _text(raw, at)
        options, at = _text(raw, at)
        return f"/{pattern}/{options}", at
    if kind == 0x10:
        return LENGTH.unpack_from(raw, at)[0], at + 4
    if kind in (0x11, 0x12):
        return struct.unpack_from("<Q" if kind == 0x11 else "<q", raw, at)[0], at + 8
    if kind == 0x13:
        return _decimal(raw[at : at + 16]), at + 16
    raise ValueError(f"unknown kind {kind:#x} of value")


def document(raw: bytes) -> dict:
    """A whole document, its length included. ValueError if it is damaged."""
    try:
        if len(raw) < 5 or LENGTH.unpack_from(raw)[0] != len(raw) or raw[-1]:
            raise ValueError("a document's length is wrong")
        out, at = {}, 4
        while raw[at]:
            name, start = _text(raw, at + 1)
            out[name], at = _value(raw[at], raw, start)
        if at != len(raw) - 1:
            raise ValueError("a value goes beyond its document")
        return out
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError(f"{type(e).__name__}: {e}") from e


def encoded(value: dict) -> bytes:
    """A document of strings, numbers, booleans, nulls, times, bytes, lists and documents."""
    def one(name: str, x: object) -> bytes:
        key = name.encode() + b"\0"
        if x is None:
            return b"\x0a" + key
        if isinstance(x, bool):
            return b"\x08" + key + bytes([x])
        if isinstance(x, int):
            return b"\x12" + key + struct.pack("<q", x)
        if isinstance(x, float):
            return b"\x01" + key + struct.pack("<d", x)
        if isinstance(x, bytes):
            return b"\x05" + key + LENGTH.pack(len(x)) + b"\0" + x
        if isinstance(x, datetime.datetime):
            since = x - datetime.datetime(1970, 1, 1, tzinfo=x.tzinfo and datetime.UTC)
            return b"\x09" + key + struct.pack("<q", since // datetime.timedelta(milliseconds=1))
        if isinstance(x, dict):
            return b"\x03" + key + encoded(x)
        if isinstance(x, (list, tuple)):
            return b"\x04" + key + encoded({str(k): v for k, v in enumerate(x)})
        raw = str(x).encode() + b"\0"
        return b"\x02" + key + LENGTH.pack(len(raw)) + raw

    body = b"".join(one(k, v) for k, v in value.items())
    return LENGTH.pack(len(body) + 5) + body + b"\0"


def documents(stream, start: int, end: int | None) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(position, document, error) from a stream that stands at ``start``, up to ``end``; a damaged length or the end of the stream within a document is the last one."""
    at = start
    while end is None or at < end:
        head = stream.read(4)
        if not head:
            return
        n = LENGTH.unpack(head)[0] if len(head) == 4 else 0
        if not 5 <= n <= MOST:
            yield at, None, "ValueError: a document's length is wrong"
            return
        body = stream.read(n - 4)
        if len(body) != n - 4:
            yield at, None, "ValueError: a document is cut off"
            return
        yield at, head + body, None
        at += n


# Splits


def splits(spark: SparkSession, *paths: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(path, begin, finish) of all .bson and .xz files in files or folders, cut at document boundaries; ``finish`` is null for a whole xz file. Written."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length")
    files = cut(found.where(F.col("path").rlike(r"\.(bson|xz)$")))
    schema = "path string, begin bigint, finish bigint"

    def run(batches):
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path.endswith(".xz"):
                    yield _rows([(path, 0, None)])
                    continue
                rows, begin = [], 0
                with _open(path, "rb") as stream:
                    for at, _, error in documents(stream, 0, length):
                        if error is None and at - begin >= split_bytes:
                            rows.append((path, begin, at))
                            begin = at
                yield _rows([*rows, (path, begin, length)])

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "begin", "finish"])

    return cut(files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(run, schema))


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    finish: int | None


class BsonReader(DataSourceReader):
    def __init__(self, options: dict):
        self.splits = options["splits"]

    def partitions(self) -> list[Split]:
        import pyarrow.dataset as ds

        data = ds.dataset(_local(self.splits) or self.splits, format="parquet")
        rows = data.to_table(columns=["path", "begin", "finish"]).to_pylist() if data.schema.names else []
        return [Split(**r) for r in rows] or [Split("", 0, 0)]

    def read(self, partition: Split):
        if not partition.path:
            return
        with _open(partition.path, "rb") as file:
            if partition.finish is None:
                stream = lzma.LZMAFile(file)
            else:
                file.seek(partition.begin)
                stream = file
            held, size = [], 0
            for at, raw, error in self._each(stream, partition):
                text = None
                if error is None:
                    try:
                        text = json.dumps(document(raw), ensure_ascii=False)
                    except ValueError as e:
                        error = f"ValueError: {e}"
                held.append((partition.path, at, text, error))
                size += len(raw or b"") + 100
                if size >= 4 << 20 or len(held) >= 4096:
                    yield _batch(held)
                    held, size = [], 0
                if error:
                    break
            if held:
                yield _batch(held)

    def _each(self, stream, partition: Split):
        at = partition.begin
        try:
            for at, raw, error in documents(stream, partition.begin, partition.finish):
                yield at, raw, error
        except (lzma.LZMAError, EOFError) as e:
            yield at, None, f"{type(e).__name__}: {e}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "position": pa.int64(), "document": pa.string(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


class BsonDocuments(DataSource):
    """spark.read.format("bson_documents").option("splits", folder of the written splits)"""

    @classmethod
    def name(cls) -> str:
        return "bson_documents"

    def schema(self) -> str:
        return "file string, position bigint, document string, error string"

    def reader(self, schema) -> DataSourceReader:
        return BsonReader(dict(self.options))


def read_bson(spark: SparkSession, *paths: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(file, position, document, error) of all documents; parse ``document`` with ``from_json`` or ``parse_json``."""
    found = splits(spark, *paths, split_bytes=split_bytes)
    spark.dataSource.register(BsonDocuments)
    return spark.read.format("bson_documents").option("splits", found.inputFiles()[0].rpartition("/")[0]).load()


def write_bson(rows: DataFrame, folder: str, *, packed: bool = False) -> DataFrame:
    """Rows as documents, one file a task, ``packed`` by xz; (path, rows) of the files that finished tasks have written. A lost task's file isn't listed."""
    def run(batches):
        n, at = 0, f"{folder}/{uuid.uuid4().hex}.{'bson.xz' if packed else 'bson'}"
        if here := _local(at):
            os.makedirs(os.path.dirname(here), exist_ok=True)
        with _open(at, "wb") as file:
            out = lzma.LZMAFile(file, "wb", preset=1) if packed else file
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(encoded(row))
                    n += 1
            if packed:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([n], pa.int64())], names=["path", "rows"])

    return cut(rows.mapInArrow(run, "path string, rows bigint"))

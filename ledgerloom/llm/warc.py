"""Web archives in ZIP packages: WARC records are written into stored members, and read by ranges without unpacking.

A package is a ZIP file with ``archive/data.warc.gz`` (a gzip member for each record) and ``indexes/index.cdxj`` (a line
for each record: key, time, and JSON with offset and length), both stored, so that a byte of a member is a byte of the file.

Reading is a Python data source. Its partitions are byte ranges over packages. A task parses the package's central
directory (the ZIP64 one where there is one), locates the stored archive members and indexes, and takes the records that start in
its range: by the index with one ranged read for each run of neighbours, or, where no index names a member, by walking
it. A record that fails (short read, damaged gzip, length, digest) is read again on its own; one that keeps failing gives a
row with an error and holds up no other.

Equal payloads are stored once: of rows with equal payloads the first is a ``response``, the others are ``revisit`` records with
the response's id, digest and length but without the payload. Which is first is an aggregate by digest; only digests that occur
more than once are joined back, so neither payloads nor single rows are shuffled by a common digest (beyond the bound of
a broadcast, Spark splits a skewed digest, whose other side has one row).
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.llm.media import ByteRange, _make_folder, archive_list, retried
from ledgerloom.llm.media import _open as open_file
from ledgerloom.llm.shared import bounded, new_folder, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A record's id is this and the row's id as text (nothing for null).
ID_PREFIX = "urn:x-row:"

# Writing


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header_value(text: str) -> str:
    """White space and control signs as %XX: a value can't end its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def page_record(row_id: object, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit where ``payload`` is None. ``size`` and ``digest`` are the full payload's in both."""
    name = f"{ID_PREFIX}{header_value('' if row_id is None else str(row_id))}"
    headers = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", header_value(url) if url else name),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if payload is None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{header_value(refers_to or '')}>")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return warc_record(headers, head + (payload or b""))


class PackageWriter:
    """Packages whose archive member has about ``most`` bytes, one after another. A record is streamed out as it comes; only index lines are kept."""

    def __init__(self, folder: str, most: int, level: int = 4):
        self.folder, self.most, self.level, self.file, self.done = folder, most, level, None, []

    def add(self, url: str, record: bytes, digest: str, date: str) -> None:
        if self.file is None:
            self._start(date)
        stored = gzip.compress(record, self.level, mtime=0)
        entry = {"url": url, "digest": f"sha1:{digest}", "offset": str(self.at), "length": str(len(stored)), "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{url} {re.sub('[^0-9]', '', date)} {json.dumps(entry)}\n")
        self._put(stored)
        if self.at >= self.most:
            self.close()

    def _start(self, date: str) -> None:
        self.path, self.at, self.lines = f"{self.folder}/{uuid.uuid4().hex}.wacz", 0, []
        self.file = open_file(self.path, "wb")
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        info = b"software: ledgerloom\r\nformat: WARC File Format 1.1\r\n"
        self._put(gzip.compress(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info), mtime=0))

    def _put(self, stored: bytes) -> None:
        self.member.write(stored)
        self.at += len(stored)

    def close(self) -> None:
        if self.file is not None:
            self.member.close()
            self.zip.writestr(INDEX, "".join(sorted(self.lines)).encode("utf-8", "surrogatepass"))
            self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
            self.zip.close()
            size = self.file.tell()
            self.file.close()
            self.done.append((self.path, size, len(self.lines)))
            self.file = None


def first_rows(keyed: DataFrame, least: int) -> DataFrame:
    """Digests that several rows of ``keyed`` (id, url, digest, size) share: digest, first_id, first_url, and how many rows equal that first one in both. Written."""
    same = keyed.where(F.col("size") >= least).groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("url").isNull(), F.col("url"), F.col("n"))
    found = same.groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1)
    return written(found.select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.n").alias("n")), "first")


def classified(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Per row of ``pages``: id, url, digest (SHA-1, hex), size, payload (null for revisits), refers_to (of revisits: the response's id; null where that is null).

    Of rows with equal payloads of at least ``least`` bytes that with the smallest id (nulls last; then the smallest url) is the
    response. Rows that are equal in id, url and payload are told apart by number only: one is the response. A null ``html`` is an
    empty payload. Other columns are ignored.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).select("id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    firsts = first_rows(rows.drop("payload"), least)
    again = rows.join(bounded(firsts), "digest", "left")
    first = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    response = F.col("n").isNull() | first
    revisit = [F.when(response, F.col("payload")).alias("payload"), F.when(~response, F.col("first_id")).alias("refers_to")]
    columns = ["id", "url", "digest", "size"]
    tied = firsts.where(F.col("n") > 1)
    if tied.isEmpty():
        return again.select(*columns, *revisit)
    repeated = first & (F.col("n") > 1)
    one = again.where(repeated).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("id", "url", "size", "payload")])
    of_one = one.select(*columns, "payload", F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to"))
    rest = again.where(F.coalesce(~repeated, F.lit(True))).select(*columns, *revisit)
    size = one.select("digest", "size")
    block = 10_000
    blocks = tied.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / block))).alias("block"))
    spread = blocks.repartition(F.col("digest"), F.col("block"))
    others = spread.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col("n") - 1 - F.col("block") * block))).alias("k")).join(size, "digest")
    of_others = others.select(F.col("first_id").alias("id"), F.col("first_url").alias("url"), "digest", "size", F.lit(None).cast("binary").alias("payload"), F.col("first_id").alias("refers_to"))
    return rest.unionByName(of_one).unionByName(of_others)


def store(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, package_bytes: int = 128 << 20) -> str:
    """Write a record for every row; returns where the list of packages (path, size, members) is written. See ``classified`` for what is what."""
    folder = new_folder(pages.sparkSession, "warc")
    _make_folder(folder)

    def run(batches):
        writer = PackageWriter(folder, package_bytes)
        date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            for row_id, link, digest, size, payload, refers_to, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sha = base32(bytes.fromhex(digest))
                record = page_record(row_id, link, sha, size, payload if response else None, refers_to, date)
                writer.add(header_value(link) if link else f"{ID_PREFIX}{row_id}", record, sha, date)
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in writer.done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "members"])

    rows = classified(pages, id=id, url=url, html=html, least=least)
    rows = rows.select(F.col("id").cast("string"), "url", "digest", "size", "payload", F.col("refers_to").cast("string"), F.col("payload").isNotNull())
    packages = rows.mapInArrow(run, "path string, size bigint, members bigint")
    packages.write.parquet(at := new_folder(pages.sparkSession, "packages"))
    return at


def package_list(spark: SparkSession, *paths: str) -> str:
    """Where the list of the packages in given files or folders is written, for packages that something else wrote. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    found.select("path", F.col("length").alias("size"), F.lit(None).cast("long").alias("members")).write.parquet(at := new_folder(spark, "packages"))
    return at


# Reading ZIP directories

_END, _END64, _LOCATOR = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
_ENTRY, _LOCAL = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


@dataclass(frozen=True)
class Member:
    """A member of a package; ``start`` is where its bytes begin in the file."""

    name: str
    method: int
    stored: int
    size: int
    start: int


def _at(file, offset: int, n: int, what: str) -> bytes:
    file.seek(offset)
    got = file.read(n)
    if len(got) != n:
        raise ValueError(f"{what} is cut off")
    return got


def _wide(extra: bytes, values: dict[str, int]) -> dict[str, int]:
    """64-bit values from the ZIP64 extra field, which has those that are all ones in the entry, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            field, out, k = extra[at + 4 : at + 4 + n], dict(values), 0
            for name in values:
                if values[name] == 0xFFFFFFFF:
                    (out[name],) = struct.unpack_from("<Q", field, k)
                    k += 8
            return out
        at += 4 + n
    if any(v == 0xFFFFFFFF for v in values.values()):
        raise ValueError("a ZIP64 size or offset is missing")
    return values


def zip_directory(file) -> list[Member]:
    """All members by the central directory, which may be ZIP64 and may follow other data. ValueError if it is damaged."""
    try:
        return _zip_directory(file)
    except struct.error as e:
        raise ValueError(f"damaged directory: {e}") from e


def _zip_directory(file) -> list[Member]:
    length = file.seek(0, 2)
    tail_at = max(0, length - _END.size - 0xFFFF)
    tail = _at(file, tail_at, length - tail_at, "end of directory")
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + _END.size > len(tail) or _END.unpack_from(tail, end)[7] + end + _END.size > len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no ZIP directory")
    _, _, _, _, count, size, offset, _ = _END.unpack_from(tail, end)
    end_at = tail_at + end
    if end_at >= _LOCATOR.size and (locator := _at(file, end_at - _LOCATOR.size, _LOCATOR.size, "locator"))[:4] == b"PK\6\7":
        end64 = _LOCATOR.unpack(locator)[2]
        fields = _at(file, end64, _END64.size, "ZIP64 end of directory")
        if fields[:4] != b"PK\6\6":  # something stands before the package: the record lies right before its locator
            end64 = end_at - _LOCATOR.size - _END64.size
            fields = _at(file, end64, _END64.size, "ZIP64 end of directory")
        if fields[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 directory where the locator says")
        count, size, offset = _END64.unpack(fields)[7:]
        end_at = end64
    shift = end_at - size - offset
    if shift < 0:
        raise ValueError("the directory doesn't fit into the file")
    directory, at, out = _at(file, offset + shift, size, "directory"), 0, []
    for _ in range(count):
        signature, _, _, _, method, _, _, _, stored, full, n_name, n_extra, n_comment, _, _, _, header = _ENTRY.unpack_from(directory, at)
        if signature != b"PK\1\2":
            raise ValueError("a directory entry is damaged")
        name = directory[at + _ENTRY.size : at + _ENTRY.size + n_name]
        extra = directory[at + _ENTRY.size + n_name : at + _ENTRY.size + n_name + n_extra]
        wide = _wide(extra, {"full": full, "stored": stored, "header": header})
        start = wide["header"] + shift
        local = _LOCAL.unpack(_at(file, start, _LOCAL.size, "local header"))
        if local[0] != b"PK\3\4":
            raise ValueError(f"no member at {start}")
        out.append(Member(name.decode("utf-8", "replace"), method, wide["stored"], wide["full"], start + _LOCAL.size + local[9] + local[10]))
        at += _ENTRY.size + n_name + n_extra + n_comment
    return out


def _read(path: str, offset: int, n: int) -> bytes:
    """A range of a file that is opened for it alone."""
    with open_file(path, "rb") as file:
        return _at(file, offset, n, "a run of records")


class Window(io.RawIOBase):
    """A member's bytes as a file of their own."""

    def __init__(self, file, start: int, length: int):
        self.file, self.start, self.length, self.at = file, start, length, 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        self.file.seek(self.start + self.at)
        got = self.file.read(min(len(into), self.length - self.at))
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


# Reading records


@dataclass(frozen=True)
class Record:
    record_id: str | None
    record_type: str | None
    target_uri: str | None
    date: str | None
    payload_digest: str | None
    payload_bytes: int | None
    refers_to: str | None
    payload: bytes | None


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with a blank goes on with the one before."""
    out, name = {}, None
    for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse_record(raw: bytes) -> Record:
    """A whole uncompressed record. ValueError if its length or its payload's digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not gap:
        raise ValueError("no WARC record")
    fields = _fields(head)
    n = int(fields.get("content-length", "-1"))
    if n < 0 or len(rest) < n:
        raise ValueError("a record is cut off")
    payload, kind = rest[:n], fields.get("warc-type")
    size = n
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = payload.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit":
            size = int(_fields(http).get("content-length", "0"))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        payload = None
    else:
        own = base32(hashlib.sha1(payload).digest())
        if digest not in (None, own):
            raise ValueError("a payload doesn't have its digest")
        digest = own
    bare = lambda name: fields[name].removeprefix("<").removesuffix(">") if name in fields else None
    return Record(bare("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), digest, size, bare("warc-refers-to"), payload)


def inflated(stored: bytes) -> bytes:
    """A record as it is stored: a gzip member, or plain."""
    if stored[:2] != b"\x1f\x8b":
        return stored
    try:
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(stored)
    except zlib.error as e:
        raise ValueError(f"damaged gzip member: {e}") from e
    if not unpack.eof:
        raise ValueError("a gzip member is cut off")
    return raw


def _index_entries(file, member: Member) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of every line of an index."""
    lines = io.BufferedReader(Window(file, member.start, member.stored), 1 << 20)
    for line in gzip.GzipFile(fileobj=lines) if member.name.endswith(".gz") else lines:
        start = line.find(b"{")
        if start >= 0:
            entry = json.loads(line[start:])
            yield entry["filename"], int(entry["offset"]), int(entry["length"])


def walked(file, member: Member) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, raw record, error) of a member's records, one after another, without an index. Stops at damage, as nothing says where the next record is."""
    data, at, end = io.BufferedReader(Window(file, member.start, member.stored), 1 << 20), 0, member.stored
    try:
        while at < end:
            if data.peek(2)[:2] == b"\x1f\x8b":
                unpack, parts, n = zlib.decompressobj(31), [], 0
                while not unpack.eof:
                    block = data.peek(1)
                    if not block:
                        raise ValueError("a gzip member is cut off")
                    parts.append(unpack.decompress(block))
                    used = len(block) - len(unpack.unused_data)
                    data.read(used)
                    n += used
                yield at, b"".join(parts), None
            else:
                head = []
                while (line := data.readline()) not in (b"\r\n", b""):
                    head.append(line)
                top = b"".join(head) + line
                length = int(_fields(top).get("content-length", "-1"))
                body = data.read(length + 4) if length >= 0 else b""
                if length < 0 or len(body) != length + 4:
                    raise ValueError("a record is cut off")
                yield at, top + body, None
                n = len(top) + len(body)
            at += n
    except (ValueError, zlib.error) as e:
        yield at, None, f"{type(e).__name__}: {e}"


@dataclass
class Ranges(InputPartition):
    """What one task reads: small packages together, a large one by parts."""

    parts: list[ByteRange]


class PackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.list_path = options["list"]
        self.range_bytes = int(options.get("range_bytes", 0))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.tries = int(options.get("tries", 3))
        self.payload = options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[Ranges]:
        """Ranges of 32 MB, or of as much more as keeps their number near 100,000, if ``range_bytes`` is not given."""
        packages = list(archive_list(self.list_path))
        step = self.range_bytes or max(32 << 20, sum(size for _, size in packages) // 100_000)
        out, room = [], 0
        for path, size in packages:
            for at in range(0, size, step):
                part = ByteRange(path, at, min(size, at + step))
                n = part.end - part.start
                if n > room:
                    out.append(Ranges([]))
                    room = step
                out[-1].parts.append(part)
                room -= n
        return out or [Ranges([])]

    def read(self, partition: Ranges):
        rows, size = [], 0
        for part in partition.parts:
            for row in self._rows(part):
                rows.append(row)
                size += len(row[7] or b"") + 500
                if size >= self.batch_bytes:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, part: ByteRange) -> Iterator[tuple]:
        try:
            members, indexes = retried(lambda: self._plan(part), self.tries)
        except (OSError, ValueError) as e:
            if part.start == 0:
                yield self._failed(part.path, None, None, e)
            return
        for member in members:
            if member.method != 0:
                if part.start <= member.start < part.end:
                    yield self._failed(part.path, member.name, member.start, ValueError("a compressed member can't be read by ranges"))
            elif member.name in indexes:
                yield from self._indexed(part, member, indexes[member.name])
            elif part.start <= member.start < part.end:
                yield from self._walked(part, member)

    def _plan(self, part: ByteRange) -> tuple[list[Member], dict[str, list[tuple[int, int]]]]:
        """Archive members, and of those that an index names the (offset, length) of all records that start in the range, by offset."""
        with open_file(part.path, "rb") as file:
            found = zip_directory(file)
            members = [m for m in found if re.search(r"\.warc(\.gz)?$", m.name)]
            by_name = {m.name.rpartition("/")[2]: m for m in members}
            indexes: dict[str, list[tuple[int, int]]] = {}
            for index in found:
                if re.search(r"\.cdxj?(\.gz)?$", index.name) and index.method == 0:
                    for name, offset, length in _index_entries(file, index):
                        member = by_name.get(name.rpartition("/")[2])
                        if member is not None:
                            mine = indexes.setdefault(member.name, [])
                            if part.start <= member.start + offset < part.end:
                                mine.append((offset, length))
        return members, {name: sorted(set(x)) for name, x in indexes.items()}

    def _indexed(self, part: ByteRange, member: Member, entries: list[tuple[int, int]]) -> Iterator[tuple]:
        i = 0
        while i < len(entries):
            j, start = i + 1, entries[i][0]
            end = start + entries[i][1]
            while j < len(entries) and entries[j][0] == end and end + entries[j][1] - start <= self.batch_bytes:
                end += entries[j][1]
                j += 1
            try:
                block = retried(lambda at=member.start + start, n=end - start: _read(part.path, at, n), self.tries)
            except (OSError, ValueError):
                block = b""
            for offset, length in entries[i:j]:
                try:
                    row = self._row(part.path, member, offset, inflated(block[offset - start : offset - start + length]))
                except ValueError:
                    row = self._again(part.path, member, offset, length)
                yield row
            i = j

    def _again(self, path: str, member: Member, offset: int, length: int) -> tuple:
        """One record on its own, from a file opened anew for each try."""

        def one() -> tuple:
            return self._row(path, member, offset, inflated(_read(path, member.start + offset, length)))

        try:
            return retried(one, self.tries)
        except (OSError, ValueError) as e:
            return self._failed(path, member.name, member.start + offset, e)

    def _walked(self, part: ByteRange, member: Member) -> Iterator[tuple]:
        with open_file(part.path, "rb") as file:
            for offset, raw, error in walked(file, member):
                if error:
                    yield self._failed(part.path, member.name, member.start + offset, error)
                    continue
                try:
                    row = self._row(part.path, member, offset, raw)
                except ValueError as e:
                    row = self._failed(part.path, member.name, member.start + offset, e)
                if row[1] != "warcinfo":
                    yield row

    def _row(self, path: str, member: Member, offset: int, raw: bytes) -> tuple:
        r = parse_record(raw)
        return (r.record_id, r.record_type, r.target_uri, r.date, r.payload_digest, r.payload_bytes, r.refers_to, r.payload if self.payload else None, path, member.name, member.start + offset, None)

    def _failed(self, path: str, member: str | None, offset: int | None, error: Exception | str) -> tuple:
        return (*[None] * 8, path, member, offset, error if isinstance(error, str) else f"{type(error).__name__}: {error}")


_KINDS = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.string(), "payload": pa.binary(), "package": pa.string(), "member": pa.string(), "offset": pa.int64(), "error": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))


class WarcPackages(DataSource):
    """spark.read.format("warc_packages").option("list", folder of the written list)"""

    @classmethod
    def name(cls) -> str:
        return "warc_packages"

    def schema(self) -> str:
        return "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes bigint, refers_to string, payload binary, package string, member string, offset bigint, error string"

    def reader(self, schema) -> DataSourceReader:
        return PackageReader(dict(self.options))


def load(spark: SparkSession, list_path: str, **options: object) -> DataFrame:
    """A row for each record; damaged ones have an error and nulls. ``payload=False`` leaves payloads out (they are still checked)."""
    spark.dataSource.register(WarcPackages)
    return spark.read.format("warc_packages").options(list=list_path, **{k: str(v) for k, v in options.items()}).load()


def row_id(record_id: str, kind: str = "bigint"):
    """The row's id out of a column with record ids, as ``kind``; null for a null id."""
    return F.nullif(F.substring(F.col(record_id), len(ID_PREFIX) + 1, 1 << 30), F.lit("")).cast(kind)

"""WARC packages: against brute force, another ZIP reader, ZIP64, packages that something else wrote, damage and awkward rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries, warc
from ledgerloom.llm.media import ByteRange
from ledgerloom.llm.shared import local_path

SCHEMA = "page_id bigint, url string, html string"


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def by_hand(rows, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row."""
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[(html or "").encode()].append((page_id is None, page_id or 0, url is None, url or "", page_id))
    out = []
    for raw, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            again = k > 0 and len(raw) >= least
            out.append((m[4], len(raw), digest(raw), "revisit" if again else "response", members[0][4] if again else None))
    return sorted(out, key=str)


def read(spark, rows, least=0, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("x")).withColumn("n", F.lit(1)).withColumn("payload", F.lit("p")).withColumn("first_id", F.lit(0))
    return warc.load(spark, warc.store(df, least=least), **options)


def result(records):
    got = records.select(warc.row_id("record_id"), "payload_bytes", "payload_digest", "record_type", warc.row_id("refers_to")).collect()
    return sorted(map(tuple, got), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    got = queries.QUERIES["op11_warc"](spark, sf_dir).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == by_hand(map(tuple, pages))
    assert all(r.error is None for r in got)


AWKWARD = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (3, "http://b/", "same"), (3, "http://b/", "same"), (None, "http://n/", "same"), (None, None, "alone"), (None, None, "alone"), (1, "http://e/", None), (2, "http://e\r\nWARC-Type: x/é 😀", ""), (7, "u", "é" * 400_000), (8, "u", "é" * 400_000), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_awkward_rows(spark, least):
    records = read(spark, AWKWARD, least).cache()
    assert result(records) == by_hand(AWKWARD, least)
    whole = {r.payload_digest: r.payload for r in records.where("record_type = 'response'").collect()}
    assert all(bytes(p) == (h or "").encode() for _, _, h in AWKWARD for p in [whole[digest((h or "").encode())]])
    assert records.where("record_type = 'revisit' AND payload IS NOT NULL").isEmpty() and records.where("error IS NOT NULL").isEmpty()
    assert {r[0] for r in records.where("refers_to IS NOT NULL").select("record_type").collect()} == {"revisit"}
    records.unpersist()


def test_beyond_the_broadcast_bound_and_many_repeats(spark, monkeypatch):
    """Digests joined by a shuffle; one row repeated more often than a block of revisits is long."""
    monkeypatch.setattr(warc, "bounded", lambda df: df)
    rows = spark.range(25_001).select(F.lit(4).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit("copy").alias("html")).union(spark.createDataFrame([(2, "u", "other"), (6, "u", "other")], SCHEMA))
    got = Counter(result(warc.load(spark, warc.store(rows))))
    assert got == {(4, 4, digest(b"copy"), "response", None): 1, (4, 4, digest(b"copy"), "revisit", 4): 25_000, (2, 5, digest(b"other"), "response", None): 1, (6, 5, digest(b"other"), "revisit", 2): 1}


def test_an_empty_table(spark):
    assert read(spark, []).collect() == []


def packages(spark, rows, **options):
    at = warc.store(spark.createDataFrame(rows, SCHEMA).coalesce(1), **options)
    return at, [local_path(r.path) for r in spark.read.parquet(at).collect()]


def test_packages_are_zip_files_with_standard_records(spark):
    _, (path,) = packages(spark, AWKWARD)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        raw = gzip.decompress(z.read(warc.ARCHIVE))
        lines = z.read(warc.INDEX).decode().splitlines()
        assert lines == sorted(lines) and len(lines) == len(AWKWARD)
        for line in lines:
            entry = json.loads(line[line.index("{") :])
            one = z.read(warc.ARCHIVE)[int(entry["offset"]) :][: int(entry["length"])]
            assert gzip.decompress(one).startswith(b"WARC/1.1\r\nWARC-Type: re")
    assert raw.count(b"WARC-Type: revisit\r\n") == sum(r[3] == "revisit" for r in by_hand(AWKWARD)) and raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    with open(path, "rb") as f:
        assert [(m.name, m.size, m.stored) for m in warc.zip_directory(f)] == [(i.filename, i.file_size, i.compress_size) for i in zipfile.ZipFile(path).infolist()]


def rows_of(path, **options):
    reader = warc.PackageReader({"list": "", "tries": "1"} | options)
    size = os.path.getsize(path)
    step = int(options.get("step", size))
    return [r for at in range(0, size, step) for b in reader.read(warc.Ranges([ByteRange(path, at, min(size, at + step))])) for r in b.to_pylist()]


def test_ranges_split_a_package_and_lose_nothing(spark):
    rows = [(k, f"http://h/{k}", f"page {k} " * 40) for k in range(200)]
    at, (path,) = packages(spark, rows)
    want = [f"{warc.ID_PREFIX}{k}" for k in range(200)]
    for step in (1 << 30, 1000, 77):
        got = [r["record_id"] for r in rows_of(path, step=str(step), batch_bytes="3000")]
        assert sorted(got) == sorted(want)
    assert result(warc.load(spark, at, range_bytes=2000)) == by_hand(rows)


def test_small_packages_share_a_task(spark):
    at, paths = packages(spark, [(k, "u", f"page {k} " * 40) for k in range(60)], package_bytes=1000)
    reader = warc.PackageReader({"list": local_path(at)})
    assert len(paths) > 5 and len(reader.partitions()) == 1
    assert len(warc.PackageReader({"list": local_path(at), "range_bytes": "3000"}).partitions()) > 2
    assert warc.load(spark, at).count() == 60


def test_zip64_directories(tmp_path, monkeypatch):
    """Limits of the library are lowered, so that its writer makes ZIP64 entries and a ZIP64 end of directory."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = str(tmp_path / "x.wacz")
    record = warc.page_record(7, "http://x/", digest(b"hello"), 5, b"hello", None, "2024-01-01T00:00:00Z")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("first", b"f" * 150)
        z.writestr("a/one.warc", record)
        z.writestr("a/two.warc.gz", gzip.compress(record))
        z.comment = b"PK\5\6 is no directory"
    data = open(path, "rb").read()
    assert b"PK\6\6" in data and b"PK\6\7" in data
    for prefix in (b"", b"#!/bin/sh\n"):  # a package may stand behind other data
        (tmp_path / "y.wacz").write_bytes(prefix + data)
        with open(tmp_path / "y.wacz", "rb") as f:
            found = {m.name: (m.start - len(prefix), m.size) for m in warc.zip_directory(f)}
        assert {k: data[s : s + n] for k, (s, n) in found.items()} == {"first": b"f" * 150, "a/one.warc": record, "a/two.warc.gz": gzip.compress(record)} or data[found["a/one.warc"][0] :].startswith(record)
        got = rows_of(str(tmp_path / "y.wacz"))
        assert [(r["record_id"], r["payload"], r["member"], r["error"]) for r in got] == [(f"{warc.ID_PREFIX}7", b"hello", m, None) for m in ("a/one.warc", "a/two.warc.gz")]


def test_packages_of_another_writer(spark, tmp_path):
    """Plain and gzipped archives without an index, a gzipped index, and a compressed member, which is reported."""
    record = lambda k: warc.page_record(k, f"http://x/{k}", digest(b"p%d" % k), 2, b"p%d" % k, None, "2024-01-01T00:00:00Z")
    info = warc.warc_record([("WARC-Type", "warcinfo")], b"x: y\r\n")
    folded = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:\r\n  z>\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n"
    with zipfile.ZipFile(tmp_path / "a.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/plain.warc", info + record(1) + record(2) + folded)
        z.writestr("archive/packed.warc.gz", b"".join(gzip.compress(record(k)) for k in (3, 4)))
        one = gzip.compress(record(5))
        z.writestr("archive/indexed.warc.gz", one)
        z.writestr("indexes/i.cdx.gz", gzip.compress(b'x 2024 {"filename": "indexed.warc.gz", "offset": "0", "length": "%d"}\n' % len(one)))
        z.writestr("archive/deflated.warc", record(6), zipfile.ZIP_DEFLATED)
    got = warc.load(spark, warc.package_list(spark, str(tmp_path))).collect()
    assert sorted(r.record_id for r in got if r.record_id) == sorted([f"{warc.ID_PREFIX}{k}" for k in range(1, 6)] + ["urn: z"])
    assert [r.error for r in got if r.record_id is None] == ["ValueError: a compressed member can't be read by ranges"]
    assert [(bytes(r.payload), r.payload_bytes, r.payload_digest) for r in got if r.record_type == "resource"] == [(b"abc", 3, digest(b"abc"))]


def test_damaged_records_hold_up_no_other(spark):
    _, (path,) = packages(spark, [(k, "u", f"page {k} " * 30) for k in range(20)])
    with open(path, "rb") as f:
        member = next(m for m in warc.zip_directory(f) if m.name == warc.ARCHIVE)
        entries = sorted((o, n) for _, o, n in warc._index_entries(f, next(m for m in warc.zip_directory(f) if m.name == warc.INDEX)))
    data = bytearray(open(path, "rb").read())
    for k in (3, 11):
        data[member.start + entries[k][0] + entries[k][1] // 2] ^= 0xFF
    open(path, "wb").write(data)
    got = rows_of(path)
    assert len(got) == 20 and [r["error"] is not None for r in got] == [k in (3, 11) for k in range(20)]
    open(path, "wb").write(data[: len(data) // 2])
    assert [r["error"] for r in rows_of(path)] == ["ValueError: no ZIP directory"]


def test_a_failed_read_is_tried_again(spark, monkeypatch):
    _, (path,) = packages(spark, [(k, "u", f"page {k}") for k in range(5)])
    opened, really = [], warc.open_file

    def flaky(p, mode):
        opened.append(p)
        if len(opened) in (1, 3, 6):
            raise OSError("away")
        f = really(p, mode)
        return io.BytesIO(f.read(700)) if len(opened) in (4, 5) else f  # ranged reads are short

    monkeypatch.setattr(warc, "open_file", flaky)
    got = rows_of(path, tries="3")
    assert len(got) == 5 and all(r["error"] is None for r in got) and len(opened) > 6

"""BSON splits, shuffle buffers, pipeline events, JSON flattening, sections as table functions, parallel isotonic regression."""

from __future__ import annotations

import datetime
import json
import lzma
import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import isotonic, monitor, nested, sections
from ledgerloom.sources import bson
from ledgerloom.streaming import buffer


# BSON


def raw(kind: int, name: str, body: bytes) -> bytes:
    return bytes([kind]) + name.encode() + b"\0" + body


def whole(*elements: bytes) -> bytes:
    body = b"".join(elements)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def test_bson_values_of_every_kind():
    at = datetime.datetime(1969, 12, 31, 23, 59, 59, 500_000)
    given = {"d": 1.5, "s": "é😀", "o": {"x": [1, {"y": None}]}, "b": b"\0\xff", "t": True, "n": None, "i": -(1 << 40), "at": at, "e": {}, "l": []}
    want = given | {"b": "AP8=", "at": "1969-12-31T23:59:59.500Z"}
    assert bson.document(bson.encoded(given)) == want
    other = whole(raw(0x07, "id", bytes(range(12))), raw(0x10, "i", struct.pack("<i", -5)), raw(0x0B, "r", b"a+\0i\0"), raw(0x11, "ts", struct.pack("<Q", 7)), raw(0xFF, "min", b""), raw(0x06, "u", b""), raw(0x0D, "js", struct.pack("<i", 2) + b"f\0"))
    assert bson.document(other) == {"id": bytes(range(12)).hex(), "i": -5, "r": "/a+/i", "ts": 7, "min": None, "u": None, "js": "f"}
    number = lambda coefficient, exponent, sign=0: struct.pack("<2Q", coefficient & (1 << 64) - 1, sign << 63 | exponent + 6176 << 49 | coefficient >> 64)
    for text, (c, e, sign) in {"12.34": (1234, -2, 0), "-0.001": (1, -3, 1), "1E+3": (1, 3, 0)}.items():
        assert bson.document(whole(raw(0x13, "x", number(c, e, sign))))["x"] == text
    assert bson.document(whole(raw(0x13, "x", b"\0" * 15 + b"\x7c")))["x"] == "NaN"
    for broken in (b"", whole(raw(0x01, "x", b"ab")), whole(raw(0x44, "x", b"")), whole()[:-1] + b"x"):
        with pytest.raises(ValueError):
            bson.document(broken)


def test_bson_is_read_by_splits(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"k": k, "note": "pay " * rng.randrange(60), "when": datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)} for k in range(500)]
    for name, part in (("a.bson", rows[:200]), ("b.bson", rows[200:350]), ("c.bson.xz", rows[350:]), ("empty.bson", []), ("other.txt", rows)):
        data = b"".join(map(bson.encoded, part))
        (tmp_path / name).write_bytes(lzma.compress(data) if name.endswith("xz") else data)
    found = bson.splits(spark, str(tmp_path), split_bytes=3000).collect()
    assert len([s for s in found if s.path.endswith("a.bson")]) > 5
    for s in found:  # splits meet, and begin at documents
        if s.finish is not None and s.begin:
            assert any(x.path == s.path and x.finish == s.begin for x in found)
    df = bson.read_bson(spark, str(tmp_path), split_bytes=3000)
    assert df.rdd.getNumPartitions() == len(found)
    got = [json.loads(r.document) for r in df.collect()]
    assert sorted(got, key=lambda r: r["k"]) == [r | {"when": r["when"].isoformat(timespec="milliseconds") + "Z"} for r in rows]
    assert df.where("error IS NOT NULL").isEmpty()


def test_bson_damage_ends_a_split_alone(spark, tmp_path):
    docs = [bson.encoded({"k": k, "t": "x" * 100}) for k in range(100)]
    broken = bytearray(b"".join(docs))
    at = len(docs[0]) * 50
    broken[at + 4] = 0x44  # a kind of value that there is not
    (tmp_path / "a.bson").write_bytes(broken)
    (tmp_path / "b.bson").write_bytes(b"".join(docs)[:-20])
    (tmp_path / "c.xz").write_bytes(lzma.compress(b"".join(docs))[:-40])
    rows = bson.read_bson(spark, str(tmp_path), split_bytes=1000).collect()
    by = lambda name: [r for r in rows if r.file.endswith(name)]
    assert [r.position for r in by("a.bson") if r.error] == [at] and len(by("a.bson")) > 90
    assert len([r for r in by("b.bson") if r.error is None]) == 99 and [r.error for r in by("b.bson") if r.error] == ["ValueError: a document is cut off"]
    assert [r.error is None for r in by("c.xz")].count(False) == 1


def test_bson_written_files_are_listed(spark, tmp_path):
    listed = bson.write_bson(spark.range(10).repartition(2), f"file://{tmp_path}/out").collect()
    assert sum(r.rows for r in listed) == 10 and all(os.path.exists(bson._local(r.path)) for r in listed)


# Shuffle buffer


def test_buffer_gives_half_and_loses_nothing():
    rng = random.Random(3)
    new, out, held = [str(k) for k in range(95)], [], []
    while new:
        n = rng.randrange(1, 9)
        some, held = buffer.through_buffer(held, len(out), new[:n], 10, 42, 0)
        out, new = out + some, new[n:]
        assert len(held) < 10 and len(out) % 5 == 0
    assert sorted(out + held, key=int) == [str(k) for k in range(95)] and out != sorted(out, key=int)
    assert buffer.through_buffer([], 0, [str(k) for k in range(95)], 10, 42, 0) == (out, held)  # batches don't matter


def test_stream_through_buffers(spark, tmp_path):
    """The order of a seed repeats and is another one for another seed; records wait across micro-batches; none is lost."""
    source = spark.range(240).select("id", F.concat(F.lit("t"), "id").alias("t"), F.when(F.col("id") % 5 == 0, F.col("id") / 4).alias("x"))
    source.sort("id").coalesce(1).write.option("maxRecordsPerFile", 40).json(str(tmp_path / "in"))

    def run(name, seed, size=25):
        rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = buffer.shuffled_once(rows, "id", f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", size=size, lanes=2, seed=seed)
        return [tuple(r) for r in out.sort("lane", "place").collect()]

    a, b, c = run("a", 1), run("b", 1), run("c", 2)
    assert a == b and a != c
    assert sorted(r[2:] for r in a) == sorted(tuple(r) for r in source.collect())
    for lane in (0, 1):
        mine = [r for r in a if r[0] == lane]
        assert [r[1] for r in mine] == list(range(len(mine)))
        early = [r[2] for r in mine[:12]]  # the first half buffer has records of several files
        assert early != sorted(early) and max(early) >= 40
    assert len(run("d", 1, size=10_000)) == 240  # nothing was given out before the end


# Events


def test_events_of_a_batch(spark):
    got, watch = [], monitor.Monitor()
    watch.add_callback(lambda event, data: 1 / 0)
    watch.add_callback(lambda event, data: got.append((event, data)))
    rows = watch.stage(spark.range(100), "all", total=F.sum("id"))
    kept = watch.stage(rows.where("id % 3 = 0"), "thirds", most=F.max("id"))
    assert watch.run(kept.count) == 34
    assert got == [("started", {}), ("all", {"rows": 100, "total": 4950}), ("thirds", {"rows": 34, "most": 99}), ("finished", {})]


def test_events_of_a_stream(spark, tmp_path):
    spark.range(90).repartition(3).write.parquet(str(tmp_path / "in"))
    got, watch = [], monitor.Monitor()
    watch.add_callback(lambda event, data: got.append((event, data)))
    watch.attach(spark)
    try:
        rows = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watch.stage(rows, "seen", total=F.sum("id")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if got and got[-1][0] == "finished":
                break
            time.sleep(0.1)
    finally:
        watch.detach(spark)
    seen = [d for e, d in got if e == "seen" and d["rows"]]
    assert sum(d["rows"] for d in seen) == 90 and sum(d["total"] for d in seen) == 4005 and len({d["batch"] for d in seen}) == 3


# JSON


def test_flattened_json(spark):
    rows = [
        (1, '{"a": {"b": 1, "c d": "x", "e.f": null}, "g": [1, {"h": 2}], "m": 1, "t": true}'),
        (2, "  "),
        (3, None),
        (4, ' {"m": "s", "a": {"b": 2.5, "it\'s": 3}, "n": {"o": {"p": "deep"}}}'),
        (5, "[1]"),
        (6, "{bad"),
    ]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("META_t", F.lit("mine"))
    flat = nested.flatten_json(df, "j")
    got = {r.id: r.asDict() for r in flat.collect()}
    assert sorted(flat.columns) == sorted(["id", "META_t", "meta_a_b", "meta_a_c d", "meta_a_e_f", "meta_a_it's", "meta_g", "meta_m", "meta_n_o_p", "meta_t_"])
    assert (got[1]["meta_a_b"], got[1]["meta_a_c d"], got[1]["meta_g"], got[1]["meta_m"], got[1]["meta_t_"], got[1]["META_t"]) == (1.0, "x", '[1,{"h":2}]', "1", True, "mine")
    assert (got[4]["meta_a_b"], got[4]["meta_a_it's"], got[4]["meta_m"], got[4]["meta_n_o_p"]) == (2.5, 3, "s", "deep")
    assert all(v is None for k in (2, 3, 5, 6) for c, v in got[k].items() if c.startswith("meta_"))
    assert nested.flatten_json(df, "j", prefixes=["a.b", "n"], keep=True).columns == ["id", "j", "META_t", "meta_a_b", "meta_n_o_p"]
    assert nested.flatten_json(df.where("id = 2"), "j").columns == ["id", "META_t"] and nested.flatten_json(df.limit(0), "j").count() == 0


def test_schema_words_are_taken_apart():
    form = "OBJECT<a: OBJECT<`b, c`: BIGINT, d: ARRAY<OBJECT<e: STRING>>>, `f: g`: DECIMAL(3,1), h: VOID>"
    assert nested.leaves(form) == [(("a", "b, c"), "BIGINT"), (("a", "d"), "ARRAY<OBJECT<e: STRING>>"), (("f: g",), "DECIMAL(3,1)"), (("h",), "VOID")]


# Sections and chunks


def test_sections_of_a_long_text_in_linear_time(spark):
    body = "a line of this section that says little\n"
    text = "".join(f"SECTION {k}: Part {k}\n{body * 99}" for k in range(1000))
    began = time.time()
    got = sections.titled_sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text").collect()
    assert len(got) == 1000 and time.time() - began < 30
    assert {(r.section, r.title) for r in got} == {(k + 1, f"Part {k}") for k in range(1000)}


def test_table_functions_in_sql(spark):
    sections.register(spark)
    spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None), (4, "x")], "id int, t string").createOrReplaceTempView("chunk_texts")
    got = spark.sql("SELECT id, chunk_index, chunk FROM chunk_texts, LATERAL text_chunks(t, 3, 1)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a b c"), (1, 1, "c d e"), (2, 0, ""), (3, 0, ""), (4, 0, "x")]
    same = sections.chunked(spark.table("chunk_texts"), "id", F.col("t"), 3, 1).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, got))
    titles = spark.sql("SELECT section, title, content FROM VALUES ('one\\nALL CAPITALS HERE\\ntwo') AS v(t), LATERAL text_sections(t)").collect()
    assert sorted(map(tuple, titles)) == [(0, "Introduction", "one"), (1, "ALL CAPITALS HERE", "two")]


# Isotonic regression


@pytest.mark.parametrize("shape", ["noise", "steps", "rising", "falling", "saw"])
def test_isotonic_of_many_scores_in_ranges(spark, shape):
    rng = random.Random(9)
    y = {"noise": lambda k: rng.randrange(2), "steps": lambda k: int(rng.random() < k // 500 / 6), "rising": lambda k: k, "falling": lambda k: -k, "saw": lambda k: k % 700}[shape]
    rows = [(k / 3000, float(y(k))) for k in range(3000)] + [(None, 1.0), (0.5, None)]
    blocks = []
    for s, v in rows[:3000]:
        blocks.append([v, 1, [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v_, n, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v_, blocks[-1][1] + n, blocks[-1][2] + at]
    want = {s: v / n for v, n, at in blocks for s in at}
    got = {r.score: r.calibrated for r in isotonic.isotonic(spark.createDataFrame(rows, "score double, label double"), parts=13).collect()}
    assert got == pytest.approx(want)


def test_isotonic_of_nothing_and_of_one_score(spark):
    empty = spark.createDataFrame([], "score double, label int")
    assert isotonic.isotonic(empty).collect() == []
    assert [tuple(r) for r in isotonic.isotonic(spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")).collect()] == [(0.5, 0.5)]

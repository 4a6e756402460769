"""Compaction: packing against a loop, the whole query and the folder that it leaves against brute force, awkward rows."""

from __future__ import annotations

import datetime
import glob
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import compaction, queries
from ledgerloom.llm.shared import local_path


def first_fit(files, capacity):
    """Groups of (rows, lot, piece) in joining order."""
    groups = []
    for f in sorted(files, key=lambda f: (-f[0], f[1], f[2])):
        for g in groups:
            if sum(x[0] for x in g) + f[0] <= capacity:
                g.append(f)
                break
        else:
            groups.append([f])
    return groups


def by_hand(rows, at, key, value):
    """(day, lot, piece, n_rows, least, greatest, cents, sources, ids_sha256, rewritten) of each final file. rows: dicts."""
    day = lambda r: None if r[at] is None else (r[at].date() - datetime.date(1970, 1, 1)).days
    text = lambda r: "" if r[key] is None else str(r[key])
    total, by_day = len(rows), defaultdict(list)
    s = lambda x: 1 + total // x
    for r in rows:
        by_day[day(r)].append(r)
    out = []
    for d, members in by_day.items():
        files = defaultdict(list)
        for r in members:
            h = zlib.crc32(text(r).encode())
            files[h // 16 % (1 + len(members) // s(200)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[at] is not None, r[at] or datetime.datetime.min, r[key] is not None, r[key] or 0))
        small = [(len(f), *k) for k, f in files.items() if len(f) < s(750)]
        groups = first_fit(small, s(300)) + [[(len(f), *k)] for k, f in files.items() if len(f) >= s(750)]
        for g in groups:
            whole = [r for _, *k in g for r in files[tuple(k)]]
            ids = [r[key] for r in whole if r[key] is not None]
            cents = sum(math.floor(100 * r[value] + 0.5) for r in whole if r[value] is not None and math.isfinite(r[value]))
            out.append((d, g[0][1], g[0][2], len(whole), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for _, a, b in g), hashlib.sha256(",".join(map(text, whole)).encode()).hexdigest(), len(g) > 1))
    return sorted(out, key=str)


def found(rows):
    return sorted([(r.day, r.lot, r.piece, r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in rows], key=str)


def data_files(folder):
    return {p for p in glob.glob(f"{local_path(folder)}/**/*", recursive=True) if os.path.isfile(p) and os.path.basename(p)[0] not in "._"}


def test_query_equals_brute_force(spark, sf_dir):
    got = queries.QUERIES["op12_compaction"](spark, sf_dir).collect()
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    rows = [r.asDict() for r in clicks.collect()]
    assert found(got) == by_hand(rows, "arrived_at", "click_id", "value")
    assert {r.columns for r in got} == {",".join(clicks.columns)} and {r.rewritten for r in got} == {True, False}
    folder = got[0].path.split("/day=")[0]
    assert data_files(folder) == {local_path(r.path) for r in got}
    assert not [p for p in glob.glob(f"{local_path(folder)}/**/.*.crc", recursive=True) if "_SUCCESS" not in p and not os.path.exists(os.path.join(os.path.dirname(p), os.path.basename(p)[1:-4]))]
    again = spark.read.schema(clicks.schema).parquet(folder).select(clicks.columns)
    assert again.exceptAll(clicks).isEmpty() and clicks.exceptAll(again).isEmpty()


def table_of(spark, n, seed):
    rng = random.Random(seed)
    start = datetime.datetime(1969, 12, 28)
    one = lambda k: (rng.choice([k, k // 2, None]), rng.choice([None, start + datetime.timedelta(seconds=rng.randrange(8 * 86400))] + [start + datetime.timedelta(hours=k % 7)] * 3), rng.choice([None, 1.005, -2.5, float("nan"), 0.125]), f"é{k}", None, [k, None])
    rows = [one(k) for k in range(n)]
    return spark.createDataFrame(rows, "click_id bigint, arrived_at timestamp_ntz, value double, day string, `Lot` int, list array<int>").withColumn("when", F.lit("2024-05-01 10:00:00").cast("timestamp")).withColumn("price", F.lit("1.50").cast("decimal(10,2)"))


def run(docs):
    t = compaction.write_table(docs)
    before = {p: open(p, "rb").read() for p in data_files(t.folder)}
    left = compaction.compact(t, capacity=compaction.share(t.rows, 300), small=compaction.share(t.rows, 750))
    return t, before, compaction.described(left).withColumnsRenamed({"min_id": "min_click_id", "max_id": "max_click_id"}).collect()


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_awkward_rows(spark, n):
    """Null days, ids and values, times before 1970, repeated rows, partition columns' names taken, more types."""
    docs = table_of(spark, n, n).cache()
    t, before, got = run(docs)
    assert found(got) == by_hand([r.asDict() for r in docs.collect()], "arrived_at", "click_id", "value")
    assert data_files(t.folder) == {local_path(r.path) for r in got}
    for r in got:
        path = local_path(r.path)
        assert (path in before) != r.rewritten
        if not r.rewritten:
            assert open(path, "rb").read() == before[path]
    again = spark.read.schema(docs.schema).parquet(*{r.path for r in got}).select(docs.columns)
    assert again.exceptAll(docs).isEmpty() and docs.exceptAll(again).isEmpty()
    docs.unpersist()


def test_an_empty_table(spark):
    assert run(table_of(spark, 40, 1).limit(0))[2] == []


def test_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(compaction, "bounded", lambda df: df)
    docs = table_of(spark, 300, 5).cache()
    assert found(run(docs)[2]) == by_hand([r.asDict() for r in docs.collect()], "arrived_at", "click_id", "value")
    docs.unpersist()


@pytest.mark.parametrize("seed", range(5))
def test_lockstep_equals_first_fit(spark, seed):
    rng = random.Random(seed)
    files = [(day, lot, piece, f"{day}/{lot}/{piece}", rng.randrange(1, 40)) for day in [*rng.sample(range(-200, 200), 40), None] for lot in range(rng.choice([1, 2, 30])) for piece in range(rng.randrange(1, 5))]
    got = compaction.pack(spark.createDataFrame(files, compaction.FILES), capacity=60, small=30).collect()
    want = []
    for day in {f[0] for f in files}:
        mine = [(n, lot, piece) for d, lot, piece, _, n in files if d == day]
        want += [(day, g) for g in first_fit([f for f in mine if f[0] < 30], 60)] + [(day, [f]) for f in mine if f[0] >= 30]
    assert sorted(((r.day, [(s.n_rows, s.lot, s.piece) for s in r.sources]) for r in got), key=str) == sorted(want, key=str)


def test_lockstep_places_a_file_of_every_day_at_each_rank():
    sizes = np.array([[6, 5, 4, 1, -1], [9, 9, 9, 1, 1], [3, -1, -1, -1, -1]])
    assert compaction.lockstep(sizes, 10).tolist() == [[0, 1, 0, 1, -1], [0, 1, 2, 0, 1], [0, -1, -1, -1, -1]]


def test_files_are_streamed_into_row_groups(tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "GROUP_ROWS", 70_000)
    for k in range(3):
        pq.write_table(pa.table({"a": list(range(k * 50_000, (k + 1) * 50_000))}), tmp_path / f"{k}.parquet")
    into = str(tmp_path / "new" / "x.parquet")
    assert compaction.concatenate([str(tmp_path / f"{k}.parquet") for k in (2, 0, 1)], into) == 150_000
    with pq.ParquetFile(into) as f:
        assert f.num_row_groups >= 2 and f.read().column("a").to_pylist() == [*range(100_000, 150_000), *range(100_000)]


def test_moves_and_removals_may_be_repeated(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    open(a, "w").write("x")
    for _ in range(2):
        compaction._move(a, b)
    assert open(b).read() == "x" and not os.path.exists(a)
    for _ in range(2):
        compaction._remove(b)
    with pytest.raises(FileNotFoundError):
        compaction._move(a, b)

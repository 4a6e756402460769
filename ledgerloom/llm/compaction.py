"""Bin-packed compaction of a table's Parquet files, carried out: small files of a day are packed, and each group becomes one file.

Writing deals rows out by (day, lot, piece), sorts them in Spark's external sort, and leaves one file for each. Packing looks at
files only. Blocks of days are packed in numpy in lockstep: a matrix holds the room that is left in each day's groups; at every
size rank one file of every day of the block is placed at once, into the first group with room, which a boolean argmax
finds (groups that are not open yet have all their room, so they come after all open ones). Each group is then read and written by
one task as a stream of batches: rows are not shuffled again. Tasks write to a staging folder under names of their own and
report them; only what a finished stage has reported is moved into the table's folder, and only then are the sources removed,
so a lost or repeated task leaves no second file. Both steps may be repeated.

What grows with the rows is dealt out by file. Through the driver go the number of rows, paths of folders and counts of days, files and groups;
a row a day is broadcast (up to 200,000 days; else it is joined by a shuffle).
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.media import _open as open_file
from ledgerloom.llm.shared import bounded, free_name, local_path, new_folder, written

#: Days packed together.
BLOCK_DAYS = 64
#: Rows of a row group that compaction writes, and bytes after which it writes one earlier.
GROUP_ROWS, GROUP_BYTES = 1_000_000, 64 << 20
#: Rows for which a list of files or groups is dealt to one task more, and tasks at most.
TASK_ROWS, MOST_TASKS = 500_000, 10_000

FILES = "day bigint, lot bigint, piece bigint, path string, n_rows bigint"


def share(rows: int, parts: int) -> int:
    """S(parts): one more than that part of all rows."""
    return 1 + rows // parts


@dataclass(frozen=True)
class Table:
    """A table that was written: its folder, its files (FILES, written) and the number of its rows."""

    folder: str
    files: DataFrame
    rows: int


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder; of a local one, the path as a URI with three slashes."""
    at = new_folder(spark, name)
    return f"file://{local_path(at)}" if at.startswith("file:") else at


def _deal(files: DataFrame, rows: int) -> DataFrame:
    """A written list of files with so many rows in all: a task for TASK_ROWS of them, two for each core at least, a file a task at most."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(files.count(), max(2 * cores, rows // TASK_ROWS), MOST_TASKS)))


def days_of(at: Column) -> Column:
    """Whole days since 1970; timestamps with a zone in the session's."""
    return F.unix_date(F.to_date(at)).cast("long")


def write_table(rows: DataFrame, *, at: str = "arrived_at", id: str = "click_id", lot_share: int = 200) -> Table:
    """Write a file for each (day, lot, piece) of ``rows``, sorted by ``at``, then ``id`` (nulls first), with all columns in their order.

    Rows without a time have the day null; a null id counts as an empty text. Rows equal in time and id are in any order. An
    empty table has no files. Columns may have any names.
    """
    spark = rows.sparkSession
    day, lot, piece = (free_name(rows, n) for n in ("day", "lot", "piece"))
    keyed = rows.withColumn(day, days_of(F.col(at)))
    days = written(keyed.groupBy(F.col(day).alias("of")).agg(F.count(F.lit(1)).alias("n")), "days")
    total = days.agg(F.sum("n")).first()[0] or 0
    lots = bounded(days.select(F.col("of").alias("__of"), (1 + F.floor(F.col("n") / share(total, lot_share))).alias("__lots")))
    h = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    placed = keyed.join(lots, keyed[day].eqNullSafe(lots["__of"])).select(
        *[keyed[c] for c in rows.columns],
        keyed[day],
        (F.floor(h / 16) % lots["__lots"]).cast("long").alias(lot),
        F.least(h % 4, F.floor(h / 4) % 4).cast("long").alias(piece),
    )
    folder, keys = _folder(spark, "compaction"), [day, lot, piece]
    kind = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(kind)
    spark.conf.set(kind, "TIMESTAMP_MICROS")  # the older 96-bit form doesn't say whether times have a zone
    try:
        placed.repartition(*keys).sortWithinPartitions(*keys, at, id).write.partitionBy(*keys).parquet(folder)
    finally:
        spark.conf.set(kind, before)
    found = spark.read.schema(", ".join(f"`{k}` bigint" for k in keys)).parquet(folder)
    path = F.concat(F.lit(f"{folder}/"), F.substring_index(F.col("_metadata.file_path"), "/", -4))
    files = found.groupBy(F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece"), path.alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    return Table(folder, written(files, "files"), total)


def lockstep(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The group of each file. ``sizes``: a row a day, its files in the order in which they are placed, then -1; none is above ``capacity``."""
    days, ranks = sizes.shape
    group = np.full(sizes.shape, -1, np.int64)
    room = np.full((days, 1), capacity, np.int64)
    for rank in range(ranks):
        size = sizes[:, rank]
        if not (room[:, -1] == capacity).all():
            room = np.concatenate([room, np.full((days, max(1, room.shape[1] // 2)), capacity, np.int64)], axis=1)
        chosen = (room >= size[:, None]).argmax(axis=1)
        live = np.flatnonzero(size >= 0)
        room[live, chosen[live]] -= size[live]
        group[live, rank] = chosen[live]
    return group


def packed_block(files: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Files of some days, with the number of their group within the day and their place in it."""
    day = pd.factorize(files["day"], use_na_sentinel=False)[0]
    order = np.lexsort((files["piece"], files["lot"], -files["n_rows"], day))
    day, sizes = day[order], files["n_rows"].to_numpy()[order]
    start = np.flatnonzero(np.r_[True, day[1:] != day[:-1]])
    rank = np.arange(len(day)) - np.repeat(start, np.diff(np.r_[start, len(day)]))
    matrix = np.full((len(start), rank.max() + 1), -1, np.int64)
    matrix[day, rank] = sizes
    out = files.iloc[order].copy()
    out["group"], out["place"] = lockstep(matrix, capacity)[day, rank], rank
    return out


def pack(files: DataFrame, *, capacity: int, small: int) -> DataFrame:
    """day, sources (array of place, lot, piece, path, n_rows in joining order) of every group.

    Within a day, files of fewer than ``small`` rows, by descending rows, then lot, then piece, each join the earliest opened group that then
    has at most ``capacity`` rows, else open one. A file that isn't small is a group of its own. A day's files are packed by one
    task; the deal of ``write_table`` makes at most four for each of its lots, however many rows there are.
    """
    if small > capacity + 1:
        raise ValueError("a small file must fit into a group")
    source = lambda place: F.struct(place.alias("place"), "lot", "piece", "path", "n_rows")
    blocks = files.where(F.col("n_rows") < small).withColumn("block", F.floor(F.col("day") / BLOCK_DAYS)).groupBy("block")
    placed = blocks.applyInPandas(lambda block: packed_block(block.drop(columns="block"), capacity), FILES + ", group bigint, place bigint")
    groups = placed.groupBy("day", "group").agg(F.sort_array(F.collect_list(source(F.col("place")))).alias("sources")).select("day", "sources")
    return groups.unionByName(files.where(F.col("n_rows") >= small).select("day", F.array(source(F.lit(0).cast("long"))).alias("sources")))


def concatenate(paths: list[str], into: str) -> int:
    """Write the rows of Parquet files, one after another, to one file; a row group at most is held. Returns their number."""
    n, held, size, writer = 0, [], 0, None
    if at := local_path(into):
        os.makedirs(os.path.dirname(at), exist_ok=True)
    with open_file(into, "wb") as out:
        for path in paths:
            with open_file(path, "rb") as source, pq.ParquetFile(source) as file:
                if writer is None:
                    schema = file.schema_arrow
                    writer = pq.ParquetWriter(out, schema, compression="snappy", store_schema=False)
                for batch in file.iter_batches(65_536):
                    held.append(batch.replace_schema_metadata(schema.metadata))
                    n, size = n + batch.num_rows, size + batch.nbytes
                    if sum(b.num_rows for b in held) >= GROUP_ROWS or size >= GROUP_BYTES:
                        writer.write_table(pa.Table.from_batches(held, schema), GROUP_ROWS)
                        held, size = [], 0
        if held:
            writer.write_table(pa.Table.from_batches(held, schema), GROUP_ROWS)
        writer.close()
    return n


def _move(at: str, to: str) -> None:
    """Rename a file; it is no error if an earlier try has done so."""
    if local_path(at):
        if os.path.exists(local_path(at)):
            os.replace(local_path(at), local_path(to))
        elif not os.path.exists(local_path(to)):
            raise FileNotFoundError(at)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(at)
    target = fs.FileSystem.from_uri(to)[1]
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.move(path, target)
    elif store.get_file_info(target).type == fs.FileType.NotFound:
        raise FileNotFoundError(at)


def _remove(path: str) -> None:
    """Remove a file, and the checksum that Spark may have left beside it; it is no error if they are gone."""
    for p in (path, "/.".join(path.rsplit("/", 1)) + ".crc"):
        if at := local_path(p):
            if os.path.exists(at):
                os.remove(at)
            continue
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(p)
        if store.get_file_info(inside).type != fs.FileType.NotFound:
            store.delete_file(inside)


_SOURCES = "array<struct<place:bigint,lot:bigint,piece:bigint,path:string,n_rows:bigint>>"


def compact(table: Table, *, capacity: int, small: int) -> DataFrame:
    """Pack and merge the table's small files (see ``pack``). Returns a row for each file that is left: day, lot, piece (of its first source), sources, path, rewritten.

    A merged file lies beside its first source. Files that stay alone are not touched. Readers that list the folder meanwhile may see
    a group's rows twice; two compactions of one folder at once are not provided for.
    """
    spark = table.files.sparkSession
    plan = written(pack(table.files, capacity=capacity, small=small), "plan")
    staging = _folder(spark, "staging")

    def merge(batches):
        for batch in batches:
            staged = []
            for sources in batch.column(1).to_pylist():
                at = f"{staging}/{uuid.uuid4().hex}.parquet"
                if concatenate([s["path"] for s in sources], at) != sum(s["n_rows"] for s in sources):
                    raise ValueError(f"{at} doesn't have all rows of its sources")
                staged.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(staged, pa.string())], names=["day", "sources", "staged"])

    def publish(batches):
        for batch in batches:
            moved = []
            for sources, staged in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                to = f"{sources[0]['path'].rpartition('/')[0]}/part-{staged.rpartition('/')[2]}"
                _move(staged, to)
                for s in sources:
                    _remove(s["path"])
                moved.append(to)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(moved, pa.string())], names=["day", "sources", "path"])

    several = F.size("sources") > 1
    merged = written(_deal(plan.where(several), table.rows).mapInArrow(merge, f"day bigint, sources {_SOURCES}, staged string"), "merged")
    moved = written(merged.mapInArrow(publish, f"day bigint, sources {_SOURCES}, path string"), "moved")
    left = moved.withColumn("rewritten", F.lit(True)).unionByName(plan.where(~several).select("day", "sources", F.col("sources")[0]["path"].alias("path"), F.lit(False).alias("rewritten")))
    return left.select("day", F.col("sources")[0]["lot"].alias("lot"), F.col("sources")[0]["piece"].alias("piece"), "sources", "path", "rewritten")


def _cents(value: pa.Array) -> int:
    x = pc.cast(value, pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    return int(np.floor(100 * x[np.isfinite(x)] + 0.5).astype(np.int64).sum())


def described(files: DataFrame, *, id: str = "click_id", value: str = "value") -> DataFrame:
    """What the files that ``compact`` left hold, read back in order: n_rows, least and greatest id, cents, a digest of the ids, the columns.

    ``ids_sha256`` is of the ids in file order as text (null: empty), comma-joined; ``cents`` sums floor(100 * value + 0.5), where
    nulls and what is no finite number count 0.
    """
    schema = "day bigint, lot bigint, piece bigint, n_rows bigint, min_id bigint, max_id bigint, cents bigint, sources string, ids_sha256 string, columns string, path string, rewritten boolean"
    kinds = [pa.int64()] * 7 + [pa.string()] * 4 + [pa.bool_()]

    def one(path: str) -> tuple:
        digest, ends, cents, n = hashlib.sha256(), [], 0, 0
        with open_file(path, "rb") as source, pq.ParquetFile(source) as file:
            names = file.schema_arrow.names
            for batch in file.iter_batches(65_536, columns=[id, value]):
                ids = batch.column(batch.schema.get_field_index(id))
                joined = ",".join("" if x is None else str(x) for x in ids.to_pylist())
                digest.update((("," if n else "") + joined).encode())
                ends += [x for x in pc.min_max(ids).as_py().values() if x is not None]
                cents += _cents(batch.column(batch.schema.get_field_index(value)))
                n += batch.num_rows
        return n, min(ends, default=None), max(ends, default=None), cents, digest.hexdigest(), ",".join(names)

    def run(batches):
        for batch in batches:
            out = []
            for day, lot, piece, sources, path, rewritten in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, least, most, cents, ids, names = one(path)
                out.append((day, lot, piece, n, least, most, cents, sources, ids, names, path, rewritten))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=[f.partition(" ")[0] for f in schema.split(", ")])

    labels = F.array_join(F.transform("sources", lambda s: F.concat_ws("-", s["lot"], s["piece"])), ",")
    sizes = F.aggregate("sources", F.lit(0).cast("long"), lambda n, s: n + s["n_rows"])
    rows = written(files.select("day", "lot", "piece", labels.alias("sources"), "path", "rewritten", sizes.alias("n_rows")), "left")
    total = rows.agg(F.sum("n_rows")).first()[0] or 0
    return _deal(rows.drop("n_rows"), total).mapInArrow(run, schema)

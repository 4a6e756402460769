"""Shared storage, table loading and Arrow helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import ship_package, short_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, set here only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def local_path(path: str) -> str | None:
    """The path of a file:/ URI or of a plain path; None for any other store."""
    if "://" not in path.replace("file://", "") and path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, and survives lost executors.

    The result may be read until the session ends, so the files are left; who owns the folder in spark.checkpoint.dir
    clears its ``ledgerloom-*`` folders after a job.
    """
    at = new_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table of short rows, to be joined by broadcast if it has at most so many rows, else by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def hot_keys(weights: DataFrame, key: str, weight: str, most: int = 2000) -> DataFrame:
    """Keys that hold at least one in ``most`` of the whole weight: at most ``most`` rows, written, so they may be broadcast."""
    total = weights.agg(F.sum(weight)).first()[0] or 0
    return written(weights.where(F.col(weight) * most >= F.lit(total)).select(key), "hot")


def split_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (written, one row a key): hot keys by broadcast, so that their rows stay where they are, the others by a shuffle."""
    hot = F.broadcast(hot)
    heavy = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key)
    return heavy.unionByName(rows.join(hot, key, "left_anti").join(table.join(hot, key, "left_anti"), key))


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's plan expects a table to take, from the sizes of its files; no job runs. 0 where it does not know (it then says exabytes)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 54 else 0


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it as long as ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What an operator remembers in this Python worker from task to task, by a key of its own.
REMEMBERED: dict = {}


def forget() -> None:
    """Drop it all, at the start of another operator's tasks: workers outlive stages, and memory of the last operator would add to what this one takes."""
    if REMEMBERED:
        REMEMBERED.clear()
        pa.default_memory_pool().release_unused()


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and its n + 1 offsets, null as empty, without a copy where there is no null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 19):
    """Row ranges of about ``most`` bytes (one row at least), so that scratch arrays stay small whatever the batch holds."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j

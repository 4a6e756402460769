"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T


def exact_dedup(stream: DataFrame, text: str, at: str, delay: str = "1 hour") -> DataFrame:
    """First of each normalised text within the watermark; state is dropped behind it."""
    keyed = stream.withColumn("key", F.sha2(T.dedup_key_text(F.col(text)), 256)).withWatermark(at, delay)
    return keyed.dropDuplicatesWithinWatermark(["key"])


def velocity(stream: DataFrame, key: str, at: str, window: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Events by key and window, with a watermark for late data."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))


def running_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def scrubbed(stream: DataFrame, id: str, text: str) -> DataFrame:
    """Redacted records, one by one: no state."""
    from ledgerloom.operators import scrub

    return scrub.scrub(stream, id, text)


def finished_episodes(stream: DataFrame, key: str, reward: str, hit: str, done: str, *, buckets: int = 1024) -> DataFrame:
    """(key, steps, total, hits) of each episode once a row says that it is done; sums are kept as state until then, and dropped after.

    A state holds the open episodes of one of ``buckets`` hash buckets of keys, as a call of Python and a state cost far more than an episode's few rows.
    """
    kind = dict(stream.dtypes)[key]

    def step(group, parts, state):
        sums = {k: x for k, *x in json.loads(state.get[0])} if state.exists else {}
        over = set()
        for pdf in parts:
            codes, names = pd.factorize(pdf[key], use_na_sentinel=False)
            names = [None if pd.isna(k) else k for k in names]
            number = lambda c: np.bincount(codes, np.nan_to_num(pdf[c].to_numpy(dtype=float), posinf=np.inf, neginf=-np.inf))  # noqa: B023, E731  a null adds 0
            for k, n, t, h, d in zip(names, np.bincount(codes), number(reward), number(hit), number(done), strict=True):
                x = sums.get(k, (0, 0.0, 0))
                sums[k] = x[0] + int(n), x[1] + float(t), x[2] + int(h)
                over |= {k} if d else set()
        left = [(k, *x) for k, x in sums.items() if k not in over]
        if left:
            state.update((json.dumps(left),))
        elif state.exists:
            state.remove()
        if over:
            yield pd.DataFrame([(k, *sums[k]) for k in over], columns=[key, "steps", "total", "hits"])

    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket"), F.col(key).cast("string").alias(key), reward, hit, done).groupBy("__bucket")
    out = rows.applyInPandasWithState(step, f"{key} string, steps bigint, total double, hits bigint", "open string", "append", "NoTimeout")
    return out.withColumn(key, F.col(key).cast(kind))


def drift_alarms(stream: DataFrame, key: str, order: str, a: str, b: str, window: int = 100, least: int = 10, limit: float = -0.3) -> DataFrame:
    """(key, n, correlation, alarm) after each micro-batch: of the differences of two series over the last ``window`` rows, which are the state."""
    kind = dict(stream.dtypes)[key]

    def step(group, parts, state):
        kept = json.loads(state.get[0]) if state.exists else []
        for pdf in parts:
            kept += pdf[[order, a, b]].astype(float).values.tolist()
        kept = sorted(kept)[-window - 1 :]
        state.update((json.dumps(kept),))
        x, y = np.diff([r[1] for r in kept]), np.diff([r[2] for r in kept])
        flat = len(x) < least or x.std() <= 1e-6 or y.std() <= 1e-6
        c = None if flat else float(np.mean((x - x.mean()) * (y - y.mean())) / (x.std() * y.std()))
        yield pd.DataFrame({key: [group[0]], "n": [len(kept)], "correlation": pd.Series([c], dtype=float), "alarm": [c is not None and c < limit]})

    rows = stream.select(key, order, a, b).groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} {kind}, n bigint, correlation double, alarm boolean", "rows string", "update", "NoTimeout")


def run_once(stream: DataFrame, folder: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what is there, into Parquet, and return the result table.

    In mode append the sink is Spark's own; else every micro-batch is written beside the others, and the last one is the result
    (complete) or all of them are (update). Nothing is gathered on the driver.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", folder).start()
    else:
        q = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/batch={k}")).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(folder)
    batches = spark.read.schema(stream.schema).option("basePath", folder).parquet(f"{folder}/batch=*")
    last = batches.agg(F.max("batch").alias("last"))  # one row
    kept = batches if mode == "update" else batches.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")
    return kept.drop("batch")

"""A shuffle buffer over a stream: bounded state a lane, half given out when it is full, the rest at the end."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.streaming.dedup import run_once

_OUT = "lane int, place bigint, record string"


def _shuffled(buffer: list[str], seed: int, lane: int, given: int) -> list[str]:
    """In an order that the seed, the lane and how many records it has given out decide."""
    out = list(buffer)
    random.Random(f"{seed}:{lane}:{given}").shuffle(out)
    return out


def through_buffer(buffer: list[str], given: int, new: list[str], size: int, seed: int, lane: int) -> tuple[list[str], list[str]]:
    """What a full buffer gives out as records come, and what it holds then: at ``size`` records it is shuffled and gives half."""
    out, held = [], list(buffer)
    for record in new:
        held.append(record)
        if len(held) >= size:
            held = _shuffled(held, seed, lane, given + len(out))
            half = max(1, size // 2)
            out += held[:half]
            held = held[half:]
    return out, held


def shuffle_buffer(stream: DataFrame, id: str, *, size: int = 10_000, lanes: int = 8, seed: int = 42) -> DataFrame:
    """(lane, place, record): records as JSON in the order in which ``lanes`` buffers of ``size`` records give them out; what is held at the end is missing (``drained``).

    A record's lane is a hash of its id. A lane's records of one micro-batch come in order of their ids, so the same files in the same
    micro-batches give the same order. State is less than ``size`` records a lane, and crosses micro-batches.
    """
    lane = F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(lanes)).cast("int")
    rows = stream.select(lane.alias("lane"), F.col(id).cast("string").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))

    def step(group, parts, state):
        buffer, given = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        new = pd.concat(list(parts)).sort_values(["key", "record"])["record"].tolist()
        out, held = through_buffer(buffer, given, new, size, seed, group[0])
        state.update((json.dumps(held), given + len(out)))
        yield pd.DataFrame({"lane": group[0], "place": range(given, given + len(out)), "record": out})

    return rows.groupBy("lane").applyInPandasWithState(step, _OUT, "held string, given bigint", "append", "NoTimeout")


def drained(spark: SparkSession, checkpoint: str, seed: int = 42) -> DataFrame:
    """(lane, place, record): what the buffers of an ended stream still hold, shuffled, from the state that its checkpoint keeps."""
    state = spark.read.format("statestore").load(checkpoint)

    def run(pdfs):
        for pdf in pdfs:
            for lane, held, given in pdf.itertuples(index=False):
                out = _shuffled(json.loads(held), seed, lane, given)
                yield pd.DataFrame({"lane": lane, "place": range(given, given + len(out)), "record": out})

    return state.select(F.col("key.lane").alias("lane"), "value.groupState.held", "value.groupState.given").mapInPandas(run, _OUT)


def shuffled_once(stream: DataFrame, id: str, folder: str, checkpoint: str, *, size: int = 10_000, lanes: int = 8, seed: int = 42) -> DataFrame:
    """All that is there, through buffers: (lane, place) and the stream's columns; place by place is the order of a lane."""
    spark, schema = stream.sparkSession, stream.schema
    given = run_once(shuffle_buffer(stream, id, size=size, lanes=lanes, seed=seed), folder, "append", checkpoint)
    rows = given.unionByName(drained(spark, checkpoint, seed))
    return rows.select("lane", "place", F.from_json("record", schema).alias("r")).select("lane", "place", "r.*")

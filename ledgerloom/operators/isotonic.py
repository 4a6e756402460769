"""Isotonic regression by pooling in ranges, in parallel.

Distinct scores are cut into ranges at approximate percentiles, and adjacent violators are pooled in each range by a stream over its
sorted scores. What is left is a sequence of blocks, rising within each range. A block whose mean is not below any mean
before it and not above any behind it is settled: no pooling can cross it, as pooled means stay between those they come from. A
range's means are bounded by its first and last one, so a short table of ranges tells which blocks are settled. Only the others
are pooled again, in half as many ranges each time, up to one; blocks may be pooled in any order, so the result is that of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.graph import cut

_BLOCK = "part int, low double, high double, w double, s double"


def pooled(blocks: Iterator[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """(low, high, w, s) in order, adjacent blocks of falling or equal means (s / w) made one; a stack of the open blocks is held."""
    out: list[list[float]] = []
    for low, high, w, s in blocks:
        out.append([low, high, w, s])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, high_, w_, s_ = out.pop()
            out[-1][1:] = [high_, out[-1][2] + w_, out[-1][3] + s_]
    return [tuple(b) for b in out]


def _pool(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks (part, low, high, w, s) pooled within ranges of ``part``, which is divided by as much as leaves ``parts`` of them."""

    def run(pdfs):
        held: list[tuple[float, float, float, float]] = []
        part = None
        for pdf in pdfs:
            for p, rows in pdf.groupby("part", sort=False):
                if p != part and held:
                    yield _frame(part, held)
                    held = []
                part = p
                held = pooled([*held, *rows[["low", "high", "w", "s"]].itertuples(index=False, name=None)])
        if held:
            yield _frame(part, held)

    return blocks.repartition(parts, "part").sortWithinPartitions("part", "low").mapInPandas(run, _BLOCK)


def _frame(part: int, blocks: list[tuple[float, float, float, float]]) -> pd.DataFrame:
    return pd.DataFrame(blocks, columns=["low", "high", "w", "s"]).assign(part=np.int32(part))[["part", "low", "high", "w", "s"]]


def _settled(blocks: DataFrame) -> DataFrame:
    """Blocks with a column ``settled``. The window runs over a row a range."""
    mean = F.col("s") / F.col("w")
    ends = blocks.groupBy("part").agg(F.min(mean).alias("first"), F.max(mean).alias("last"))
    before, behind = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.orderBy("part").rowsBetween(1, W.unboundedFollowing)
    limits = ends.select("part", F.max("last").over(before).alias("least"), F.min("first").over(behind).alias("most"))
    free = (F.col("least").isNull() | (mean >= F.col("least"))) & (F.col("most").isNull() | (mean <= F.col("most")))
    return blocks.join(F.broadcast(limits), "part").withColumn("settled", free).drop("least", "most")


def part_of(score: Column, cuts: list[float]) -> Column:
    """The number of cut points that are below a score."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c < score))


def isotonic(scored: DataFrame, *, parts: int = 64, score: str = "score", label: str = "label") -> DataFrame:
    """(score, calibrated): the rising step function closest to the labels, at each distinct score. Rows with a null score or label take no part."""
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    counts = cut(scored.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("score")).agg(F.count("*").cast("double").alias("w"), F.sum(y).alias("s")))
    cuts = counts.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []  # at most ``parts`` numbers
    cuts = sorted(set(cuts))
    numbered = cut(counts.withColumn("part", part_of(F.col("score"), cuts).cast("int")))
    blocks = _settled(cut(_pool(numbered.select("part", F.col("score").alias("low"), F.col("score").alias("high"), "w", "s"), parts)))
    done, rest = [], blocks
    while True:
        rest = cut(rest)
        done.append(rest.where("settled").drop("settled"))
        open_ones = rest.where("NOT settled").drop("settled")
        if open_ones.isEmpty():
            break
        parts = -(-parts // 2)
        rest = _settled(cut(_pool(open_ones.withColumn("part", F.floor(F.col("part") / 2).cast("int")), parts)))
    whole = done[0].select("low", "high", "w", "s")
    for d in done[1:]:
        whole = whole.union(d.select("low", "high", "w", "s"))
    return _looked_up(numbered.select("part", "score"), whole.select("low", "high", (F.col("s") / F.col("w")).alias("calibrated")), cuts)


def _looked_up(scores: DataFrame, blocks: DataFrame, cuts: list[float]) -> DataFrame:
    """Each score with its block's value: a block stands in every range that it touches, and the last one that starts at or before a score holds it."""
    first, last = part_of(F.col("low"), cuts), part_of(F.col("high"), cuts)
    dealt = blocks.select(F.explode(F.sequence(first, last)).alias("part"), F.col("low").alias("score"), "calibrated")
    both = dealt.unionByName(scores.withColumn("calibrated", F.lit(None).cast("double")).withColumn("asked", F.lit(True)), allowMissingColumns=True)
    order = W.partitionBy("part").orderBy("score", F.col("asked").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("calibrated", F.last("calibrated", ignorenulls=True).over(order)).where("asked").select("score", "calibrated")

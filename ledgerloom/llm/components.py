"""Connected components of a link table by alternating large-star and small-star steps.

Only links move; no vertex gathers its neighbours in one place: minima are pre-aggregated in the
map tasks and joined back, and a join on a hot vertex can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import written


def _step(links: DataFrame, small: bool) -> DataFrame:
    """links: (u, v) with u > v. Small star: neighbours below u go to their least; large star: those above u."""
    both = links.union(links.select("v", "u"))
    if small:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str, *, most_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of a link; the component is its least vertex. No links, no rows."""
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = _mark(now)
    for _ in range(most_rounds):
        now = written(_step(_step(now, False), True), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    raise RuntimeError("components did not settle")

"""Sampling, balancing and splitting by hash order: reproducible, and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(*parts: str | Column, seed: str = "7") -> Column:
    """A hexadecimal digest to order by; any engine with MD5 gives the same order."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def uniform(*parts: str | Column, seed: str = "u") -> Column:
    """A number in [0, 1) from a digest: eight hexadecimal digits."""
    return F.conv(F.substring(hash_order(*parts, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def ranked_by_hash(df: DataFrame, key: str, h: str, *ties: str, digits: int = 2) -> DataFrame:
    """``df`` with ``rank`` (by h within key) and ``total`` (rows of key), without sorting a whole key in one task.

    Rows are ranked within (key, first digits of h); the sizes of earlier prefixes, a short table,
    are added.
    """
    part = F.substring(h, 1, digits)
    counts = df.groupBy(key, part.alias("__part")).agg(F.count("*").alias("__n"))
    before = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("__key"), "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(key)).alias("total"))
    within = F.row_number().over(W.partitionBy(key, "__p").orderBy(h, *ties))
    out = df.withColumn("__p", part).withColumn("__within", within)
    out = out.join(counts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__part")))
    return out.withColumn("rank", F.col("__before") + F.col("__within")).drop("__p", "__within", "__key", "__part", "__before")


def limit_per_key(df: DataFrame, key: str, n: int, h: str, *ties: str) -> DataFrame:
    """The first n rows of each key by hash order. Spark keeps only n rows of a key in each map task."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(h, *ties))).where(F.col("__r") <= n).drop("__r")


def balance(df: DataFrame, key: str, h: str, *ties: str, keep: list[str] | None = None) -> DataFrame:
    """Every key down to the size of the smallest, by hash order; keys in ``keep`` are kept whole and don't count."""
    whole = F.col(key).isin(keep) if keep else F.lit(False)
    counts = df.where(~whole | F.col(key).isNull() if keep else F.lit(True)).groupBy(key).agg(F.count("*").alias("n")).agg(F.min("n").alias("__least"))
    ranked = ranked_by_hash(df, key, h, *ties).join(F.broadcast(counts))
    return ranked.where(whole | (F.col("rank") <= F.col("__least"))).drop("rank", "total", "__least")


def weighted_copies(weight: Column, u: Column) -> Column:
    """Copies of a row: the weight's whole part, and one more with the probability of the rest."""
    return (F.floor(weight) + (u < weight - F.floor(weight)).cast("int")).cast("int")


def weighted_resample(df: DataFrame, weight: Column, u: Column) -> DataFrame:
    return df.withColumn("copy", F.explode(F.when(weighted_copies(weight, u) > 0, F.sequence(F.lit(1), weighted_copies(weight, u))).otherwise(F.array().cast("array<int>"))))


def random_sample(df: DataFrame, h: str, n: int, *ties: str) -> DataFrame:
    """n rows, the least by hash order; Spark keeps n rows a task."""
    return df.orderBy(h, *ties).limit(n)


def balanced_binary(df: DataFrame, label: str, h: str, most: int | None = None, *ties: str) -> DataFrame:
    """As many rows of either class: the size of the smaller, ``most`` at most."""
    even = balance(df, label, h, *ties)
    return even if most is None else limit_per_key(even, label, most, h, *ties)


def start_nodes(episodes: DataFrame, fraud: DataFrame, others: DataFrame, u: Column, v: Column, rate: float = 0.5) -> DataFrame:
    """(episode, id): with probability ``rate`` a fraud node, else any other, by two numbers in [0, 1).

    Nodes are numbered in order of id; an episode's second number picks one by equality of numbers.
    """
    from ledgerloom.operators.features import numbered

    pools = [numbered(df.select("id").distinct(), "id", "at").withColumn("fraud", F.lit(k)) for k, df in ((True, fraud), (False, others))]
    sizes = pools[0].agg(F.count("*").alias("n_true")).join(pools[1].agg(F.count("*").alias("n_false")))  # one row
    drawn = episodes.select("episode", ((u < rate).alias("fraud")), v.alias("v")).join(F.broadcast(sizes))
    drawn = drawn.withColumn("fraud", F.col("fraud") & (F.col("n_true") > 0))
    at = F.floor(F.col("v") * F.when(F.col("fraud"), F.col("n_true")).otherwise(F.col("n_false")))
    return drawn.select("episode", "fraud", at.alias("at")).join(pools[0].union(pools[1]), ["fraud", "at"]).select("episode", "id")


def prioritized_batch(df: DataFrame, priority: Column, positive: Column, u: Column, k: int, tie: str, *, alpha: float = 0.6, beta: float = 0.4, share: float = 0.25) -> DataFrame:
    """k rows without replacement by priority^alpha, of which min(int(k * share), positives) are positive, with importance weights.

    Weights are (N p)^-beta over the greatest drawn; p is a row's share of all priorities. Either stratum keeps
    k rows a task by the keys -ln(u) / w.
    """
    w = F.pow(priority, F.lit(alpha))
    keyed = df.withColumns({"__w": w, "__key": -F.log(u) / w, "__pos": positive})
    totals = keyed.agg(F.sum("__w").alias("__sum"), F.count("*").alias("__n"), F.least(F.lit(int(k * share)), F.sum(F.col("__pos").cast("long"))).alias("__quota"))
    rank = F.row_number().over(W.partitionBy("__pos").orderBy("__key", tie))
    near = keyed.withColumn("__r", rank).where(F.col("__r") <= k).join(F.broadcast(totals))
    quota = near.where(F.col("__pos") & (F.col("__r") <= F.col("__quota")))
    rest = near.where(~(F.col("__pos") & (F.col("__r") <= F.col("__quota")))).orderBy("__key", tie)
    first = quota.count()
    drawn = quota.union(rest.limit(k - first)).withColumn("weight", F.pow(F.col("__n") * F.col("__w") / F.col("__sum"), F.lit(-beta)))
    return drawn.join(F.broadcast(drawn.agg(F.max("weight").alias("__top")))).withColumn("weight", F.col("weight") / F.col("__top")).drop("__w", "__key", "__pos", "__r", "__sum", "__n", "__quota", "__top")

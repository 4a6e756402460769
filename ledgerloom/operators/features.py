"""Transaction and account features: aggregates by key joined back to rows, never windows over hub accounts.

A window partitioned by a hub account puts all its rows in one task; an aggregate is combined in
the map tasks first, and its join back can be broadcast or split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.graph import cut


def group_transform(df: DataFrame, keys: dict[str, str], value: str) -> DataFrame:
    """For each key column (name -> prefix): count and mean of ``value`` by key on every row, and value / (mean + 1).

    Rows are made once and written; each key's statistics come from these, not from rows that other keys' were joined to.
    """
    rows = df = cut(df)
    for key, prefix in keys.items():
        stats = rows.groupBy(key).agg(F.count("*").alias(f"{prefix}_count"), F.avg(value).alias(f"{prefix}_mean"))
        df = df.join(stats, key, "left")
    return df.withColumns({f"{prefix}_ratio": F.col(value) / (F.col(f"{prefix}_mean") + 1) for prefix in keys.values()})  # last, so that no shuffle carries them


def log_safe(x: Column) -> Column:
    return F.log(F.abs(x) + 1)


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def cyclical(x: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a phase; null is phase 0."""
    angle = 2 * F.pi() * F.coalesce(x.cast("double"), F.lit(0.0)) / period
    return F.sin(angle), F.cos(angle)


def numbered(values: DataFrame, by: str, into: str) -> DataFrame:
    """``values`` (distinct) with contiguous numbers from 0 in order of ``by``, without a sort in one task: ranges are numbered apart, on top of their starts."""
    ranged = cut(values.repartitionByRange(by).sortWithinPartitions(by).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))  # one row a range
    starts = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__start"))
    within = F.row_number().over(W.partitionBy("__p").orderBy(by))
    return ranged.withColumn("__r", within).join(F.broadcast(starts), "__p").withColumn(into, (F.col("__start") + F.col("__r") - 1).cast("long")).drop("__p", "__r", "__start")


def label_encode(df: DataFrame, column: str, into: str) -> DataFrame:
    """Index of each value among the sorted distinct strings; null counts as 'nan'. The distinct values are numbered by ranges, not the rows."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    codes = numbered(df.select(text.alias("__value")).distinct(), "__value", into)
    return df.join(codes, text == F.col("__value"), "left").drop("__value")


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, a deviation of 0 counting as 1; one aggregate row is joined to all."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats))  # one row
    for c in columns:
        deviation = F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
        out = out.withColumn(f"{c}_scaled", (F.col(c) - F.col(f"__m_{c}")) / deviation)
    return out.drop(*stats.columns)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """total / (classes * count) by class."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.join(F.broadcast(totals)).select(target, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def describe_target(df: DataFrame, target: str) -> DataFrame:
    """Counts and ratios (four decimals) by value, null kept."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(target, "n", F.round(F.col("n") / F.col("total"), 4).alias("ratio"))


def roles(tx: DataFrame) -> DataFrame:
    """One row for each account and role in a transaction: a self-transfer counts in both roles. Transactions are made once for both."""
    both = F.array(F.struct(F.col("nameOrig").alias("id"), F.lit(True).alias("sent")), F.struct(F.col("nameDest").alias("id"), F.lit(False).alias("sent")))
    return tx.select(F.explode(both).alias("r"), "amount", "step", "isMoneyLaundering").select("r.id", "r.sent", "amount", "step", "isMoneyLaundering")


def gap_deviation(df: DataFrame, key: str, at: str) -> DataFrame:
    """(key, n, gap_std): population deviation of the gaps between an account's sorted steps.

    An account's rows are never sorted in one task, only its distinct steps, whose number the calendar
    bounds; they are one list, so they are shuffled once. Equal steps have gaps of 0.
    """
    steps = df.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(at)).alias("x"))
    gap = lambda a, b: (b - a).cast("double")
    each = F.zip_with(F.slice("x", F.lit(1), F.greatest(F.size("x") - 1, F.lit(0))), F.slice("x", 2, F.size("x") + 1), gap)
    gaps = steps.withColumn("gaps", each).select(key, "n", (F.get("x", F.size("x") - 1) - F.get("x", F.lit(0))).cast("double").alias("s"), F.aggregate("gaps", F.lit(0.0), lambda q, g: q + g * g).alias("q"))
    m = F.col("n") - 1
    variance = F.greatest(F.lit(0.0), F.col("q") / m - F.pow(F.col("s") / m, 2))
    return gaps.select(key, "n", F.when(m > 0, F.sqrt(F.coalesce(variance, F.lit(0.0)))).alias("gap_std"))


def node_stats(tx: DataFrame) -> DataFrame:
    """Account statistics over both roles; see the columns. ``hour`` is step modulo 24, business hours are 8 to 17."""
    both = roles(tx)
    hour = F.pmod("step", F.lit(24))
    amount_if = lambda c: F.sum(F.when(c, F.col("amount")).otherwise(0.0))
    sent = F.col("sent")
    stats = both.groupBy("id").agg(
        amount_if(sent).alias("total_sent"),
        amount_if(~sent).alias("total_received"),
        F.sum(sent.cast("long")).alias("num_transactions_sent"),
        F.sum((~sent).cast("long")).alias("num_transactions_received"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.max("amount").alias("max_transaction_amount"),
        F.min("amount").alias("min_transaction_amount"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        F.sum(((hour >= 8) & (hour < 18)).cast("long")).alias("business"),
        F.sum("isMoneyLaundering").alias("hits"),
        F.count("*").alias("n"),
    )
    out = stats.join(gap_deviation(both, "id", "step").select("id", "gap_std"), "id")
    return out.select(
        "id",
        "total_sent",
        "total_received",
        "num_transactions_sent",
        "num_transactions_received",
        "avg_transaction_amount",
        "max_transaction_amount",
        "min_transaction_amount",
        (F.col("n") / F.greatest(F.col("last_step") - F.col("first_step") + 1, F.lit(1))).alias("transaction_velocity"),
        (F.col("business") / F.col("n")).alias("business_hour_ratio"),
        F.when(F.col("n") > 1, 1 / (1 + F.col("gap_std"))).otherwise(0.0).alias("periodicity_score"),
        (F.col("hits") / F.col("n")).alias("risk_score"),
        (F.col("hits") > 0).cast("int").alias("label"),
        (F.col("total_received") - F.col("total_sent")).alias("balance"),
        "first_step",
        "last_step",
        F.when((F.col("num_transactions_sent") > 0) & (F.col("num_transactions_received") > 0), "intermediary").when(F.col("num_transactions_sent") > 0, "customer").otherwise("merchant").alias("node_type"),
    )


def velocity(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows per unit of time of a key: 0 for a single row, the count where all fall on one time."""
    stats = df.groupBy(key).agg(F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("span"))
    return stats.select(key, F.when(F.col("n") <= 1, 0.0).when(F.col("span") == 0, F.col("n")).otherwise(F.col("n") / F.col("span")).cast("double").alias("tx_velocity"))


def time_density(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy(at).agg(F.count("*").alias("n")).withColumn("density", F.log1p(F.col("n").cast("double")))


def illicit_ratio(df: DataFrame, at: str, target: str) -> DataFrame:
    """(positives + 1) / (rows + 2) by time."""
    return df.groupBy(at).agg(((F.sum(target) + 1) / (F.count("*") + 2)).alias("illicit_ratio"))


def row_stats(values: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of an array."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return mean, F.when(n > 1, F.sqrt(squares / (n - 1)))

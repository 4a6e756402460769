"""Feature vectors of accounts, payments and walks, as array columns built in the JVM.

Every vector is an array<double> of a fixed size: missing values count as given, shorter vectors are padded with
zeros, longer ones cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import features, graph

# Kinds of accounts, in the order of their slots.
ACCOUNT_TYPES = ["customer", "merchant", "shell_company", "foreign", "crypto_exchange"]


def number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(default))


def one_hot(value: Column, kinds: list[str]) -> list[Column]:
    return [F.when(value == k, 1.0).otherwise(0.0) for k in kinds]


def vector(parts: list[Column], size: int) -> Column:
    return F.slice(F.concat(F.array(*[p.cast("double") for p in parts]), F.array_repeat(F.lit(0.0), size)), 1, size)


def node_vector(size: int = 20) -> Column:
    """Type, amounts on a log scale, counts, risk, times and network position of an account; absent columns must be added as null."""
    log = lambda c: F.log1p(F.abs(number(c)))
    parts = [
        *one_hot(F.coalesce("node_type", F.lit("customer")), ACCOUNT_TYPES),
        *[log(c) for c in ("total_sent", "total_received", "balance")],
        *[number(c) for c in ("num_transactions_sent", "num_transactions_received", "risk_score", "is_suspicious", "tx_velocity")],
        number("business_hour_ratio", 0.5),
        *[number(c) for c in ("periodicity_score", "degree_centrality", "clustering_coefficient")],
        *[number(c) / 100 for c in ("in_degree", "out_degree")],
    ]
    return vector(parts, size)


def account_vectors(tx: DataFrame, edges: DataFrame, *, distinct: bool = True) -> DataFrame:
    """(id, v): the vector of each account from its transactions and its place in the graph of distinct edges. With ``distinct`` false the edges are known to be.

    A triangle has an account that edges both reach and leave, so where there is none, no edges are joined to look for triangles.
    """
    stats = features.node_stats(tx).withColumnRenamed("transaction_velocity", "tx_velocity").withColumn("is_suspicious", F.col("label"))
    d = graph.cut(graph.degrees(edges, distinct=distinct))
    n = d.agg(F.count("*").alias("nodes"))
    place = d.join(F.broadcast(n)).withColumn("degree_centrality", F.when(F.col("nodes") > 1, F.col("degree") / (F.col("nodes") - 1)).otherwise(0.0)).drop("nodes")
    if d.where("in_degree > 0 AND out_degree > 0").isEmpty():
        place = place.withColumn("clustering_coefficient", F.lit(0.0))
    else:
        place = place.join(graph.clustering(edges).select("id", F.col("clustering").alias("clustering_coefficient")), "id", "left")
    return stats.join(place, "id", "left").select("id", node_vector().alias("v"))


def edge_vectors(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """(src, dst, v): both ends' vectors, then the amount on a log scale and the step in thousands: 42 values.

    Payees are mostly fewer than payers, so they are joined first: rows of one then follow each other to the second shuffle, where equal vectors compress.
    """
    a, b = (accounts.select(F.col("id").alias(end), F.col("v").alias(f"v_{end}")) for end in ("src", "dst"))
    return edges.join(b, "dst").join(a, "src").select("src", "dst", F.concat("v_src", "v_dst", F.array(F.log1p(number("amount")), number("step") / 1000)).alias("v"))


def wide_vector(values: Column, extra: list[Column], width: int = 166) -> Column:
    """``width`` raw features, absent ones as 0, then the derived ones."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.nanvl(F.get(values, i).cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.concat(raw, F.array(*[F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) for x in extra]))


def observation_vector(most_steps: int = 50, most_neighbours: int = 10) -> Column:
    """Ten values of the present account and six of the walk so far; infinities and NaN count as 0."""
    sane = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    node = [features.signed_log1p(number("balance")), number("risk_score"), number("is_suspicious"), number("out_degree"), number("in_degree"), *one_hot(F.col("node_type"), ACCOUNT_TYPES)]
    walk = [
        number("visited") / most_steps,
        number("fraud_edges") / F.greatest(number("edges"), F.lit(1.0)),
        features.signed_log1p(number("mean_amount")),
        number("neighbours") / most_neighbours,
        number("step_count") / most_steps,
        number("flagged"),
    ]
    return F.array(*[sane(x.cast("double")) for x in [*node, *walk]])


def history_vectors(steps: DataFrame, episode: str, size: int = 16) -> DataFrame:
    """(episode, v) of walks (episode, node, amount, fraud, hour, risk_score), a row for each edge taken to a node.

    Visited nodes and edges in hundreds, share of fraud edges, amounts on a log scale, the mean hour's phase (12 where
    unknown), mean and greatest risk over distinct nodes. Nodes are counted once by an aggregate before.
    """
    edges = steps.groupBy(episode).agg(F.count("*").alias("edges"), F.avg(F.col("fraud").cast("double")).alias("rate"), F.avg("amount").alias("mean"), F.stddev_pop("amount").alias("std"), F.max("amount").alias("most"), F.avg(F.coalesce(F.col("hour"), F.lit(12)).cast("double")).alias("hour"))
    risks = steps.groupBy(episode, "node").agg(F.max("risk_score").alias("risk")).groupBy(episode).agg(F.count("*").alias("visited"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("most_risk"))
    angle = 2 * F.pi() * F.col("hour") / 24
    parts = [number("visited") / 100, number("edges") / 100, number("rate"), *[F.log1p(number(c)) for c in ("mean", "std", "most")], F.sin(angle), F.cos(angle), number("mean_risk"), number("most_risk")]
    return edges.join(risks, episode).select(episode, vector(parts, size).alias("v"))


def forest_vectors(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, v): 19 features of an account for a tree model: degrees, amounts of distinct edges either way, risk, type, balances."""
    pairs = edges.groupBy("src", "dst").agg(F.first("amount").alias("amount"))
    side = lambda end, p: pairs.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(f"{p}_n"), F.sum("amount").alias(f"{p}_sum"), F.avg("amount").alias(f"{p}_mean"), F.stddev_pop("amount").alias(f"{p}_std"))
    rows = stats.join(side("src", "out"), "id", "left").join(side("dst", "in"), "id", "left")
    log = lambda c: F.log1p(number(c))
    parts = [
        log("out_n"),
        log("in_n"),
        F.log1p(number("out_n") + number("in_n")),
        number("out_n") / F.greatest(number("in_n"), F.lit(1.0)),
        *[log(f"{p}_{m}") for p in ("out", "in") for m in ("sum", "mean", "std")],
        number("risk_score"),
        number("label"),
        *one_hot(F.col("node_type"), ACCOUNT_TYPES[1:]),
        F.log1p(F.abs(number("balance"))),
        log("total_sent"),
        log("total_received"),
    ]
    return rows.select("id", F.array(*[p.cast("double") for p in parts]).alias("v"))


def time_encoding(t: Column, size: int = 8) -> Column:
    """Sines, then cosines, of t / 10000^(2 i / size) for i below size / 2."""
    angles = [t.cast("double") * float(10000 ** (-2 * i / size)) for i in range(size // 2)]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles])


def periodicity(edges: DataFrame) -> DataFrame:
    """(id, periodicity): 1 / (1 + deviation / mean) of the steps of an account's distinct edges; 0 below two edges or at mean 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "step")
    stats = ends.groupBy("id").agg(F.count("*").alias("n"), F.avg("step").alias("m"), F.stddev_pop("step").alias("s"))
    return stats.select("id", F.when((F.col("n") < 2) | (F.col("m") == 0), 0.0).otherwise(1 / (1 + F.col("s") / F.col("m"))).alias("periodicity"))

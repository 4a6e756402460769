"""Observation and reward queries: padded neighbourhoods, batches, entropy and efficiency by episode."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.plans.graph import G, edges
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load, rounded

SLOTS = 5


@query(
    "graph_obs_pad",
    f"""WITH {G}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY amount DESC, dst) AS r FROM edges), t AS (SELECT src, list(dst ORDER BY r) AS d FROM r WHERE r <= {SLOTS} GROUP BY src)
SELECT src, array_to_string(list_concat([src], d, list_transform(range({SLOTS} - len(d)), lambda i: '')), '|') AS slots, CAST(len(d) + 1 AS INTEGER) AS num_nodes FROM t""",
)
def graph_obs_pad(spark, sf_dir):
    """The account first, then its largest payees, padded to a fixed size."""
    order = W.partitionBy("src").orderBy(F.desc("amount"), "dst")
    top = edges(spark, sf_dir).withColumn("r", F.row_number().over(order)).where(F.col("r") <= SLOTS)
    near = top.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "dst"))), lambda x: x["dst"]).alias("d"))
    slots = F.concat(F.array("src"), "d", F.array_repeat(F.lit(""), F.lit(SLOTS) - F.size("d")))
    return near.select("src", F.array_join(slots, "|").alias("slots"), (F.size("d") + 1).alias("num_nodes"))


@query(
    "batch_graphs",
    "WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, n, CAST(coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_node FROM g",
)
def batch_graphs(spark, sf_dir):
    """First node number of each graph when graphs are laid end to end."""
    from ledgerloom.operators.metrics import running_sums

    sizes = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return running_sums(sizes, "conv_id", "n", descending=False).select("conv_id", "n", (F.col("cum_n") - F.col("n")).alias("first_node"))


@query("neighbor_mean_features", f"WITH {G} SELECT dst AS id, round(avg(c_acctbal) + 1e-7, 4) AS mean_balance, count(*) AS n FROM edges JOIN customer ON src = 'C' || c_custkey GROUP BY dst")
def neighbor_mean_features(spark, sf_dir):
    balance = load(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), "c_acctbal")
    return edges(spark, sf_dir).join(balance, "src").groupBy(F.col("dst").alias("id")).agg(rounded(F.avg("c_acctbal") + 1e-7, 4).alias("mean_balance"), F.count("*").alias("n"))


@query("multi_hot_encode", "WITH t AS (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY user_id), n AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS names FROM events) SELECT user_id, array_to_string(list_transform(names, lambda x: CAST(list_contains(k, x) AS INTEGER)), '') AS hot FROM t, n")
def multi_hot_encode(spark, sf_dir):
    """Names as zeros and ones, in order of all names (one row, broadcast)."""
    e = load(spark, sf_dir, "events")
    names = e.agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    have = e.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    hot = F.transform("names", lambda x: F.array_contains("k", x).cast("int").cast("string"))
    return have.join(F.broadcast(names)).select("user_id", F.array_join(hot, "").alias("hot"))


@query(
    "diversity_reward",
    "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS t, count(*) AS k FROM c GROUP BY user_id) SELECT user_id, round(sum(-(n / t) * ln(n / t)) / ln(any_value(k) + 1), 6) AS entropy FROM c JOIN t USING (user_id) GROUP BY user_id",
)
def diversity_reward(spark, sf_dir):
    """Entropy of a user's actions over ln(kinds + 1), from counts alone: ln t - sum(n ln n) / t."""
    c = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    t = F.sum("n")
    return c.groupBy("user_id").agg(rounded((F.log(t) - F.sum(F.col("n") * F.log("n")) / t) / F.log(F.count("*") + 1)).alias("entropy"))


@query(
    "investigation_efficiency",
    "SELECT user_id, round(count(*) FILTER (value >= 90) / count(*), 6) AS detections_per_step, round(CASE WHEN count(*) FILTER (value >= 90) = 0 THEN NULL ELSE count(*) / count(*) FILTER (value >= 90) END, 6) AS steps_per_detection FROM events GROUP BY user_id",
)
def investigation_efficiency(spark, sf_dir):
    """Steps without any detection have no steps per detection (null)."""
    hits = F.sum((F.col("value") >= 90).cast("long"))
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), hits.alias("h"))
    return e.select("user_id", rounded(F.col("h") / F.col("n")).alias("detections_per_step"), rounded(F.when(F.col("h") > 0, F.col("n") / F.col("h"))).alias("steps_per_detection"))


@query(
    "masked_token_f1",
    "WITH t AS (SELECT CASE WHEN quality = 0 AND doc_id % 5 = 0 THEN -100 ELSE toxic END AS y, CAST(doc_id % 9 = 0 AS INTEGER) AS p FROM labels), m AS (SELECT * FROM t WHERE y <> -100), c AS (SELECT k, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (y = k) AS s, count(*) FILTER (p = k) AS g FROM m, (SELECT unnest([0, 1]) AS k) GROUP BY k) SELECT round(avg(CASE WHEN s + g = 0 THEN 0 ELSE 2 * tp / (s + g) END), 6) AS macro_f1 FROM c",
)
def masked_token_f1(spark, sf_dir):
    """Macro F1 over labels, those of -100 left out."""
    from ledgerloom.operators.metrics import per_class

    y = F.when((F.col("quality") == 0) & (F.col("doc_id") % 5 == 0), -100).otherwise(F.col("toxic"))
    rows = load(spark, sf_dir, "labels").select(y.alias("y"), (F.col("doc_id") % 9 == 0).cast("int").alias("p")).where("y <> -100")
    return per_class(rows, "y", "p").agg(rounded(F.avg("f1")).alias("macro_f1"))

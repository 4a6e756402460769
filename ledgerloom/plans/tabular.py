"""Queries on transaction tables, events and features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import features, nested
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import ORDER, ORDER_SQL, TX_SQL, load, rounded, transactions

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ROW_SQL = ", ".join(KEYS)


@query(
    "amlnet_group_transform",
    f"""WITH {TX_SQL}, o AS (SELECT nameOrig, count(*) AS c, avg(amount) AS m FROM tx GROUP BY 1), d AS (SELECT nameDest, count(*) AS c, avg(amount) AS m FROM tx GROUP BY 1)
SELECT {ROW_SQL}, amount, o.c AS orig_count, round(o.m + 1e-7, 4) AS orig_mean, round(amount / (o.m + 1), 6) AS orig_ratio, d.c AS dest_count, round(d.m + 1e-7, 4) AS dest_mean, round(amount / (d.m + 1), 6) AS dest_ratio
FROM tx JOIN o USING (nameOrig) JOIN d USING (nameDest)""",
)
def amlnet_group_transform(spark, sf_dir):
    out = features.group_transform(transactions(spark, sf_dir).select(*KEYS, "nameOrig", "nameDest", "amount"), {"nameOrig": "orig", "nameDest": "dest"}, "amount")
    return out.select(*KEYS, "amount", "orig_count", rounded(F.col("orig_mean") + 1e-7, 4).alias("orig_mean"), rounded(F.col("orig_ratio")).alias("orig_ratio"), "dest_count", rounded(F.col("dest_mean") + 1e-7, 4).alias("dest_mean"), rounded(F.col("dest_ratio")).alias("dest_ratio"))


@query(
    "balance_features",
    f"""WITH {TX_SQL} SELECT {ROW_SQL}, amount, round(newbalanceOrig - oldbalanceOrg, 4) AS balance_delta, round(abs(newbalanceOrig - oldbalanceOrg), 4) AS balance_delta_abs,
  round(amount / (abs(oldbalanceOrg) + 1), 6) AS amount_to_balance, round(ln(abs(amount) + 1), 6) AS log_amount, round(sign(newbalanceOrig) * ln(1 + abs(newbalanceOrig)), 6) AS signed_log_balance, round(ln(amount + 1e-8), 6) AS log_transform FROM tx""",
)
def balance_features(spark, sf_dir):
    tx, delta = transactions(spark, sf_dir), F.col("newbalanceOrig") - F.col("oldbalanceOrg")
    return tx.select(
        *KEYS,
        "amount",
        rounded(delta, 4).alias("balance_delta"),
        rounded(F.abs(delta), 4).alias("balance_delta_abs"),
        rounded(F.col("amount") / (F.abs("oldbalanceOrg") + 1)).alias("amount_to_balance"),
        rounded(features.log_safe(F.col("amount"))).alias("log_amount"),
        rounded(features.signed_log1p(F.col("newbalanceOrig"))).alias("signed_log_balance"),
        rounded(F.log(F.col("amount") + 1e-8)).alias("log_transform"),
    )


@query(
    "amlnet_describe",
    f"""WITH {TX_SQL} SELECT count(*) AS n_rows, CAST(sum(isMoneyLaundering) AS BIGINT) AS n_fraud, round(avg(isMoneyLaundering), 6) AS fraud_rate, count(DISTINCT nameOrig) AS n_orig, count(DISTINCT nameDest) AS n_dest, count(DISTINCT type) AS n_types FROM tx""",
)
def amlnet_describe(spark, sf_dir):
    return transactions(spark, sf_dir).agg(
        F.count("*").alias("n_rows"),
        F.sum("isMoneyLaundering").alias("n_fraud"),
        rounded(F.avg("isMoneyLaundering")).alias("fraud_rate"),
        F.countDistinct("nameOrig").alias("n_orig"),
        F.countDistinct("nameDest").alias("n_dest"),
        F.countDistinct("type").alias("n_types"),
    )


@query("type_value_counts", f"WITH {TX_SQL} SELECT type, count(*) AS n FROM tx GROUP BY type")
def type_value_counts(spark, sf_dir):
    return transactions(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "class_weights",
    f"WITH {TX_SQL} SELECT isMoneyLaundering, count(*) AS n, round((SELECT count(*) FROM tx) / ((SELECT count(DISTINCT isMoneyLaundering) FROM tx) * count(*)), 6) AS weight FROM tx GROUP BY 1",
)
def class_weights(spark, sf_dir):
    return features.class_weights(transactions(spark, sf_dir), "isMoneyLaundering").select("isMoneyLaundering", "n", rounded(F.col("weight")).alias("weight"))


@query("describe_target", "SELECT toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY toxic")
def describe_target(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return features.describe_target(docs, "toxic")


_NODE_SQL = f"""WITH {TX_SQL}, r AS (
  SELECT nameOrig AS id, true AS sent, amount, step, isMoneyLaundering AS f FROM tx UNION ALL SELECT nameDest, false, amount, step, isMoneyLaundering FROM tx),
g AS (SELECT id, step - lag(step) OVER (PARTITION BY id ORDER BY step) AS gap FROM r), p AS (SELECT id, stddev_pop(gap) AS s FROM g GROUP BY id)
SELECT r.id, round(coalesce(sum(amount) FILTER (sent), 0), 2) AS total_sent, round(coalesce(sum(amount) FILTER (NOT sent), 0), 2) AS total_received,
  count(*) FILTER (sent) AS num_transactions_sent, count(*) FILTER (NOT sent) AS num_transactions_received,
  round(avg(amount) + 1e-7, 4) AS avg_transaction_amount, max(amount) AS max_transaction_amount, min(amount) AS min_transaction_amount,
  round(count(*) / greatest(max(step) - min(step) + 1, 1), 6) AS transaction_velocity,
  round(avg(CASE WHEN ((step % 24) + 24) % 24 BETWEEN 8 AND 17 THEN 1.0 ELSE 0.0 END), 6) AS business_hour_ratio,
  round(CASE WHEN count(*) > 1 THEN 1 / (1 + any_value(s)) ELSE 0 END, 6) AS periodicity_score,
  round(sum(f) / count(*), 6) AS risk_score, CAST(max(f) AS INTEGER) AS label,
  round(coalesce(sum(amount) FILTER (NOT sent), 0) - coalesce(sum(amount) FILTER (sent), 0), 2) AS balance, min(step) AS first_step, max(step) AS last_step,
  CASE WHEN bool_or(sent) AND bool_or(NOT sent) THEN 'intermediary' WHEN bool_or(sent) THEN 'customer' ELSE 'merchant' END AS node_type
FROM r LEFT JOIN p ON r.id = p.id GROUP BY r.id"""


@query("node_stats", _NODE_SQL)
def node_stats(spark, sf_dir):
    out = features.node_stats(transactions(spark, sf_dir))
    places = {"total_sent": 2, "total_received": 2, "balance": 2, "avg_transaction_amount": 4, "transaction_velocity": 6, "business_hour_ratio": 6, "periodicity_score": 6, "risk_score": 6}
    nudge = lambda c: F.col(c) + 1e-7 if c == "avg_transaction_amount" else F.col(c)  # noqa: E731  means of cents fall on ties
    return out.select(*[rounded(nudge(c), places[c]).alias(c) if c in places else c for c in out.columns])


@query("temporal_span", f"WITH {TX_SQL}, r AS (SELECT nameOrig AS id, step FROM tx UNION ALL SELECT nameDest, step FROM tx) SELECT id, min(step) AS first_step, max(step) AS last_step FROM r GROUP BY id")
def temporal_span(spark, sf_dir):
    return features.roles(transactions(spark, sf_dir)).groupBy("id").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query(
    "tx_velocity",
    f"WITH {TX_SQL} SELECT nameOrig, round(CASE WHEN count(*) <= 1 THEN 0 WHEN max(step) = min(step) THEN count(*) ELSE count(*) / (max(step) - min(step)) END, 6) AS tx_velocity FROM tx GROUP BY nameOrig",
)
def tx_velocity(spark, sf_dir):
    return features.velocity(transactions(spark, sf_dir), "nameOrig", "step").select("nameOrig", rounded(F.col("tx_velocity")).alias("tx_velocity"))


@query(
    "steps_diff_std",
    f"WITH {TX_SQL}, g AS (SELECT nameDest, step - lag(step) OVER (PARTITION BY nameDest ORDER BY step) AS gap FROM tx) SELECT nameDest, count(*) AS n, round(stddev_pop(gap), 6) AS gap_std FROM g GROUP BY nameDest",
)
def steps_diff_std(spark, sf_dir):
    return features.gap_deviation(transactions(spark, sf_dir), "nameDest", "step").select("nameDest", "n", rounded(F.col("gap_std")).alias("gap_std"))


@query(
    "business_hour_ratio",
    "SELECT user_id, round(avg(CASE WHEN hour(ts) BETWEEN 9 AND 16 THEN 1.0 ELSE 0.0 END), 6) AS business_hour_ratio FROM events GROUP BY user_id",
)
def business_hour_ratio(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(rounded(F.avg(F.hour("ts").between(9, 16).cast("double"))).alias("business_hour_ratio"))


@query(
    "event_velocity",
    "SELECT user_id, round(CASE WHEN count(*) <= 1 THEN 0 WHEN max(epoch(ts)) = min(epoch(ts)) THEN count(*) ELSE count(*) / ((max(epoch(ts)) - min(epoch(ts))) / 3600) END, 6) AS tx_velocity FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id",
)
def event_velocity(spark, sf_dir):
    hours = load(spark, sf_dir, "events").select("user_id", (F.unix_timestamp(F.date_trunc("second", F.col("ts"))) / 3600.0).alias("hour"))
    return features.velocity(hours, "user_id", "hour").select("user_id", rounded(F.col("tx_velocity")).alias("tx_velocity"))


def _cycle_sql(x: str, period: int, name: str) -> str:
    return f"round(sin(2 * pi() * {x} / {period}), 6) + 0.0 AS {name}_sin, round(cos(2 * pi() * {x} / {period}), 6) + 0.0 AS {name}_cos"


@query(
    "cyclical_encode",
    f"SELECT event_id, {_cycle_sql('hour(ts)', 24, 'hour')}, {_cycle_sql('(isodow(ts) - 1)', 7, 'dow')}, {_cycle_sql('day(ts)', 31, 'dom')}, {_cycle_sql('month(ts)', 12, 'month')} FROM events",
)
def cyclical_encode(spark, sf_dir):
    parts = {"hour": (F.hour("ts"), 24), "dow": (F.weekday("ts"), 7), "dom": (F.dayofmonth("ts"), 31), "month": (F.month("ts"), 12)}
    columns = [rounded(c).alias(f"{name}_{f}") for name, (x, period) in parts.items() for f, c in zip(("sin", "cos"), features.cyclical(x, period), strict=True)]
    return load(spark, sf_dir, "events").select("event_id", *columns)


@query("label_encode", "SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS BIGINT) AS code FROM customer")
def label_encode(spark, sf_dir):
    return features.label_encode(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code")


@query(
    "standard_scale",
    "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT CASE WHEN stddev_pop(p_retailprice) = 0 THEN 1 ELSE stddev_pop(p_retailprice) END FROM part), 6) AS p_retailprice_scaled, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT CASE WHEN stddev_pop(p_size) = 0 THEN 1 ELSE stddev_pop(p_size) END FROM part), 6) AS p_size_scaled FROM part",
)
def standard_scale(spark, sf_dir):
    out = features.standard_scale(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"])
    return out.select("p_partkey", rounded(F.col("p_retailprice_scaled")).alias("p_retailprice_scaled"), rounded(F.col("p_size_scaled")).alias("p_size_scaled"))


@query("elliptic_time_density", f"WITH {TX_SQL} SELECT step // 30 AS time_step, count(*) AS n, round(ln(1 + count(*)), 6) AS density FROM tx GROUP BY 1")
def elliptic_time_density(spark, sf_dir):
    tx = transactions(spark, sf_dir).select(F.floor(F.col("step") / 30).alias("time_step"))
    return features.time_density(tx, "time_step").withColumn("density", rounded(F.col("density")))


@query("elliptic_illicit_ratio", f"WITH {TX_SQL} SELECT step // 30 AS time_step, round((sum(isMoneyLaundering) + 1) / (count(*) + 2), 6) AS illicit_ratio FROM tx GROUP BY 1")
def elliptic_illicit_ratio(spark, sf_dir):
    tx = transactions(spark, sf_dir).select(F.floor(F.col("step") / 30).alias("time_step"), "isMoneyLaundering")
    return features.illicit_ratio(tx, "time_step", "isMoneyLaundering").withColumn("illicit_ratio", rounded(F.col("illicit_ratio")))


@query(
    "elliptic_row_stats",
    "SELECT vec_id, round(list_avg(a), 5) AS local_mean, round(list_stddev_samp(a), 5) AS local_std, round(list_avg(b), 5) AS agg_mean, round(list_stddev_samp(b), 5) AS agg_std FROM (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:] AS DOUBLE[]) AS b FROM embeddings)",
)
def elliptic_row_stats(spark, sf_dir):
    vector = F.col("embedding").cast("array<double>")
    (m1, s1), (m2, s2) = features.row_stats(F.slice(vector, 1, 32)), features.row_stats(F.slice(vector, 33, 1 << 30))
    return load(spark, sf_dir, "embeddings").select("vec_id", rounded(m1, 5).alias("local_mean"), rounded(s1, 5).alias("local_std"), rounded(m2, 5).alias("agg_mean"), rounded(s2, 5).alias("agg_std"))


@query(
    "elliptic_classes",
    "SELECT doc_id, CASE toxic WHEN 1 THEN '1' WHEN 0 THEN '2' ELSE 'unknown' END AS class, CAST(coalesce(toxic = 1, false) AS INTEGER) AS label_illicit, CAST(coalesce(toxic = 0, false) AS INTEGER) AS label_licit, CAST(toxic IS NOT NULL AS INTEGER) AS is_labeled FROM documents LEFT JOIN labels USING (doc_id)",
)
def elliptic_classes(spark, sf_dir):
    """Features left-joined with classes; rows without a class are 'unknown'."""
    labels = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "1").otherwise("2").alias("class"))
    rows = load(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").fillna({"class": "unknown"})
    flags = [(F.col("class") == "1").cast("int").alias("label_illicit"), (F.col("class") == "2").cast("int").alias("label_licit"), F.col("class").isin("1", "2").cast("int").alias("is_labeled")]
    return rows.select("doc_id", "class", *flags)


@query(
    "elliptic_describe",
    f"WITH {TX_SQL} SELECT count(*) AS n, count(DISTINCT step // 30) AS n_time_steps, CAST(sum(isMoneyLaundering) AS BIGINT) AS illicit, CAST(sum(1 - isMoneyLaundering) AS BIGINT) AS licit, min(step // 30) AS first_time_step, max(step // 30) AS last_time_step FROM tx",
)
def elliptic_describe(spark, sf_dir):
    bucket = F.floor(F.col("step") / 30)
    return transactions(spark, sf_dir).agg(
        F.count("*").alias("n"),
        F.countDistinct(bucket).alias("n_time_steps"),
        F.sum("isMoneyLaundering").alias("illicit"),
        F.sum(1 - F.col("isMoneyLaundering")).alias("licit"),
        F.min(bucket).alias("first_time_step"),
        F.max(bucket).alias("last_time_step"),
    )


@query(
    "temporal_split_threshold",
    f"WITH {TX_SQL} SELECT CASE WHEN step // 30 < 35 THEN 'train' WHEN step // 30 < 42 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, CAST(sum(isMoneyLaundering) AS BIGINT) AS positives FROM tx GROUP BY 1",
)
def temporal_split_threshold(spark, sf_dir):
    at = F.floor(F.col("step") / 30)
    split = F.when(at < 35, "train").when(at < 42, "validation").otherwise("test")
    return transactions(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum("isMoneyLaundering").alias("positives"))


@query("json_metadata", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS meta_k FROM events")
def json_metadata(spark, sf_dir):
    """JSON column flattened; blank and malformed values give nulls."""
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("meta_k"))


@query(
    "json_flatten",
    """WITH v AS (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS p FROM clicks)
SELECT click_id, json_extract_string(p, '$.device.os') AS meta_device_os, json_extract_string(p, '$.device.ver') AS meta_device_ver, json_extract_string(p, '$.k') AS meta_k, CAST(json_extract(p, '$.tags') AS VARCHAR) AS meta_tags,
'[' || array_to_string(list_transform(CAST(json_extract(p, '$.items') AS JSON[]), lambda x: '{"qty":' || json_extract_string(x, '$.qty') || ',"sku":' || json_extract_string(x, '$.sku') || '}'), ',') || ']' AS meta_items FROM v""",
)
def json_flatten(spark, sf_dir):
    """Nested properties of clicks, of forms that differ from row to row, some of them broken."""
    flat = nested.flatten_json(load(spark, sf_dir, "clicks").select("click_id", "props"), "props")
    items = F.nullif("meta_items", F.lit("null")).alias("meta_items")
    return flat.select("click_id", *[F.col(c).cast("string") for c in ("meta_device_os", "meta_device_ver", "meta_k", "meta_tags")], items)


@query(
    "fraud_ratio_sample",
    f"""WITH {TX_SQL}, k AS (SELECT *, md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || CAST(CAST(round(amount * 100) AS BIGINT) AS VARCHAR)) AS h FROM tx),
f AS (SELECT * FROM k WHERE isMoneyLaundering = 1 ORDER BY h LIMIT 50), n AS (SELECT * FROM k WHERE isMoneyLaundering = 0 ORDER BY h LIMIT (500 - (SELECT count(*) FROM f))),
u AS (SELECT * FROM f UNION ALL SELECT * FROM n)
SELECT {ROW_SQL}, nameOrig, nameDest, step, isMoneyLaundering FROM (SELECT *, row_number() OVER (PARTITION BY nameOrig, nameDest, step ORDER BY h) AS r FROM u) WHERE r = 1""",
)
def fraud_ratio_sample(spark, sf_dir):
    """At most 500 rows with a tenth of positives, by hash order, one for each (nameOrig, nameDest, step)."""
    rows, share = 500, 0.1
    seed = F.md5(F.concat_ws(":", F.lit("7"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("amount") * 100).cast("long")))
    tx = transactions(spark, sf_dir).withColumn("h", seed)
    positives = tx.where("isMoneyLaundering = 1").orderBy("h").limit(max(int(rows * share), 1))
    # The sample's size is the operator's parameter, so the rank below runs over at most that many rows.
    negatives = tx.where("isMoneyLaundering = 0").orderBy("h").limit(rows)
    spare = rows - F.col("taken")
    ranked = negatives.withColumn("r", F.row_number().over(W.orderBy("h"))).join(F.broadcast(positives.agg(F.count("*").alias("taken")))).where(F.col("r") <= spare).drop("r", "taken")
    first = F.row_number().over(W.partitionBy("nameOrig", "nameDest", "step").orderBy("h"))
    return positives.unionByName(ranked).withColumn("r", first).where("r = 1").select(*KEYS, "nameOrig", "nameDest", "step", "isMoneyLaundering")


@query("head_limit", f"WITH {TX_SQL} SELECT {ROW_SQL}, amount FROM tx ORDER BY {ORDER_SQL} LIMIT 1000")
def head_limit(spark, sf_dir):
    return transactions(spark, sf_dir).orderBy(*ORDER).limit(1000).select(*KEYS, "amount")


@query(
    "stratified_split",
    f"""WITH {TX_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY isMoneyLaundering ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), amount) AS r, count(*) OVER (PARTITION BY isMoneyLaundering) AS n FROM tx)
SELECT split, isMoneyLaundering, count(*) AS n FROM (SELECT isMoneyLaundering, CASE WHEN r <= n * 0.2 THEN 'test' WHEN r <= n * 0.3 THEN 'validation' ELSE 'train' END AS split FROM k) GROUP BY 1, 2""",
)
def stratified_split(spark, sf_dir):
    """Test 0.2, validation 0.1, the rest train, by class over a hash order.

    Ranks are taken in two steps (count by hash prefix, then rank within a prefix), so that the
    majority class is not sorted in one task.
    """
    from ledgerloom.operators.sampling import ranked_by_hash

    seed = F.md5(F.concat_ws(":", F.lit("7"), *KEYS))
    ranked = ranked_by_hash(transactions(spark, sf_dir).withColumn("h", seed), "isMoneyLaundering", "h", "amount")
    split = F.when(F.col("rank") <= F.col("total") * 0.2, "test").when(F.col("rank") <= F.col("total") * 0.3, "validation").otherwise("train")
    return ranked.groupBy(split.alias("split"), "isMoneyLaundering").agg(F.count("*").alias("n"))

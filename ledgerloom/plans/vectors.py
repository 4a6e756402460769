"""Queries on feature vectors and rewards: accounts and payments of the star schema, users' events as walks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import features, graph, rewards, vectors
from ledgerloom.plans.episodes import E, steps
from ledgerloom.plans.graph import DEG_SQL, G, edges
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import ORDER, load, rounded, transactions

NODES_SQL = f"""{G}, {DEG_SQL},
ro AS (SELECT nameOrig AS id, true AS sent, amount, step, isMoneyLaundering AS f FROM tx UNION ALL SELECT nameDest, false, amount, step, isMoneyLaundering FROM tx),
gp AS (SELECT id, stddev_pop(gap) AS sd FROM (SELECT id, step - lag(step) OVER (PARTITION BY id ORDER BY step) AS gap FROM ro) GROUP BY id),
st AS (SELECT id, coalesce(sum(amount) FILTER (sent), 0) AS total_sent, coalesce(sum(amount) FILTER (NOT sent), 0) AS total_received, count(*) FILTER (sent) AS n_sent, count(*) FILTER (NOT sent) AS n_received, count(*) AS n,
  sum(f) AS hits, max(step) - min(step) + 1 AS span, count(*) FILTER ((step % 24 + 24) % 24 BETWEEN 8 AND 17) AS business FROM ro GROUP BY id),
nd AS (SELECT st.*, CASE WHEN n_sent > 0 AND n_received > 0 THEN 'intermediary' WHEN n_sent > 0 THEN 'customer' ELSE 'merchant' END AS node_type,
  CASE WHEN n > 1 THEN 1 / (1 + coalesce(sd, 0)) ELSE 0 END AS periodicity, in_degree, out_degree, degree / ((SELECT count(*) FROM deg) - 1) AS centrality, total_received - total_sent AS balance
  FROM st JOIN gp USING (id) JOIN deg USING (id)),
nv AS (SELECT id, [CAST(node_type = 'customer' AS DOUBLE), CAST(node_type = 'merchant' AS DOUBLE), 0, 0, 0, ln(1 + total_sent), ln(1 + total_received), ln(1 + abs(balance)), n_sent, n_received, hits / n, CAST(hits > 0 AS DOUBLE),
  n / greatest(span, 1), business / n, periodicity, centrality, 0, in_degree / 100, out_degree / 100, 0] AS v FROM nd)"""


def _sum(v: str) -> str:
    """All elements, in thousandths, and their number."""
    return f"array_to_string(list_transform({v}, lambda x: CAST(round(x * 1000) AS BIGINT)), ',') AS elements, CAST(len({v}) AS INTEGER) AS size"


def _checked(df, *keys):
    whole = F.transform("v", lambda x: F.round(x * 1000).cast("long"))
    return df.select(*keys, F.array_join(whole, ",").alias("elements"), F.size("v").alias("size"))


def payments(spark, sf_dir):
    """Transactions and their edges, both written once, as vectors take them from many sides."""
    tx = graph.cut(transactions(spark, sf_dir).select("nameOrig", "nameDest", *ORDER, "isMoneyLaundering"))
    return tx, graph.cut(graph.last_edges(tx, ORDER))


@query("node_vector_20", f"WITH {NODES_SQL} SELECT id, {_sum('v')} FROM nv")
def node_vector_20(spark, sf_dir):
    return _checked(vectors.account_vectors(*payments(spark, sf_dir), distinct=False), "id")


@query("edge_feature_42", f"WITH {NODES_SQL}, ev AS (SELECT src, dst, list_concat(list_concat(a.v, b.v), [ln(1 + amount), step / 1000]) AS v FROM edges JOIN nv a ON src = a.id JOIN nv b ON dst = b.id) SELECT src, dst, {_sum('v')} FROM ev")
def edge_feature_42(spark, sf_dir):
    tx, e = payments(spark, sf_dir)
    return _checked(vectors.edge_vectors(e, graph.cut(vectors.account_vectors(tx, e, distinct=False))), "src", "dst")


@query(
    "rf_features_20",
    f"""WITH {NODES_SQL}, o AS (SELECT src AS id, count(*) AS n, sum(amount) AS s, avg(amount) AS m, stddev_pop(amount) AS d FROM edges GROUP BY src), i AS (SELECT dst AS id, count(*) AS n, sum(amount) AS s, avg(amount) AS m, stddev_pop(amount) AS d FROM edges GROUP BY dst),
fv AS (SELECT nd.id, [ln(1 + coalesce(o.n, 0)), ln(1 + coalesce(i.n, 0)), ln(1 + coalesce(o.n, 0) + coalesce(i.n, 0)), coalesce(o.n, 0) / greatest(coalesce(i.n, 0), 1), ln(1 + coalesce(o.s, 0)), ln(1 + coalesce(o.m, 0)), ln(1 + coalesce(o.d, 0)), ln(1 + coalesce(i.s, 0)), ln(1 + coalesce(i.m, 0)), ln(1 + coalesce(i.d, 0)),
  hits / nd.n, CAST(hits > 0 AS DOUBLE), CAST(node_type = 'merchant' AS DOUBLE), 0, 0, 0, ln(1 + abs(balance)), ln(1 + total_sent), ln(1 + total_received)] AS v FROM nd LEFT JOIN o USING (id) LEFT JOIN i ON i.id = nd.id) SELECT id, {_sum('v')} FROM fv""",
)
def rf_features_20(spark, sf_dir):
    tx, e = payments(spark, sf_dir)
    return _checked(vectors.forest_vectors(e, features.node_stats(tx)), "id")


@query(
    "elliptic_vector_172",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), ev AS (SELECT vec_id, list_concat(list_transform(range(1, 167), lambda i: coalesce(x[i], 0)), [len(x), list_avg(x), list_max(x), list_min(x), vec_id % 49, ln(1 + vec_id)]) AS v FROM e) SELECT vec_id, {_sum('v')} FROM ev""",
)
def elliptic_vector_172(spark, sf_dir):
    """166 raw features (those the table lacks are 0) and six derived ones."""
    x = F.col("embedding").cast("array<double>")
    mean = F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)
    extra = [F.size(x), mean, F.array_max(x), F.array_min(x), F.col("vec_id") % 49, F.log1p(F.col("vec_id").cast("double"))]
    return _checked(load(spark, sf_dir, "embeddings").select("vec_id", vectors.wide_vector(x, extra).alias("v")), "vec_id")


@query(
    "obs_vector_16",
    f"""WITH {NODES_SQL}, w AS (SELECT src AS id, count(*) AS edges, count(DISTINCT dst) AS visited, CAST(sum(fraud) AS DOUBLE) AS fraud_edges, avg(amount) AS mean_amount FROM edges GROUP BY src),
ov AS (SELECT nd.id, [CASE WHEN balance < 0 THEN -1 WHEN balance > 0 THEN 1 ELSE 0 END * ln(1 + abs(balance)), hits / nd.n, CAST(hits > 0 AS DOUBLE), out_degree, in_degree, CAST(node_type = 'customer' AS DOUBLE), CAST(node_type = 'merchant' AS DOUBLE), 0, 0, 0,
  coalesce(visited, 0) / 50, coalesce(fraud_edges, 0) / greatest(coalesce(edges, 0), 1), ln(1 + coalesce(mean_amount, 0)), out_degree / 10, coalesce(edges, 0) / 50, CAST(hits > 0 AS DOUBLE)] AS v FROM nd LEFT JOIN w USING (id)) SELECT id, {_sum('v')} FROM ov""",
)
def obs_vector_16(spark, sf_dir):
    """Each account as the present one of a walk that has taken all its outgoing edges."""
    tx, e = payments(spark, sf_dir)
    stats = features.node_stats(tx).withColumn("is_suspicious", F.col("label")).withColumn("flagged", F.col("label"))
    # Edges are distinct pairs, so a count of targets is one of distinct targets.
    walk = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"), F.count("dst").alias("visited"), F.sum("fraud").alias("fraud_edges"), F.avg("amount").alias("mean_amount"))
    rows = stats.join(graph.degrees(e), "id").join(walk, "id", "left").withColumn("neighbours", F.col("out_degree")).withColumn("step_count", F.col("edges"))
    return _checked(rows.select("id", vectors.observation_vector().alias("v")), "id")


_WALK = "wk AS (SELECT user_id, event_type AS node, value AS amount, CAST(event_type = 'purchase' AND value >= 50 AS INTEGER) AS fraud, hour(ts) AS hour, value / 100 AS risk FROM events)"


@query(
    "history_vector",
    f"""WITH {_WALK}, a AS (SELECT user_id, count(*) AS edges, avg(fraud) AS rate, avg(amount) AS m, stddev_pop(amount) AS s, max(amount) AS x, avg(hour) AS h FROM wk GROUP BY user_id),
b AS (SELECT user_id, count(*) AS visited, avg(r) AS mr, max(r) AS xr FROM (SELECT user_id, node, max(risk) AS r FROM wk GROUP BY 1, 2) GROUP BY user_id),
hv AS (SELECT user_id, [visited / 100, edges / 100, rate, ln(1 + m), ln(1 + s), ln(1 + x), sin(2 * pi() * h / 24), cos(2 * pi() * h / 24), mr, xr, 0, 0, 0, 0, 0, 0] AS v FROM a JOIN b USING (user_id)) SELECT user_id, {_sum('v')} FROM hv""",
)
def history_vector(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("node"), F.col("value").alias("amount"), ((F.col("event_type") == "purchase") & (F.col("value") >= 50)).cast("int").alias("fraud"), F.hour("ts").alias("hour"), (F.col("value") / 100).alias("risk_score"))
    return _checked(vectors.history_vectors(e, "user_id"), "user_id")


@query("time_encoding", f"WITH t AS (SELECT event_id, event_id % 1000 AS t FROM events), tv AS (SELECT event_id, list_concat(list_transform(range(4), lambda i: sin(t * pow(10000, -2 * i / 8))), list_transform(range(4), lambda i: cos(t * pow(10000, -2 * i / 8)))) AS v FROM t) SELECT event_id, {_sum('v')} FROM tv")
def time_encoding(spark, sf_dir):
    return _checked(load(spark, sf_dir, "events").select("event_id", vectors.time_encoding(F.col("event_id") % 1000).alias("v")), "event_id")


@query("periodicity_cv", f"WITH {G}, x AS (SELECT src AS id, step FROM edges UNION ALL SELECT dst, step FROM edges) SELECT id, round(CASE WHEN count(*) < 2 OR avg(step) = 0 THEN 0 ELSE 1 / (1 + stddev_pop(step) / avg(step)) END, 6) AS periodicity FROM x GROUP BY id")
def periodicity_cv(spark, sf_dir):
    return vectors.periodicity(edges(spark, sf_dir)).select("id", rounded(F.col("periodicity")).alias("periodicity"))


# Rewards


@query(
    "flag_reward",
    f"""WITH {E}, r AS (SELECT user_id, event_id, step, event_type = 'purchase' AS fraud, value / 100 AS c, lag(step % 7) OVER (PARTITION BY user_id ORDER BY step) AS d0, step % 7 AS d1, row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) - 1 AS visits FROM e)
SELECT event_id, round(CASE WHEN fraud THEN 10 ELSE -10 END * (0.5 + 0.5 * c), 6) AS flag, round(0.05 * (coalesce(d0, 999) - 0.99 * d1), 6) AS proximity, round(CASE WHEN fraud THEN 2 ELSE 1 END * 0.05 / (1 + visits), 6) AS curiosity,
  round(CASE WHEN fraud THEN 10 ELSE -5 END * (0.5 + 0.5 * c), 6) AS detector, round(CASE WHEN fraud THEN -10 ELSE 5 * (0.5 + 0.5 * c) * 0.5 END, 6) AS adversary FROM r""",
)
def flag_reward(spark, sf_dir):
    """Flag, proximity and curiosity rewards of each event of a user, and how detector and adversary share."""
    w = W.partitionBy("user_id").orderBy("step")
    fraud, c = F.col("event_type") == "purchase", F.col("value") / 100
    visits = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("step")) - 1
    detector, adversary = rewards.split_rewards(fraud, c)
    return steps(spark, sf_dir).select(
        "event_id",
        rounded(rewards.flag_reward(fraud, c)).alias("flag"),
        rounded(rewards.proximity_reward(F.lag(F.col("step") % 7).over(w), F.col("step") % 7)).alias("proximity"),
        rounded(rewards.curiosity_reward(visits, fraud)).alias("curiosity"),
        rounded(detector).alias("detector"),
        rounded(adversary).alias("adversary"),
    )


@query(
    "flag_step_reward",
    f"""WITH RECURSIVE {E}, s AS (SELECT user_id, step, 'n' || event_id % 13 AS node, value >= 60 AS is_flag, CASE WHEN event_id % 5 > 0 THEN event_type = 'purchase' END AS hit, row_number() OVER (PARTITION BY user_id ORDER BY step) AS i FROM e),
t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS j FROM s WHERE is_flag),
r(user_id, step, j, i, seen, reason) AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM t UNION ALL
  SELECT user_id, step, j, i, CASE WHEN reason IN ('true_positive', 'false_positive', 'unknown') THEN list_append(seen, node) ELSE seen END, reason FROM (SELECT t.user_id, t.step, t.j, t.i, r.seen, t.node,
    CASE WHEN t.i - r.i < 3 THEN 'cooldown_violation' WHEN len(r.seen) >= 5 THEN 'max_flags_exceeded' WHEN list_contains(r.seen, t.node) THEN 'duplicate_flag' WHEN t.hit THEN 'true_positive' WHEN NOT t.hit THEN 'false_positive' ELSE 'unknown' END AS reason
    FROM r JOIN t ON t.user_id = r.user_id AND t.j = r.j + 1))
SELECT user_id, step, reason, CASE reason WHEN 'cooldown_violation' THEN -0.5 WHEN 'max_flags_exceeded' THEN -0.3 WHEN 'duplicate_flag' THEN -0.2 WHEN 'true_positive' THEN 1.0 WHEN 'false_positive' THEN -0.5 ELSE 0.1 END::DOUBLE AS reward FROM r WHERE j > 0""",
)
def flag_step_reward(spark, sf_dir):
    s = steps(spark, sf_dir).select("user_id", "step", F.concat(F.lit("n"), F.col("event_id") % 13).alias("node"), (F.col("value") >= 60).alias("is_flag"), F.when(F.col("event_id") % 5 > 0, F.col("event_type") == "purchase").alias("hit"))
    return rewards.flag_step_rewards(s, "user_id", "step").select("user_id", "step", "reason", "reward")


@query("move_step_reward", f"WITH {E} SELECT event_id, round(-0.01 + CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) = 1 THEN 0.005 ELSE 0 END + CASE WHEN value / 100 > 0.5 THEN 0.01 * value / 100 ELSE 0 END, 6) AS reward FROM e")
def move_step_reward(spark, sf_dir):
    moved = rewards.move_step_rewards(steps(spark, sf_dir), "user_id", "step", "event_type", F.col("value") / 100)
    return moved.select("event_id", rounded(F.col("reward")).alias("reward"))


@query("softmax_sampling", f"WITH {E}, x AS (SELECT user_id, event_id, exp((value - max(value) OVER (PARTITION BY user_id)) / 20) AS x FROM e) SELECT event_id, round(x / sum(x) OVER (PARTITION BY user_id), 6) AS p FROM x")
def softmax_sampling(spark, sf_dir):
    return rewards.softmax(steps(spark, sf_dir), "user_id", "value", 20.0).select("event_id", rounded(F.col("p")).alias("p"))


@query(
    "softmax_draw",
    f"""WITH {E}, d AS (SELECT user_id, event_id, CAST(draw AS INTEGER) AS draw, value / 20 - ln(-ln((CAST('0x' || substr(md5('7:' || draw || ':' || user_id || ':' || event_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)) AS s FROM e, range(3) AS r(draw) WHERE value IS NOT NULL)
SELECT user_id, draw, arg_max(event_id, s) AS event_id FROM d GROUP BY user_id, draw""",
)
def softmax_draw(spark, sf_dir):
    """Three draws of each user's events, by their values."""
    return rewards.drawn(load(spark, sf_dir, "events"), "user_id", "event_id", "value", 20.0, draws=3)


@query(
    "augment_node_features",
    f"""WITH {G}, p AS (SELECT id, max(s) AS proposal FROM (SELECT src AS id, (step % 10) / 10 AS s FROM edges WHERE fraud = 1 UNION ALL SELECT dst, (step % 10) / 10 FROM edges WHERE fraud = 1) GROUP BY id),
j AS (SELECT src AS id, max((((step % 21) - 10) / 10 + 1) / 2 * ((step % 5) / 5)) AS judge FROM edges GROUP BY src), n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
SELECT id, round(coalesce(proposal, 0), 6) AS proposal, round(coalesce(judge, 0), 6) AS judge, round(0.4 * coalesce(proposal, 0) + 0.6 * coalesce(judge, 0), 6) AS combined FROM n LEFT JOIN p USING (id) LEFT JOIN j USING (id)""",
)
def augment_node_features(spark, sf_dir):
    e = graph.cut(edges(spark, sf_dir))
    proposals = e.where("fraud = 1").select("src", "dst", (F.col("step") % 10 / 10).alias("score"))
    judged = e.select(F.col("src").alias("id"), ((F.col("step") % 21 - 10) / 10).alias("score"), (F.col("step") % 5 / 5).alias("confidence"))
    return rewards.augmented_scores(graph.nodes(e), proposals, judged).select("id", *[rounded(F.col(c)).alias(c) for c in ("proposal", "judge", "combined")])


@query(
    "focal_temporal_weights",
    "WITH t AS (SELECT event_id, value / 100 AS p, CAST(event_type = 'purchase' AS INTEGER) AS y, event_id % 100 AS t FROM events) SELECT event_id, round(pow(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END, 2), 6) AS focal, round(exp(0.01 * t) / (SELECT avg(exp(0.01 * t)) FROM t), 6) AS weight FROM t",
)
def focal_temporal_weights(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("event_id") % 100).alias("t"))
    return rewards.temporal_weights(e, "t", 0.01).select("event_id", rounded(rewards.focal_weight(F.col("p"), F.col("y"))).alias("focal"), rounded(F.col("weight")).alias("weight"))


@query(
    "hard_metric",
    "WITH a AS (SELECT user_id, list(DISTINCT event_type) FILTER (value >= 80) AS f, list(DISTINCT event_type) FILTER (value BETWEEN 40 AND 90) AS t FROM events GROUP BY user_id), b AS (SELECT user_id, coalesce(f, []) AS f, coalesce(t, []) AS t FROM a), c AS (SELECT user_id, CASE WHEN len(f) = 0 OR len(t) = 0 THEN 0 ELSE 2 * len(list_intersect(f, t)) / (len(f) + len(t)) END AS f1 FROM b) SELECT user_id, round(f1, 6) AS f1, round(2 * f1 - 1, 6) AS target FROM c",
)
def hard_metric(spark, sf_dir):
    """F1 of what a user found against what was there, and the reward that a judge is to learn."""
    sets = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") >= 80, F.col("event_type"))).alias("f"), F.collect_set(F.when(F.col("value").between(40, 90), F.col("event_type"))).alias("t"))
    f1 = rewards.set_f1(F.col("f"), F.col("t"))
    return sets.select("user_id", rounded(f1).alias("f1"), rounded(rewards.target_reward(f1)).alias("target"))

"""Episode queries: a user's events are an episode, their values rewards; conversations are turn sequences; embeddings are vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import episodes, sampling
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load, rounded

E = "e AS (SELECT user_id, event_id, event_type, value, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step FROM events)"


def steps(spark, sf_dir):
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts").withColumn("step", (F.row_number().over(order) - 1).cast("long"))


def _r(df, *keep, places=4):
    return df.select(*keep, *[rounded(F.col(c), places).alias(c) for c in df.columns if c not in keep])


@query("episode_stats", f"WITH {E} SELECT user_id, count(*) AS length, round(sum(value), 4) AS total_return, round(sum(pow(0.99, step) * value), 4) AS discounted_return FROM e GROUP BY user_id")
def episode_stats(spark, sf_dir):
    return _r(episodes.episode_stats(steps(spark, sf_dir), "user_id", "step", "value"), "user_id", "length")


@query(
    "episode_confusion",
    f"WITH {E} SELECT user_id, count(*) FILTER (value >= 50 AND event_type = 'purchase') AS tp, count(*) FILTER (value >= 50 AND event_type <> 'purchase') AS fp, count(*) FILTER (value < 50 AND event_type = 'purchase') AS fn, count(*) FILTER (value < 50 AND event_type <> 'purchase') AS tn FROM e GROUP BY user_id",
)
def episode_confusion(spark, sf_dir):
    flagged, positive = F.col("value") >= 50, F.col("event_type") == "purchase"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(count(flagged & positive).alias("tp"), count(flagged & ~positive).alias("fp"), count(~flagged & positive).alias("fn"), count(~flagged & ~positive).alias("tn"))


@query("n_step_return", f"WITH {E} SELECT event_id, round(value + coalesce(0.9 * lead(value) OVER w, 0) + coalesce(0.81 * lead(value, 2) OVER w, 0), 4) AS n_step_return FROM e WINDOW w AS (PARTITION BY user_id ORDER BY step)")
def n_step_return(spark, sf_dir):
    return _r(episodes.n_step_returns(steps(spark, sf_dir), "user_id", "step", "value", 3, 0.9).select("event_id", "n_step_return"), "event_id")


@query("cumulative_reward", f"WITH {E} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY step), 4) AS cumulative FROM e")
def cumulative_reward(spark, sf_dir):
    return _r(steps(spark, sf_dir).select("event_id", F.sum("value").over(W.partitionBy("user_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)).alias("cumulative")), "event_id")


_CURVE = f"{E}, c AS (SELECT user_id, step, CASE WHEN count(*) OVER (PARTITION BY user_id) < 10 THEN value ELSE avg(value) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS smoothed FROM e)"


@query("learning_curve", f"WITH {_CURVE} SELECT user_id, step, round(smoothed + 1e-7, 4) AS smoothed FROM c")
def learning_curve(spark, sf_dir):
    return _r(episodes.trailing_mean(steps(spark, sf_dir), "user_id", "step", "value").select("user_id", "step", (F.col("smoothed") + 1e-7).alias("smoothed")), "user_id", "step")


@query("episodes_to_target", f"WITH {_CURVE} SELECT user_id, coalesce(min(step) FILTER (smoothed >= 60), -1) AS episodes_to_target FROM c GROUP BY user_id")
def episodes_to_target(spark, sf_dir):
    return episodes.episodes_to_target(episodes.trailing_mean(steps(spark, sf_dir), "user_id", "step", "value"), "user_id", "step", 60.0)


@query(
    "convergence_detect",
    f"WITH {E}, v AS (SELECT user_id, step, var_pop(value) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, coalesce(min(step) FILTER (step >= 5 AND step < n - 5 AND v < 300), any_value(n)) AS converged_at FROM v GROUP BY user_id",
)
def convergence_detect(spark, sf_dir):
    return episodes.convergence(steps(spark, sf_dir), "user_id", "step", "value", 5, 300.0)


@query("rl_aggregate", f"WITH {E}, t AS (SELECT user_id, sum(value) AS r FROM e GROUP BY user_id) SELECT round(avg(r), 4) AS mean, round(stddev_pop(r), 4) AS std, round(min(r), 4) AS min, round(max(r), 4) AS max, round(median(r), 4) AS median, count(*) AS n FROM t")
def rl_aggregate(spark, sf_dir):
    t = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("r"))
    return _r(t.agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"), F.percentile("r", 0.5).alias("median"), F.count("*").alias("n")), "n")


@query("gini", f"WITH {E}, t AS (SELECT user_id, count(*)::DOUBLE AS x FROM e GROUP BY user_id), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM t) SELECT round((2 * sum(i * x) - (any_value(n) + 1) * sum(x)) / (any_value(n) * sum(x)), 6) AS gini FROM r")
def gini(spark, sf_dir):
    return _r(episodes.gini(load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("x")), "x"), places=6)


@query("workload_balance", "WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT round(1 / (1 + stddev_pop(n) / avg(n)), 6) AS workload_balance FROM t")
def workload_balance(spark, sf_dir):
    return _r(episodes.workload_balance(load(spark, sf_dir, "events"), "user_id"), places=6)


@query("coordination_efficiency", "SELECT event_type, round(count(DISTINCT user_id) / count(*), 6) AS efficiency FROM events GROUP BY event_type")
def coordination_efficiency(spark, sf_dir):
    return _r(load(spark, sf_dir, "events").groupBy("event_type").agg((F.countDistinct("user_id") / F.count("*")).alias("efficiency")), "event_type", places=6)


_DRIFT = f"""{E}, d AS (SELECT user_id, step, value - lag(value) OVER w AS a, event_id % 97 - lag(event_id % 97) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY step)),
c AS (SELECT user_id, step, CASE WHEN count(a) OVER s >= 10 AND stddev_pop(a) OVER s > 1e-6 AND stddev_pop(b) OVER s > 1e-6 THEN corr(a, b) OVER s END AS c FROM d WINDOW s AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


@query("drift_alarm", f"WITH {_DRIFT} SELECT user_id, step, round(c, 5) + 0.0 AS corr, coalesce(c < -0.3, false) AS alarm FROM c")
def drift_alarm(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("judge", (F.col("event_id") % 97).cast("double"))
    return _r(episodes.rolling_correlation(s, "user_id", "step", "value", "judge", 50, 10).select("user_id", "step", "corr", "alarm"), "user_id", "step", "alarm", places=5)


@query("ring_buffer", f"WITH {E} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS r FROM e) WHERE r <= 20")
def ring_buffer(spark, sf_dir):
    return episodes.ring_buffer(steps(spark, sf_dir), "user_id", "step", 20).select("user_id", "event_id")


@query("priority_queue", f"WITH {E} SELECT event_type, event_id, CAST(r AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM e) WHERE r <= 25")
def priority_queue(spark, sf_dir):
    return episodes.priority_queue(load(spark, sf_dir, "events"), "event_type", "value", "event_id", 25).select("event_type", "event_id", "position")


@query(
    "prioritized_sample",
    "WITH k AS (SELECT event_id, -ln((CAST(('0x' || substr(md5('per:' || event_id), 1, 8)) AS BIGINT) + 1) / 4294967297) / pow(abs(value) + 1e-6, 0.6) AS k FROM events) SELECT event_id FROM k ORDER BY round(k, 9), event_id LIMIT 64",
)
def prioritized_sample(spark, sf_dir):
    u = (sampling.uniform("event_id", seed="per") * float(1 << 32) + 1) / float((1 << 32) + 1)
    out = episodes.prioritized_sample(load(spark, sf_dir, "events").select("event_id", "value"), F.abs("value") + 1e-6, u, 64, "event_id")
    return out.select("event_id")


@query("ema", f"WITH {E}, n AS (SELECT user_id, value, step + 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, round(sum(pow(0.9, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.1 END * value), 4) AS ema FROM n GROUP BY user_id")
def ema(spark, sf_dir):
    return _r(episodes.ema(steps(spark, sf_dir), "user_id", "step", "value", 0.9), "user_id")


@query(
    "bio_spans",
    f"WITH {E}, s AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY step) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS b FROM e), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY step) AS g FROM s) SELECT user_id, event_type, min(step) AS first, max(step) AS last, count(*) AS n FROM g GROUP BY user_id, g, event_type",
)
def bio_spans(spark, sf_dir):
    return episodes.runs(steps(spark, sf_dir), "user_id", "step", "event_type")


@query("inference_report", f"WITH {E} SELECT event_type, count(*) AS steps, count(DISTINCT user_id) AS episodes, round(avg(value), 4) AS mean_reward, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS flag_rate FROM e GROUP BY event_type")
def inference_report(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("steps"), F.countDistinct("user_id").alias("episodes"), rounded(F.avg("value"), 4).alias("mean_reward"), rounded(F.avg((F.col("value") >= 50).cast("double"))).alias("flag_rate"))


@query("episode_alias", "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, role, 'ENTITY_' || chr(CAST(65 + (row_number() OVER (PARTITION BY conv_id ORDER BY t, role) - 1) % 26 AS INTEGER)) AS alias FROM f")
def episode_alias(spark, sf_dir):
    """Roles by first appearance in an episode."""
    first = load(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy("t", "role")) - 1
    return first.select("conv_id", "role", F.concat(F.lit("ENTITY_"), F.char(65 + rank % 26)).alias("alias"))


@query("episode_serialize", "SELECT conv_id, left(sha256(count(*) || ':' || min(turn)), 16) AS episode_id, string_agg('[' || upper(role) || '] ' || left(sha256(coalesce(text, '')), 8), ' ' ORDER BY turn, role) AS serialized FROM conversations GROUP BY conv_id")
def episode_serialize(spark, sf_dir):
    part = F.struct("turn", "role", F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8)).alias("s"))
    grouped = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.array_sort(F.collect_list(part)).alias("p"))
    return grouped.select("conv_id", F.substring(F.sha2(F.concat_ws(":", "n", "first"), 256), 1, 16).alias("episode_id"), F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("serialized"))


@query("curriculum_stage", "SELECT event_id, least(event_id // 2000, 4) AS stage, round(20 + (200 - 20) * least(event_id / 10000, 1), 4) AS max_steps, round(greatest(0.05, pow(0.995, event_id // 100)), 6) AS epsilon FROM events")
def curriculum_stage(spark, sf_dir):
    i = F.col("event_id")
    return load(spark, sf_dir, "events").select("event_id", F.least(F.floor(i / 2000), F.lit(4)).alias("stage"), rounded(20 + 180 * F.least(i / 10000, F.lit(1.0)), 4).alias("max_steps"), rounded(F.greatest(F.lit(0.05), F.pow(F.lit(0.995), F.floor(i / 100)))).alias("epsilon"))


@query("checkpoint_retention", "SELECT event_id FROM events WHERE event_id % 100 = 0 OR event_id > (SELECT max(event_id) FROM events) - 5")
def checkpoint_retention(spark, sf_dir):
    """The last five and every hundredth; ids are dense, so the last five follow from the greatest."""
    e = load(spark, sf_dir, "events").select("event_id")
    return e.join(F.broadcast(e.agg(F.max("event_id").alias("top")))).where("event_id % 100 = 0 OR event_id > top - 5").select("event_id")


@query("calibration_degradation", f"""WITH {E}, r AS (SELECT user_id, abs(value - 50) AS err, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS r FROM e)
SELECT user_id, round(avg(err) FILTER (r <= 25), 4) AS late, round(avg(err) FILTER (r > 25), 4) AS early, coalesce(avg(err) FILTER (r <= 25) > 1.5 * avg(err) FILTER (r > 25), false) AS degraded FROM r WHERE r <= 50 GROUP BY user_id""")
def calibration_degradation(spark, sf_dir):
    last = steps(spark, sf_dir).withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("step")))).where("r <= 50").withColumn("err", F.abs(F.col("value") - 50))
    half = lambda c: F.avg(F.when(c, F.col("err")))
    out = last.groupBy("user_id").agg(half(F.col("r") <= 25).alias("late"), half(F.col("r") > 25).alias("early"))
    return out.select("user_id", rounded(F.col("late"), 4).alias("late"), rounded(F.col("early"), 4).alias("early"), F.coalesce(F.col("late") > 1.5 * F.col("early"), F.lit(False)).alias("degraded"))


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


@query("cosine_to_first", f"WITH {_V}, f AS (SELECT x AS y FROM v WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-8), 5) AS cosine, CASE WHEN list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-8) >= 0.7 THEN 'high' WHEN list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-8) >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM v, f")
def cosine_to_first(spark, sf_dir):
    """Similarity to one stated vector (a single row, broadcast), and its band."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    one = v.where("vec_id = 0").select(F.col("x").alias("y"))
    c = v.join(F.broadcast(one)).withColumn("c", episodes.cosine(F.col("x"), F.col("y")))
    return c.select("vec_id", rounded(F.col("c"), 5).alias("cosine"), F.when(F.col("c") >= 0.7, "high").when(F.col("c") >= 0.3, "medium").otherwise("low").alias("band"))


@query(
    "similarity_bands",
    f"WITH {_V}, f AS (SELECT x AS y FROM v WHERE vec_id = 0), c AS (SELECT vec_id, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-8) AS c, list_distance(x, y) AS d FROM v, f), m AS (SELECT max(d) AS top FROM c) SELECT vec_id, CASE WHEN c >= 0.3 THEN 'high' WHEN c >= 0.1 THEN 'medium' ELSE 'low' END AS band, round(CASE WHEN top > 0 THEN d / top ELSE 0 END, 5) AS weight FROM c, m",
)
def similarity_bands(spark, sf_dir):
    """Bands of the similarity to one stated vector (a single row, broadcast), and distances as weights, over the largest one."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    one = v.where("vec_id = 0").select(F.col("x").alias("y"))
    return episodes.banded(v.join(F.broadcast(one)), "vec_id", F.col("x"), F.col("y"), 0.3, 0.1).withColumn("weight", rounded(F.col("weight"), 5))


@query("anomaly_zscore", f"WITH {_V}, l AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM v), s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY d), a AS (SELECT vec_id, avg(abs((x - m) / (s + 1e-8))) AS z FROM l JOIN s USING (d) GROUP BY vec_id) SELECT vec_id, round((exp(2 * z) - 1) / (exp(2 * z) + 1), 5) AS score FROM a")
def anomaly_zscore(spark, sf_dir):
    return _r(episodes.anomaly_zscore(load(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", places=5)


@query("anomaly_centroid", f"WITH {_V}, l AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM v), s AS (SELECT d, avg(x) AS m FROM l GROUP BY d), a AS (SELECT vec_id, sqrt(sum(pow(x - m, 2))) AS t FROM l JOIN s USING (d) GROUP BY vec_id) SELECT vec_id, round(t / ((SELECT max(t) FROM a) + 1e-8), 5) AS score FROM a")
def anomaly_centroid(spark, sf_dir):
    return _r(episodes.anomaly_centroid(load(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", places=5)


@query("cvar", f"WITH {_V} SELECT vec_id, round(list_avg(list_sort(x)[1:greatest(1, CAST(floor((1 - 0.75) * len(x)) AS INTEGER))]), 5) AS cvar FROM v")
def cvar(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", rounded(episodes.cvar(F.col("embedding").cast("array<double>"), 0.75), 5).alias("cvar"))


@query("reward_combination", "SELECT event_id, round((exp(2 * (least(greatest(value, 0), 100) / 10)) - 1) / (exp(2 * (least(greatest(value, 0), 100) / 10)) + 1), 6) AS squashed FROM events")
def reward_combination(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", rounded(F.tanh(F.least(F.greatest("value", F.lit(0.0)), F.lit(100.0)) / 10)).alias("squashed"))


def _walks(spark, sf_dir):
    """Users' events as walks: an event's type is the node, its value risk, balance and amount."""
    v = F.col("value")
    return steps(spark, sf_dir).select(
        "user_id", "step", F.col("event_type").alias("node"), F.when(F.col("event_type") == "purchase", "merchant").otherwise("customer").alias("kind"), F.lit(0.25).alias("risk"), F.length("event_type").cast("double").alias("balance"),
        (F.col("event_id") % 4).alias("action"), (v >= 60).alias("is_flag"), v.alias("amount"), (F.col("event_type") == "purchase").alias("fraud"), F.lit(0.75).alias("confidence"), (v / 100).alias("reward"),
    )


_ANON = "left(sha256({x}), 8)"


@query(
    "episode_sections",
    f"""WITH {E}, f AS (SELECT user_id, event_type AS node, min(step) AS step FROM e GROUP BY 1, 2), n AS (SELECT user_id, node, row_number() OVER (PARTITION BY user_id ORDER BY step) AS r, 'type:' || CASE node WHEN 'purchase' THEN 'merchant' ELSE 'customer' END || ' risk:0.25 bal:' || printf('%.2f', ln(1 + length(node))) AS shown FROM f),
ns AS (SELECT user_id, string_agg('n:' || {_ANON.format(x='node')} || ' ' || shown, ' | ' ORDER BY sha256(shown), 'n:' || {_ANON.format(x='node')} || ' ' || shown) FILTER (r <= 50) AS nodes, count(*) AS u FROM n GROUP BY user_id),
l AS (SELECT user_id, step, value, event_type AS node, lead(event_type) OVER (PARTITION BY user_id ORDER BY step) AS nxt FROM e), ed AS (SELECT user_id, step, value, row_number() OVER (PARTITION BY user_id ORDER BY step) AS r, {_ANON.format(x='node')} || '->' || {_ANON.format(x='nxt')} AS who, 'amt:' || printf('%.2f', ln(1 + value)) || ' t:' || step AS shown FROM l WHERE nxt IS NOT NULL),
es AS (SELECT user_id, string_agg('e:' || who || ' ' || shown, ' | ' ORDER BY sha256(shown), 'e:' || who || ' ' || shown) FILTER (r <= 100) AS edges, CASE WHEN count(*) > 1 THEN 'velocity:' || printf('%.2f', count(*) / (max(step) - min(step) + 1)) || ' ' ELSE '' END || 'amt_mean:' || printf('%.2f', avg(value) + 1e-9) || ' amt_std:' || printf('%.2f', stddev_pop(value)) || ' amt_max:' || printf('%.2f', max(value)) AS t FROM ed GROUP BY user_id),
a AS (SELECT user_id, event_id % 4 AS a, count(*) AS n, count(*) FILTER (value >= 60) AS f FROM e GROUP BY 1, 2), ac AS (SELECT user_id, string_agg('a' || a || ':' || n, ' ' ORDER BY a) AS actions, sum(n) AS total, sum(f) AS flags FROM a GROUP BY user_id)
SELECT user_id, md5(concat_ws(' ', '[META] episode_length:' || total || ' unique_nodes:' || u || ' flags_used:' || flags, '[NODES] ' || nodes, '[EDGES] ' || coalesce(edges, 'empty'), '[ACTIONS] ' || actions || ' total:' || total)) AS h, regexp_extract(t, 'amt_max:.*') AS top FROM ac JOIN ns USING (user_id) LEFT JOIN es USING (user_id)""",
)
def episode_sections(spark, sf_dir):
    out = episodes.serialized(_walks(spark, sf_dir), "user_id")
    return out.select("user_id", F.md5(F.regexp_replace("text", r" \[TEMPORAL\].*", "")).alias("h"), F.when(F.contains("text", F.lit("amt_max")), F.regexp_extract("text", "amt_max:.*", 0)).alias("top"))


@query("episode_text")
def episode_text(spark, sf_dir):
    return episodes.episode_text(_walks(spark, sf_dir), "user_id")


@query("median_of_quantiles", f"WITH {_V} SELECT vec_id, round(list_sort(x)[CAST(floor((len(x) - 1) / 2) AS INTEGER) + 1], 5) AS median FROM v")
def median_of_quantiles(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", rounded(episodes.median_low(F.col("embedding").cast("array<double>")), 5).alias("median"))


@query("anomaly_pairwise", f"WITH {_V}, p AS (SELECT a.vec_id, sum(pow(list_distance(a.x, b.x), 2)) / ((SELECT count(*) FROM v) - 1) AS m FROM v a, v b GROUP BY a.vec_id) SELECT vec_id, round((m - (SELECT min(m) FROM p)) / ((SELECT max(m) FROM p) - (SELECT min(m) FROM p) + 1e-8), 5) AS score FROM p")
def anomaly_pairwise(spark, sf_dir):
    return _r(episodes.anomaly_pairwise(load(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", places=5)


@query("priority_queue_typed", "WITH q AS (SELECT user_id % 10 AS agent, event_id, value, row_number() OVER (PARTITION BY user_id % 10 ORDER BY value DESC, event_id) AS position FROM events WHERE event_type = 'purchase' AND event_id % 10 <> user_id % 10) SELECT agent, event_id, CAST(position AS INTEGER) AS position FROM q WHERE position <= 5")
def priority_queue_typed(spark, sf_dir):
    """Messages of one type, none to its own sender."""
    e = load(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("user_id") % 10).alias("agent"), (F.col("event_id") % 10).alias("sender"), "event_id", "value")
    return episodes.priority_queue(e.where("sender <> agent"), "agent", "value", "event_id", 5).select("agent", "event_id", "position")


@query(
    "exploration_rates",
    """WITH x AS (SELECT client_id AS c, json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS node, coalesce(kind = 'error', false) AS fe, coalesce(value > 80, false) AS fl FROM clicks WHERE client_id IS NOT NULL),
t AS (SELECT c, count(*) AS edges, count(*) FILTER (fe) AS fraud_edges_found, count(DISTINCT node) AS unique_nodes_explored, count(DISTINCT node) FILTER (fe) AS fraud_nodes_visited, count(*) FILTER (fl AND fe) AS tp, count(*) FILTER (fl AND NOT fe) AS fp, count(*) FILTER (NOT fl AND fe) AS fn FROM x GROUP BY c),
r AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM t)
SELECT c AS client_id, fraud_edges_found, round(fraud_edges_found / greatest(edges, 1), 6) AS fraud_edge_discovery_rate, unique_nodes_explored, fraud_nodes_visited, round(fraud_nodes_visited / greatest(unique_nodes_explored, 1), 6) AS fraud_node_rate, round(unique_nodes_explored / greatest(edges, 1), 6) AS exploration_efficiency,
round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-8), 6) AS f1 FROM r""",
)
def exploration_rates(spark, sf_dir):
    """A client's clicks as an episode: errors are finds, places are what a click's properties name, and clicks of a high value are flagged."""
    clicks = load(spark, sf_dir, "clicks").where("client_id IS NOT NULL").select("client_id", F.get_json_object("props", "$.k").alias("node"), "kind", "value", "props")
    clicks = clicks.withColumn("node", F.when(F.try_parse_json("props").isNotNull(), F.col("node")))
    hit, flagged = F.coalesce(F.col("kind") == "error", F.lit(False)), F.coalesce(F.col("value") > 80, F.lit(False))
    out = episodes.exploration_rates(clicks, "client_id", "node", hit, hit, flagged)
    return _r(out, "client_id", "fraud_edges_found", "unique_nodes_explored", "fraud_nodes_visited", places=6)


@query(
    "coordination_stats",
    """WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS kind, count(*) AS n, sum(len(regexp_extract_all(coalesce(text, ''), '\\?'))) AS p FROM conversations GROUP BY 1, 2, 3),
k AS (SELECT conv_id, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS kinds, sum(n) AS messages FROM (SELECT conv_id, kind, sum(n) AS n FROM s GROUP BY 1, 2) GROUP BY conv_id),
t AS (SELECT conv_id, count(*) AS total_steps, avg(p) AS avg_proposals_per_step FROM (SELECT conv_id, turn, sum(p) AS p FROM s GROUP BY 1, 2) GROUP BY conv_id)
SELECT t.conv_id, total_steps, CAST(messages AS BIGINT) AS messages, kinds, round(avg_proposals_per_step, 6) AS avg_proposals_per_step FROM t JOIN k ON t.conv_id = k.conv_id""",
)
def coordination_stats(spark, sf_dir):
    """Conversations as message buses: turns are steps, roles kinds of messages, questions proposals."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("kind"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\?")).alias("asked"))
    return _r(episodes.coordination_stats(rows, "conv_id", "turn", "kind", "asked"), "conv_id", "total_steps", "messages", "kinds", places=6)

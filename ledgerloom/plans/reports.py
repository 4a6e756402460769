"""Queries of reports: users' events as training runs, requests, proposals and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import corpus, graph, isotonic, metrics, reports, sampling
from ledgerloom.plans.episodes import E, steps
from ledgerloom.plans.graph import G, edges
from ledgerloom.plans.ranking import SCORED_SQL, _rounded, scored
from ledgerloom.plans.registry import query
from ledgerloom.plans.texts import _PACK
from ledgerloom.sources.tables import load, rounded

_LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS back FROM e) WHERE back <= {n})"


@query("rolling_window_stats", f"WITH {E}, {_LAST.format(n=20)} SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS success FROM l GROUP BY user_id")
def rolling_window_stats(spark, sf_dir):
    return _rounded(reports.rolling_window_stats(steps(spark, sf_dir), "user_id", "step", "value", 20, 50.0), "user_id", "min", "max")


@query(
    "moving_average_valid",
    f"WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e), w AS (SELECT *, greatest(1, least(50, n // 10)) AS w FROM n) SELECT a.event_id, round(avg(b.value), 6) AS smoothed FROM w a JOIN w b ON a.user_id = b.user_id AND b.step > a.step - a.w AND b.step <= a.step WHERE a.step + 1 >= a.w GROUP BY a.event_id",
)
def moving_average_valid(spark, sf_dir):
    return reports.moving_average(steps(spark, sf_dir), "user_id", "step", "value").select("event_id", rounded(F.col("smoothed")).alias("smoothed"))


@query("rolling_mean_min_periods", f"WITH {E}, x AS (SELECT event_id, avg(value) OVER w AS m, count(value) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT event_id, round(m, 6) AS partial, CASE WHEN n >= 7 THEN round(m, 6) END AS whole FROM x")
def rolling_mean_min_periods(spark, sf_dir):
    s = steps(spark, sf_dir)
    partial = reports.rolling_mean(s, "user_id", "step", "value", 7, 1).withColumnRenamed("rolling", "partial")
    both = reports.rolling_mean(partial, "user_id", "step", "value", 7)
    return both.select("event_id", rounded(F.col("partial")).alias("partial"), rounded(F.col("rolling")).alias("whole"))


@query("reward_correlation", f"WITH {E}, {_LAST.format(n=100)}, c AS (SELECT user_id, count(*) AS n, stddev_pop(value) AS x, stddev_pop(event_id % 17) AS y, covar_pop(value, event_id % 17) AS c FROM l GROUP BY user_id) SELECT user_id, round(CASE WHEN n < 10 OR x < 1e-6 OR y < 1e-6 THEN 1 ELSE c / (x * y) END, 6) AS correlation FROM c")
def reward_correlation(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("judge", (F.col("event_id") % 17).cast("double"))
    return _rounded(reports.reward_correlation(s, "user_id", "step", "value", "judge"), "user_id")


@query(
    "drift_alarm_50",
    f"""WITH {E}, d AS (SELECT user_id, event_id, step, value - lag(value) OVER (PARTITION BY user_id ORDER BY step) AS a, event_id % 17 - lag(event_id % 17) OVER (PARTITION BY user_id ORDER BY step) AS b FROM e),
w AS (SELECT event_id, stddev_pop(a) OVER w AS x, stddev_pop(b) OVER w AS y, count(a) OVER w AS n, covar_pop(a, b) OVER w AS c FROM d WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN x <= 1e-6 OR y <= 1e-6 OR n < 20 THEN NULL ELSE round(c / (x * y), 5) END AS corr FROM w""",
)
def drift_alarm_50(spark, sf_dir):
    from ledgerloom.operators import episodes

    s = steps(spark, sf_dir).withColumn("judge", (F.col("event_id") % 17).cast("double"))
    return episodes.rolling_correlation(s, "user_id", "step", "value", "judge", 50, 20).select("event_id", rounded(F.col("corr"), 5).alias("corr"))


@query(
    "experiment_summary",
    f"WITH {E}, {_LAST.format(n=10)}, t AS (SELECT user_id, avg(value) AS final_avg_reward FROM l GROUP BY user_id) SELECT e.user_id, round(avg(value), 6) AS avg_reward, max(value) AS max_reward, arg_max(value, step) AS final_reward, max(event_id % 100) / 100 AS best_f1, arg_max(event_id % 100, step) / 100 AS final_f1, round(any_value(final_avg_reward), 6) AS final_avg_reward FROM e JOIN t USING (user_id) GROUP BY e.user_id",
)
def experiment_summary(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("f1", F.col("event_id") % 100 / 100)
    return _rounded(reports.experiment_summary(s, "user_id", "step", "value", "f1", 10), "user_id", "max_reward", "final_reward")


@query("judge_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(event_id % 977, 0.99), 6) AS p99 FROM events GROUP BY ROLLUP (event_type)")
def judge_metrics(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", "value", (F.col("event_id") % 977).cast("double").alias("latency"))
    return _rounded(reports.judge_metrics(e, "event_type", "value", "latency"), "event_type", "n", "min", "max")


@query("replay_fraud_stats", "WITH f AS (SELECT user_id, count(*) FILTER (value >= 99) AS n FROM events GROUP BY user_id) SELECT count(*) AS episodes, count(*) FILTER (n > 0) AS fraud_episodes, round(count(*) FILTER (n > 0) / count(*), 6) AS fraud_ratio, round(avg(n), 6) AS avg_fraud, max(n) AS max_fraud FROM f")
def replay_fraud_stats(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", (F.col("value") >= 99).alias("fraud"))
    return _rounded(reports.replay_stats(e, "user_id", "fraud"), "episodes", "fraud_episodes", "max_fraud")


@query(
    "param_importance",
    "WITH t AS (SELECT c_acctbal AS metric, c_nationkey AS nation, c_custkey % 7 AS lr, c_mktsegment AS seg FROM customer) SELECT 'lr' AS param, round(abs(corr(lr, metric)), 6) AS importance FROM t UNION ALL SELECT 'nation', round(abs(corr(nation, metric)), 6) FROM t UNION ALL SELECT 'seg', round((SELECT var_samp(m) FROM (SELECT avg(metric) AS m FROM t GROUP BY seg)) / var_samp(metric), 6) FROM t",
)
def param_importance(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("metric"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_custkey") % 7).cast("double").alias("lr"), F.col("c_mktsegment").alias("seg"))
    return _rounded(reports.param_importance(c, "metric", ["lr", "nation"], ["seg"]), "param")


@query("message_bus_stats", "SELECT count(*) AS messages, count(DISTINCT event_type) AS kinds, count(DISTINCT event_id // 10) AS steps, count(*) FILTER (event_type = 'purchase') AS proposals, round(count(*) FILTER (event_type = 'purchase') / count(DISTINCT event_id // 10), 6) AS proposals_per_step FROM events")
def message_bus_stats(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("step"), "event_type")
    return _rounded(reports.message_stats(e, "step", "event_type", "purchase"), "messages", "kinds", "steps", "proposals")


@query("pretokenize_stats", r"WITH w AS (SELECT CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.3) AS BIGINT) AS t FROM documents) SELECT count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens, count(*) FILTER (t > 512) AS truncated FROM w")
def pretokenize_stats(spark, sf_dir):
    return reports.pretokenize_stats(load(spark, sf_dir, "documents"), F.size(T.words(F.col("text"))))


@query("packing_stats", f"WITH RECURSIVE {_PACK}, p AS (SELECT shard, pack, count(*) AS docs, least(sum(n), 512) AS used FROM f GROUP BY 1, 2) SELECT count(*) AS packs, round(avg(docs), 6) AS docs_per_pack, round(avg(used), 6) AS tokens_per_pack, round(sum(used) / (count(*) * 512), 6) AS efficiency FROM p")
def packing_stats(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).alias("shard"), "doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    packs = corpus.pack_documents(docs, "shard", "doc_id", "tokens").join(docs, ["shard", "doc_id"])
    return _rounded(reports.packing_stats(packs, ["shard", "pack"], "tokens", 512), "packs")


@query("judge_update_schedule", "SELECT event_id AS episode FROM events WHERE event_id BETWEEN 200 AND 4999 AND event_id % 300 >= 50 AND (event_id - 200) % 100 = 0")
def judge_update_schedule(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("episode"), (F.col("event_id") % 300).alias("buffered"))
    return reports.judge_updates(e, "episode", "buffered").select("episode")


@query("action_histogram", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM c GROUP BY user_id")
def action_histogram(spark, sf_dir):
    h = reports.histogram(load(spark, sf_dir, "events"), "user_id", "event_type")
    return h.select("user_id", F.array_join(F.transform(F.map_entries("histogram"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("histogram"))


@query("lru_cache")
def lru_cache(spark, sf_dir):
    """A cache of 20 items for each of 64 shards of users, requested in order."""
    e = load(spark, sf_dir, "events").select(F.pmod(F.xxhash64("user_id"), F.lit(64)).alias("shard"), "event_id", F.concat("user_id", F.lit(":"), "event_type").alias("item"))
    return reports.lru_stats(e, "shard", "event_id", "item", 20)


@query("top_trials", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_trials(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query("random_sample_seeded", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def random_sample_seeded(spark, sf_dir):
    return sampling.random_sample(load(spark, sf_dir, "documents").select("doc_id").withColumn("h", sampling.hash_order("doc_id")), "h", 50, "doc_id").select("doc_id")


@query("balanced_binary", "WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('7:' || doc_id)) AS r FROM labels), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) SELECT doc_id, toxic FROM r, m WHERE r <= least(m, 15)")
def balanced_binary(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").select("doc_id", "toxic").withColumn("h", sampling.hash_order("doc_id"))
    return sampling.balanced_binary(rows, "toxic", "h", 15).select("doc_id", "toxic")


@query("update_priorities", "SELECT event_id, round(abs(value - 50) + 1e-6, 6) AS priority FROM events")
def update_priorities(spark, sf_dir):
    """The size of the error, and a little, so that no priority is 0."""
    return load(spark, sf_dir, "events").select("event_id", rounded(F.abs(F.col("value") - 50) + 1e-6).alias("priority"))


@query(
    "start_node_sampling",
    f"""WITH {G}, n AS (SELECT src AS id, max(fraud) AS f FROM (SELECT src, fraud FROM edges UNION ALL SELECT dst, fraud FROM edges) GROUP BY src), k AS (SELECT id, f, row_number() OVER (PARTITION BY f ORDER BY id) - 1 AS pos FROM n), c AS (SELECT count(*) FILTER (f = 1) AS a, count(*) FILTER (f = 0) AS b FROM n),
u AS (SELECT c_custkey AS episode, CAST(('0x' || substr(md5('s:' || c_custkey), 1, 8)) AS BIGINT) / 4294967296 AS u, CAST(('0x' || substr(md5('n:' || c_custkey), 1, 8)) AS BIGINT) / 4294967296 AS v FROM customer),
d AS (SELECT episode, CASE WHEN u < 0.5 AND a > 0 THEN 1 ELSE 0 END AS f, CAST(floor(v * CASE WHEN u < 0.5 AND a > 0 THEN a ELSE b END) AS BIGINT) AS pos FROM u, c) SELECT episode, id FROM d JOIN k USING (f, pos)""",
)
def start_node_sampling(spark, sf_dir):
    e = graph.cut(edges(spark, sf_dir))
    fraud = graph.fraud_nodes(e)
    episodes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode"))
    return sampling.start_nodes(episodes, fraud, graph.nodes(e).join(fraud, "id", "left_anti"), sampling.uniform("episode", seed="s"), sampling.uniform("episode", seed="n"))


@query(
    "prioritized_batch",
    """WITH p AS (SELECT event_id, pow(value + 0.5, 0.6) AS w, event_type = 'purchase' AS pos, (CAST(('0x' || substr(md5('u:' || event_id), 1, 8)) AS BIGINT) + 1) / 4294967297 AS u FROM events), k AS (SELECT *, -ln(u) / w AS key FROM p), t AS (SELECT sum(w) AS s, count(*) AS n, least(16, count(*) FILTER (pos)) AS q FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY key, event_id) AS r FROM k), a AS (SELECT event_id, w, key FROM r, t WHERE pos AND r <= q), b AS (SELECT event_id, w, key FROM r, t WHERE NOT (pos AND r <= q) ORDER BY key, event_id LIMIT (64 - (SELECT count(*) FROM a))), c AS (SELECT * FROM a UNION ALL SELECT * FROM b), x AS (SELECT event_id, pow(n * w / s, -0.4) AS v FROM c, t)
SELECT event_id, round(v / (SELECT max(v) FROM x), 6) AS weight FROM x""",
)
def prioritized_batch(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") == "purchase").alias("positive"))
    u = (F.conv(F.substring(sampling.hash_order("event_id", seed="u"), 1, 8), 16, 10).cast("double") + 1) / float((1 << 32) + 1)
    return sampling.prioritized_batch(e, F.col("value") + 0.5, F.col("positive"), u, 64, "event_id").select("event_id", rounded(F.col("weight")).alias("weight"))


_SCHEMES = f"{G}, t AS (SELECT dst AS scheme, src AS node FROM edges WHERE fraud = 1 UNION SELECT dst, dst FROM edges WHERE fraud = 1), d AS (SELECT src AS found, dst AS node FROM edges WHERE step % 3 = 0 UNION SELECT src, src FROM edges WHERE step % 3 = 0), z AS (SELECT scheme, count(*) AS size FROM t GROUP BY scheme), o AS (SELECT scheme, max(n) AS n FROM (SELECT scheme, found, count(*) AS n FROM t JOIN d USING (node) GROUP BY 1, 2) GROUP BY scheme), ov AS (SELECT scheme, size, coalesce(n, 0) / size AS overlap FROM z LEFT JOIN o USING (scheme))"


def _schemes(spark, sf_dir):
    e = graph.cut(edges(spark, sf_dir))
    fraud, seen = e.where("fraud = 1"), e.where("step % 3 = 0")
    truth = fraud.select(F.col("dst").alias("scheme"), F.col("src").alias("node")).union(fraud.select("dst", "dst")).distinct()
    return truth, seen.select(F.col("src").alias("found"), F.col("dst").alias("node")).union(seen.select("src", "src")).distinct()


@query("scheme_overlap", f"WITH {_SCHEMES} SELECT scheme, size, round(overlap, 6) AS overlap FROM ov")
def scheme_overlap(spark, sf_dir):
    """A payee of fraud and all who pay it are a scheme; an account and some of its payees are what was found."""
    return _rounded(reports.scheme_overlap(*_schemes(spark, sf_dir)), "scheme", "size")


@query(
    "scheme_detection",
    f"WITH {_SCHEMES} SELECT round(avg(CASE WHEN overlap >= 0.8 THEN 1.0 ELSE 0 END), 6) AS detection_rate, round(avg(CASE WHEN overlap >= 0.3 AND overlap < 0.8 THEN 1.0 ELSE 0 END), 6) AS partial_rate, round((SELECT count(DISTINCT node) FROM t WHERE node IN (SELECT node FROM d)) / (SELECT count(DISTINCT node) FROM t), 6) AS coverage, round((SELECT avg(n) FROM (SELECT count(*) AS n FROM d GROUP BY found)), 6) AS avg_size, (SELECT count(DISTINCT node) FROM d) AS explored FROM ov",
)
def scheme_detection(spark, sf_dir):
    return _rounded(reports.scheme_detection(*_schemes(spark, sf_dir)), "explored")


@query("proposal_outcomes", f"WITH {G}, f AS (SELECT dst AS node FROM edges WHERE fraud = 1 UNION SELECT src FROM edges WHERE fraud = 1), p AS (SELECT 'A' || step % 5 AS sender, dst AS node, (step % 10) / 10 AS score, step % 4 = 0 AS accepted FROM edges), j AS (SELECT p.*, f.node IS NOT NULL AS fraud FROM p LEFT JOIN f ON p.node = f.node) SELECT sender, count(*) AS n, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted AND fraud) AS \"right\", round(avg(CASE WHEN (score >= 0.5) = accepted THEN 1.0 ELSE 0 END), 6) AS agreement, round(CASE WHEN count(*) FILTER (accepted) = 0 THEN 0 ELSE count(*) FILTER (accepted AND fraud) / count(*) FILTER (accepted) END, 6) AS precision FROM j GROUP BY sender")
def proposal_outcomes(spark, sf_dir):
    e = graph.cut(edges(spark, sf_dir))
    p = e.select(F.concat(F.lit("A"), F.col("step") % 5).alias("sender"), F.col("dst").alias("node"), (F.col("step") % 10 / 10).alias("score"), (F.col("step") % 4 == 0).alias("accepted"))
    return _rounded(reports.proposal_outcomes(p, graph.fraud_nodes(e).withColumnRenamed("id", "node")), "sender", "n", "accepted", "right")


@query(
    "proposal_encoding",
    f"""WITH {G}, p AS (SELECT src AS id, dst, (step % 10) / 10 AS score, step % 3 = 0 AS is_edge, step % 4 = 0 AS hp, step % 30 AS nb, row_number() OVER (PARTITION BY src ORDER BY (step % 10) / 10 DESC, dst) AS r FROM edges),
v AS (SELECT id, list_concat(flatten(list([score, CAST(is_edge AS DOUBLE), CASE WHEN is_edge THEN CAST(score > 0.7 AS DOUBLE) ELSE CAST(hp AS DOUBLE) END, CASE WHEN is_edge THEN 0.5 ELSE least(nb / 20, 1) END] ORDER BY r)), list_transform(range(20), lambda i: 0::DOUBLE))[1:20] AS v FROM p WHERE r <= 5 GROUP BY id)
SELECT id, array_to_string(list_transform(v, lambda x: CAST(round(x * 1000) AS BIGINT)), ',') AS v FROM v""",
)
def proposal_encoding(spark, sf_dir):
    """Each payer's five highest proposals as numbers of a fixed width."""
    e = edges(spark, sf_dir)
    p = e.select(F.col("src").alias("id"), (F.col("step") % 10 / 10).alias("score"), (F.col("step") % 3 == 0).alias("is_edge"), (F.col("step") % 4 == 0).alias("is_high_priority"), (F.col("step") % 30).alias("neighbours"), F.col("dst").alias("place"))
    return reports.proposal_encoding(p, "id", most=5).select("id", F.array_join(F.transform("v", lambda x: F.round(x * 1000).cast("long")), ",").alias("v"))


@query(
    "comparison_table",
    f"""WITH {SCORED_SQL}, m AS (SELECT model, t, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp, count(*) FILTER (label = 1 AND score < t) AS fn FROM s, (VALUES ('low', 0.3), ('high', 0.7)) AS v(model, t) GROUP BY 1, 2),
r AS (SELECT model, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM m) SELECT model, 'precision' AS metric, round(p, 6) AS value FROM r UNION ALL SELECT model, 'recall', round(r, 6) FROM r""",
)
def comparison_table(spark, sf_dir):
    s = scored(spark, sf_dir)
    return _rounded(reports.comparison_table({n: metrics.rates(metrics.confusion(s, t)).select("precision", "recall") for n, t in (("low", 0.3), ("high", 0.7))}), "model", "metric")


@query("corpus_estimates", "SELECT CAST(floor(sum(length(text)) / 4) AS BIGINT) AS tokens, CAST(floor(sum(length(text)) / 4) * 4 AS BIGINT) AS id_bytes, round(floor(sum(length(text)) / 4) / 1e5 / 3600, 6) AS hours FROM documents")
def corpus_estimates(spark, sf_dir):
    total = load(spark, sf_dir, "documents").agg(F.sum(F.length("text")).alias("n"))
    return _rounded(total.select(*[c.alias(k) for k, c in reports.corpus_estimates(F.col("n")).items()]), "tokens", "id_bytes")


_PROBS = "q AS (SELECT id, label + quality AS truth, [(1 - score) * 0.7, (1 - score) * 0.3, score] AS probs FROM s)"


def _probs(spark, sf_dir):
    s = F.col("score")
    return scored(spark, sf_dir).select("id", (F.col("label") + F.col("quality")).alias("truth"), F.array((1 - s) * 0.7, (1 - s) * 0.3, s).alias("probs"))


@query(
    "classwise_calibration",
    f"WITH {SCORED_SQL}, {_PROBS}, x AS (SELECT c AS class, probs[CAST(c + 1 AS INTEGER)] AS p, CAST(truth = c AS INTEGER) AS y FROM q, range(3) AS r(c)), b AS (SELECT class, least(floor(p * 15), 14) AS b, count(*) AS n, sum(p) AS s, sum(y) AS y, sum(pow(p - y, 2)) AS q FROM x GROUP BY 1, 2) SELECT CAST(class AS INTEGER) AS class, round(sum(abs(y - s)) / sum(n), 5) AS ece, round(sum(q) / sum(n), 5) AS brier FROM b GROUP BY class",
)
def classwise_calibration(spark, sf_dir):
    return _rounded(metrics.classwise(_probs(spark, sf_dir)), "class", places=5)


@query(
    "marginal_ece",
    f"WITH {SCORED_SQL}, {_PROBS}, x AS (SELECT c AS class, probs[CAST(c + 1 AS INTEGER)] AS p, CAST(truth = c AS INTEGER) AS y FROM q, range(3) AS r(c)), b AS (SELECT class, least(floor(p * 15), 14) AS b, count(*) AS n, sum(p) AS s, sum(y) AS y FROM x GROUP BY 1, 2), e AS (SELECT sum(abs(y - s)) / sum(n) AS ece FROM b GROUP BY class) SELECT round(avg(ece), 5) AS ece FROM e",
)
def marginal_ece(spark, sf_dir):
    return _rounded(metrics.marginal_ece(_probs(spark, sf_dir)), places=5)


@query(
    "top_label_ece",
    f"WITH {SCORED_SQL}, {_PROBS}, x AS (SELECT list_max(probs) AS p, CAST(list_position(probs, list_max(probs)) - 1 = truth AS INTEGER) AS y FROM q), b AS (SELECT least(floor(p * 15), 14) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM x GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 5) AS ece, round(max(abs(a - c)), 5) AS mce FROM b",
)
def top_label_ece(spark, sf_dir):
    return _rounded(metrics.calibration_errors(metrics.top_label(_probs(spark, sf_dir))), places=5)


@query(
    "ece_quantile",
    f"WITH {SCORED_SQL}, g AS (SELECT quantile_cont(score, [{', '.join(f'{k}/15.0' for k in range(16))}]) AS e FROM s), x AS (SELECT score, label, len(list_filter(e[2:15], lambda y: y <= score)) AS b FROM s, g), b AS (SELECT b, count(*) AS n, avg(score) AS c, avg(label) AS a FROM x GROUP BY b) SELECT round(sum(n * abs(a - c)) / sum(n), 5) AS ece, round(max(abs(a - c)), 5) AS mce FROM b",
)
def ece_quantile(spark, sf_dir):
    return _rounded(metrics.quantile_calibration(scored(spark, sf_dir)), places=5)


@query(
    "isotonic_calibration",
    f"""WITH {SCORED_SQL}, c AS (SELECT score, count(*) AS w, sum(label) AS s FROM s GROUP BY score), k AS (SELECT score, w, s, row_number() OVER o AS i, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM c WINDOW o AS (ORDER BY score)),
m AS (SELECT a.i AS a, b.i AS b, b.score, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM k a JOIN k b ON a.i <= b.i), f AS (SELECT score, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m) SELECT score, round(max(low), 6) AS calibrated FROM f GROUP BY score""",
)
def isotonic_calibration(spark, sf_dir):
    return _rounded(isotonic.isotonic(scored(spark, sf_dir)), "score")


@query(
    "subgraph_split_ratio",
    "WITH c AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings), n AS (SELECT count(*) FILTER (s >= 0.1) AS h, count(*) FILTER (s < -0.1) AS l, count(*) AS n FROM c) SELECT h, n - h - l AS m, l, round(pow(h / n - 0.35, 2) + pow(l / n - 0.25, 2), 6) AS loss FROM n",
)
def subgraph_split_ratio(spark, sf_dir):
    """How far the shares of similar and dissimilar vectors are from what is aimed at."""
    from ledgerloom.operators import episodes

    v = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    first = v.where("vec_id = 0").select(F.col("x").alias("y"))  # one row
    s = v.join(F.broadcast(first)).select(episodes.cosine(F.col("x"), F.col("y")).alias("s"))
    h, low, n = F.sum((F.col("s") >= 0.1).cast("long")), F.sum((F.col("s") < -0.1).cast("long")), F.count("*")
    c = s.agg(h.alias("h"), low.alias("l"), n.alias("n"))
    loss = F.pow(F.col("h") / F.col("n") - 0.35, 2) + F.pow(F.col("l") / F.col("n") - 0.25, 2)
    return c.select("h", (F.col("n") - F.col("h") - F.col("l")).alias("m"), "l", rounded(loss).alias("loss"))

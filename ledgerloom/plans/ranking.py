"""Metric queries on labelled documents: label = toxic, score = a fixed function of the length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import metrics
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load, rounded

SCORED_SQL = "s AS (SELECT doc_id AS id, toxic AS label, quality, source, ((n_chars * 37) % 1000) / 1000.0::DOUBLE AS score, lang FROM documents JOIN labels USING (doc_id))"
CUM_SQL = """c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
k AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM c)"""
TOTAL = "(SELECT sum(label) FROM s)"


def scored(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang").join(load(spark, sf_dir, "labels"), "doc_id")
    return docs.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), "quality", "source", ((F.col("n_chars") * 37) % 1000 / 1000.0).alias("score"), "lang")


def _rounded(df, *keep: str, places: int = 6):
    return df.select(*keep, *[rounded(F.col(c), places).alias(c) for c in df.columns if c not in keep])


def _prf(tp: str, predicted: str, actual: str) -> str:
    return f"""round(CASE WHEN {predicted} = 0 THEN 0 ELSE {tp} / {predicted} END, 6) AS precision, round(CASE WHEN {actual} = 0 THEN 0 ELSE {tp} / {actual} END, 6) AS recall,
  round(CASE WHEN {tp} = 0 THEN 0 ELSE 2 * ({tp} / {predicted}) * ({tp} / {actual}) / ({tp} / {predicted} + {tp} / {actual}) END, 6) AS f1"""


_CONFUSION = """m AS (SELECT CAST(count(*) FILTER (label = 0 AND score < 0.5) AS BIGINT) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM s)"""


@query("confusion_matrix", f"WITH {SCORED_SQL}, {_CONFUSION} SELECT * FROM m")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), 0.5)


@query("prf", f"WITH {SCORED_SQL}, {_CONFUSION} SELECT {_prf('tp', '(tp + fp)', '(tp + fn)')}, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM m")
def prf(spark, sf_dir):
    return _rounded(metrics.rates(metrics.confusion(scored(spark, sf_dir), 0.5)).select("precision", "recall", "f1", "accuracy"))


_CLASS_SQL = f"""WITH {SCORED_SQL}, p AS (SELECT lang AS t, CASE WHEN score < 0.5 THEN lang ELSE 'en' END AS g FROM s), x AS (SELECT t AS class FROM p UNION SELECT g FROM p),
r AS (SELECT class, count(*) FILTER (t = class AND g = class) AS tp, count(*) FILTER (t = class) AS sup, count(*) FILTER (g = class) AS pred FROM x, p GROUP BY class)"""


def _classes(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.col("lang").alias("t"), F.when(F.col("score") < 0.5, F.col("lang")).otherwise("en").alias("g"))
    return metrics.per_class(rows, "t", "g")


@query("per_class_prf", f"{_CLASS_SQL} SELECT class, {_prf('tp', 'pred', 'sup')}, sup AS support FROM r")
def per_class_prf(spark, sf_dir):
    return _rounded(_classes(spark, sf_dir), "class", "support")


@query(
    "typology_metrics",
    f"""{_CLASS_SQL}, f AS (SELECT *, CASE WHEN pred = 0 THEN 0 ELSE tp / pred END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS q FROM r), h AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS f1 FROM f)
SELECT round(avg(p), 6) AS macro_precision, round(avg(q), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1, round(sum(tp) / sum(sup), 6) AS micro_f1, CAST(sum(sup) AS BIGINT) AS support FROM h""",
)
def typology_metrics(spark, sf_dir):
    c = _classes(spark, sf_dir)
    out = c.agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("micro_f1"),
        F.sum("support").alias("support"),
    )
    return _rounded(out, "support")


@query("roc_auc", f"WITH {SCORED_SQL}, {CUM_SQL} SELECT round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM k")
def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(scored(spark, sf_dir)))


@query("average_precision", f"WITH {SCORED_SQL}, {CUM_SQL} SELECT round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS average_precision FROM k")
def average_precision(spark, sf_dir):
    return _rounded(metrics.average_precision(scored(spark, sf_dir)))


@query(
    "pr_auc_trapezoid",
    f"WITH {SCORED_SQL}, {CUM_SQL}, t AS (SELECT *, cp / (cp + cn) AS p, lag(cp / (cp + cn), 1, 1.0) OVER (ORDER BY score DESC) AS q FROM k) SELECT round(sum(pos * (p + q) / 2) / sum(pos), 6) AS pr_auc FROM t",
)
def pr_auc_trapezoid(spark, sf_dir):
    return _rounded(metrics.pr_auc_trapezoid(scored(spark, sf_dir)))


@query("top_k_alerts", f"WITH {SCORED_SQL} SELECT id, label, score FROM s ORDER BY score DESC, id LIMIT 50")
def top_k_alerts(spark, sf_dir):
    return metrics.top_k(scored(spark, sf_dir).select("id", "label", "score"), 50)


_BUDGET_SQL = f"""WITH {SCORED_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM s), b AS (SELECT k, CAST(coalesce(sum(label), 0) AS BIGINT) AS tp, least(k, (SELECT count(*) FROM s)) AS n FROM (SELECT unnest([50, 100, 200, 500]) AS k), t WHERE r <= k GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, tp, {_prf("tp", "n", TOTAL)} FROM b"""


@query("prf_at_k", _BUDGET_SQL)
def prf_at_k(spark, sf_dir):
    return _rounded(metrics.at_k(scored(spark, sf_dir), [50, 100, 200, 500]), "k", "tp")


@query("recall_curve", f"WITH {SCORED_SQL}, t AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS k, label FROM s) SELECT k, CAST(sum(label) OVER (ORDER BY k) AS BIGINT) AS tp, round(sum(label) OVER (ORDER BY k) / {TOTAL}, 6) AS recall FROM t WHERE k <= 200")
def recall_curve(spark, sf_dir):
    return _rounded(metrics.recall_curve(scored(spark, sf_dir), 200), "k", "tp")


@query(
    "budget_report",
    f"WITH {SCORED_SQL}, {CUM_SQL} SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS prevalence, (SELECT round(sum(pos * cp / (cp + cn)) / sum(pos), 6) FROM k) AS average_precision FROM s",
)
def budget_report(spark, sf_dir):
    s = scored(spark, sf_dir)
    totals = s.agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("prevalence"))
    return _rounded(totals.join(F.broadcast(metrics.average_precision(s))), "n", "positives")


@query(
    "ndcg_at_k",
    f"""WITH {SCORED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS r, row_number() OVER (PARTITION BY source ORDER BY label DESC, id) AS i FROM s),
g AS (SELECT source, sum(CASE WHEN r <= 10 THEN (pow(2, label) - 1) / log2(r + 1) ELSE 0 END) AS d, sum(CASE WHEN i <= 10 THEN (pow(2, label) - 1) / log2(i + 1) ELSE 0 END) AS b FROM t GROUP BY source)
SELECT source, round(CASE WHEN b = 0 THEN 0 ELSE d / b END, 6) AS ndcg FROM g""",
)
def ndcg_at_k(spark, sf_dir):
    return _rounded(metrics.ndcg_at_k(scored(spark, sf_dir), "source", 10), "source")


@query("mrr", f"WITH {SCORED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS r FROM s) SELECT source, round(coalesce(1 / min(r) FILTER (label = 1), 0), 6) AS rr FROM t GROUP BY source")
def mrr(spark, sf_dir):
    return _rounded(metrics.mrr(scored(spark, sf_dir), "source"), "source")


@query(
    "map",
    f"""WITH {SCORED_SQL}, t AS (SELECT *, row_number() OVER w AS r, sum(label) OVER w AS h FROM s WINDOW w AS (PARTITION BY source ORDER BY score DESC, id))
SELECT source, round(CASE WHEN sum(label) = 0 THEN 0 ELSE sum(label * h / r) / sum(label) END, 6) AS ap FROM t GROUP BY source""",
)
def mean_average_precision(spark, sf_dir):
    return _rounded(metrics.mean_average_precision(scored(spark, sf_dir), "source"), "source")


@query(
    "threshold_curve",
    f"""WITH {SCORED_SQL}, g AS (SELECT i AS bucket, i / 99 AS threshold FROM range(100) AS r(i)), h AS (SELECT bucket, threshold, CAST(coalesce(sum(label), 0) AS BIGINT) AS tp, CAST(coalesce(sum(1 - label), 0) AS BIGINT) AS fp FROM g LEFT JOIN s ON score >= threshold GROUP BY 1, 2)
SELECT bucket, round(threshold, 6) AS threshold, tp, fp, {_prf('tp', '(tp + fp)', TOTAL)} FROM h""",
)
def threshold_curve(spark, sf_dir):
    return _rounded(metrics.threshold_curve(scored(spark, sf_dir)), "bucket", "tp", "fp")


@query(
    "optimal_threshold",
    f"WITH {SCORED_SQL}, {CUM_SQL}, f AS (SELECT score, cp / (cp + cn) AS p, cp / (SELECT sum(pos) FROM c) AS r FROM k), h AS (SELECT score, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 12) AS f1 FROM f) SELECT score AS threshold, round(f1, 6) AS value FROM h ORDER BY f1 DESC, score LIMIT 1",
)
def optimal_threshold(spark, sf_dir):
    return _rounded(metrics.optimal_threshold(scored(spark, sf_dir)))


_BINS_SQL = "b AS (SELECT CAST(least(floor(score * 15), 14) AS INTEGER) AS bin, count(*) AS n, avg(score) AS confidence, avg(label) AS accuracy FROM s GROUP BY 1)"


@query("calibration_curve", f"WITH {SCORED_SQL}, {_BINS_SQL} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def calibration_curve(spark, sf_dir):
    return _rounded(metrics.calibration_bins(scored(spark, sf_dir)), "bin", "n")


@query("ece_mce", f"WITH {SCORED_SQL}, {_BINS_SQL} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, round(max(abs(accuracy - confidence)), 6) AS mce FROM b")
def ece_mce(spark, sf_dir):
    return _rounded(metrics.calibration_errors(scored(spark, sf_dir)))


@query(
    "brier_decomposition",
    f"""WITH {SCORED_SQL}, {_BINS_SQL}, w AS (SELECT avg(pow(score - label, 2)) AS brier, avg(label) AS base FROM s)
SELECT round(any_value(brier), 6) AS brier, round(sum(n * pow(confidence - accuracy, 2)) / sum(n), 6) AS reliability, round(sum(n * pow(accuracy - base, 2)) / sum(n), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM b, w""",
)
def brier_decomposition(spark, sf_dir):
    return _rounded(metrics.brier(scored(spark, sf_dir)))


@query(
    "confidence_errors",
    f"""WITH {SCORED_SQL}, t AS (SELECT greatest(score, 1 - score) AS conf, CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END AS ok FROM s)
SELECT round(greatest(0, coalesce(avg(conf) FILTER (conf >= 0.7), 0) - coalesce(avg(ok) FILTER (conf >= 0.7), 0)), 6) AS overconfidence, round(greatest(0, coalesce(avg(ok) FILTER (conf < 0.7), 0) - coalesce(avg(conf) FILTER (conf < 0.7), 0)), 6) AS underconfidence FROM t""",
)
def confidence_errors(spark, sf_dir):
    return _rounded(metrics.confidence_errors(scored(spark, sf_dir)))


@query(
    "temperature_grid",
    f"""WITH {SCORED_SQL}, l AS (SELECT label, 8 * score - 4 AS z FROM s), g AS (SELECT 0.1 + i * 0.1 AS t FROM range(50) AS r(i))
SELECT round(t::DOUBLE, 6) AS temperature, round(avg(ln(1 + exp(-abs(z / t::DOUBLE))) + greatest(z / t::DOUBLE, 0) - z / t::DOUBLE * label), 6) AS nll FROM l, g GROUP BY t""",
)
def temperature_grid(spark, sf_dir):
    logits = scored(spark, sf_dir).select("label", (8 * F.col("score") - 4).alias("logit"))
    return _rounded(metrics.temperature_grid(logits, [round(0.1 + 0.1 * i, 1) for i in range(50)]))


def _zoomed(nll: str, rows: str, passes: int = 5, points: int = 21, low: float = 0.05, high: float = 10.0) -> str:
    """Common table expressions of a minimum that is narrowed pass by pass, as best_temperature does; the last is named best."""
    out = f"b0 AS (SELECT {low}::DOUBLE AS low, {high}::DOUBLE AS high)"
    for k in range(1, passes + 1):
        out += f""", g{k} AS (SELECT low + i * ((high - low) / {points - 1}) AS t, i, low, high FROM b{k - 1}, range({points}) AS r(i)), n{k} AS (SELECT t, i, any_value(low) AS low, any_value(high) AS high, avg({nll}) AS nll FROM {rows}, g{k} GROUP BY t, i),
m{k} AS (SELECT arg_min(t, nll) AS t, min(nll) AS nll, arg_min(i, nll) AS i FROM n{k}), b{k} AS (SELECT (SELECT max(t) FROM n{k} WHERE n{k}.i = greatest(m{k}.i - 1, 0)) AS low, (SELECT max(t) FROM n{k} WHERE n{k}.i = least(m{k}.i + 1, {points - 1})) AS high FROM m{k})"""
    return out + f", best AS (SELECT t AS temperature, nll FROM m{passes})"


@query(
    "best_temperature",
    f"WITH {SCORED_SQL}, l AS (SELECT label, 8 * score - 4 AS z FROM s), {_zoomed('ln(1 + exp(-abs(z / t))) + greatest(z / t, 0) - z / t * label', 'l')} SELECT round(temperature, 3) AS temperature, round(nll, 6) AS nll FROM best",
)
def best_temperature(spark, sf_dir):
    """Of scores as logits; the minimum is found in five passes."""
    logits = scored(spark, sf_dir).select("label", (8 * F.col("score") - 4).alias("logit"))
    return metrics.best_temperature(logits).select(rounded(F.col("temperature"), 3).alias("temperature"), rounded(F.col("nll")).alias("nll"))


@query(
    "multilabel_metrics",
    """WITH t AS (SELECT quality AS q, toxic AS x, CAST((doc_id * 7) % 10 < 8 AS INTEGER) AS pq, CAST((doc_id * 3) % 10 < 1 AS INTEGER) AS px FROM labels),
l AS (SELECT 'quality' AS name, q AS t, pq AS p FROM t UNION ALL SELECT 'toxic', x, px FROM t),
f AS (SELECT name, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn FROM l GROUP BY name),
a AS (SELECT avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS macro, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro FROM f)
SELECT (SELECT round(avg(CASE WHEN t <> p THEN 1.0 ELSE 0.0 END), 6) FROM l) AS hamming, (SELECT round(avg(CASE WHEN q = pq AND x = px THEN 1.0 ELSE 0.0 END), 6) FROM t) AS subset_accuracy, round(macro, 6) AS macro_f1, round(micro, 6) AS micro_f1 FROM a""",
)
def multilabel_metrics(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").select(
        F.array("quality", "toxic").alias("t"), F.array(((F.col("doc_id") * 7) % 10 < 8).cast("int"), ((F.col("doc_id") * 3) % 10 < 1).cast("int")).alias("p")
    )
    each = rows.select(F.inline(F.arrays_zip(F.array(F.lit("quality"), F.lit("toxic")).alias("name"), "t", "p")))
    hit = lambda t, p: F.sum(((F.col("t") == t) & (F.col("p") == p)).cast("long"))
    by = each.groupBy("name").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    f1 = lambda tp, fp, fn: metrics.ratio(2 * tp, 2 * tp + fp + fn)
    scores = by.agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"))
    whole = rows.agg(F.avg((F.col("t") == F.col("p")).cast("double")).alias("subset_accuracy"))
    hamming = each.agg(F.avg((F.col("t") != F.col("p")).cast("double")).alias("hamming"))
    return _rounded(hamming.join(F.broadcast(whole)).join(F.broadcast(scores)))


@query("pairwise_accuracy", f"WITH {SCORED_SQL} SELECT round(avg(CASE WHEN (score - 0.5) * (2 * label - 1) > 0 THEN 1.0 ELSE 0.0 END), 6) AS pairwise_accuracy FROM s")
def pairwise_accuracy(spark, sf_dir):
    return _rounded(scored(spark, sf_dir).agg(F.avg(((F.col("score") - 0.5) * (2 * F.col("label") - 1) > 0).cast("double")).alias("pairwise_accuracy")))


@query("runtime_percentiles", "SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.9), 5) AS p90, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99 FROM events GROUP BY event_type")
def runtime_percentiles(spark, sf_dir):
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), *[F.percentile("value", p).alias(n) for n, p in at.items()])
    return _rounded(out, "event_type", "n", places=5)

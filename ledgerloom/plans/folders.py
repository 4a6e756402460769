"""Queries of folders and exports: files of the layouts that loaders read, written from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import episodes, experiments, reports
from ledgerloom.plans.episodes import E, _r, steps
from ledgerloom.plans.ranking import CUM_SQL, SCORED_SQL, _rounded, scored
from ledgerloom.plans.registry import query
from ledgerloom.plans.sources_sinks import _folder
from ledgerloom.plans.texts import _CHUNK, S, samples
from ledgerloom.sources import folders, writers
from ledgerloom.sources.tables import load, rounded

_PIECE = "CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(w[i * 448 + 1:i * 448 + 512], ' ') END"


@query("load_narrative_folder", r"SELECT md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS h, 'sar_narrative' AS category, 'suspicious' AS label, count(*) AS n FROM benchmark WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100 GROUP BY 1")
def load_narrative_folder(spark, sf_dir):
    """A file for each benchmark text."""
    at = _folder(spark, "narratives")
    load(spark, sf_dir, "benchmark").select("text").where("text IS NOT NULL").write.option("maxRecordsPerFile", 1).text(at)
    return folders.narrative_folder(spark, at, 100).groupBy(F.md5("text").alias("h"), "category", "label").agg(F.count("*").alias("n"))


@query("load_json_folder", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS h, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS place FROM documents WHERE length(text) >= 50")
def load_json_folder(spark, sf_dir):
    """Documents as records of JSON exports of all layouts, among records that are too short and, in a list, something that is no record."""
    d = load(spark, sf_dir, "documents")
    form = lambda name: F.struct(F.col("doc_id").alias("id"), F.lit("").alias("narrative" if name != "narrative" else "text"), F.col("text").alias(name))
    short = lambda name: F.struct(F.lit(-1).cast("long").alias("id"), F.lit("").alias("narrative" if name != "narrative" else "text"), F.col("lang").alias(name))
    both = lambda name: F.array(short(name), form(name))
    listed = F.concat(F.lit('["no record", '), F.to_json(short("text")), F.lit(", "), F.to_json(form("text")), F.lit("]"))
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.to_json(F.struct(both("narrative").alias("records")))).when(k == 1, F.to_json(F.struct(both("text").alias("data")))).when(k == 2, F.to_json(form("description"))).otherwise(listed)
    at = _folder(spark, "exports")
    d.select(text.alias("value")).write.text(at)
    return folders.json_folder(spark, at, lines=True).select(F.col("metadata")["id"].alias("id"), F.md5("text").alias("h"), F.element_at(F.split("sample_id", "_"), -1).cast("int").alias("place"))


_GRAPH = "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 < 3 THEN (['1', '2', 'unknown'])[CAST(c_custkey % 3 AS INTEGER) + 1] ELSE 'unknown' END AS class FROM customer"


def _elliptic(spark, sf_dir):
    """Customers as a graph in three CSV files: classes of three quarters of them, an edge to their nation's number and back."""
    c, at = load(spark, sf_dir, "customer"), _folder(spark, "elliptic")
    names = [f"{at}/{f}" for f in folders.ELLIPTIC_FILES]
    c.select("c_custkey", F.col("c_custkey") % 49 + 1, "c_acctbal", "c_nationkey").write.csv(names[0])
    c.where("c_custkey % 4 < 3").select(F.col("c_custkey").alias("txId"), F.get(F.array(*map(F.lit, ("1", "2", "unknown"))), (F.col("c_custkey") % 3).cast("int")).alias("class")).write.csv(names[1], header=True)
    c.select(F.col("c_custkey").alias("txId1"), F.col("c_nationkey").alias("txId2")).write.csv(names[2], header=True)
    return folders.elliptic_folder(spark, at)


@query("load_elliptic", f"SELECT CAST(k AS VARCHAR) AS \"txId\", k % 49 + 1 AS time_step, c_acctbal AS feature_1, CAST(c_nationkey AS DOUBLE) AS feature_2, class, CAST(class = '1' AS INTEGER) AS label_illicit, CAST(class = '2' AS INTEGER) AS label_licit, CAST(class <> 'unknown' AS INTEGER) AS is_labeled FROM ({_GRAPH}) JOIN customer ON k = c_custkey")
def load_elliptic(spark, sf_dir):
    return _elliptic(spark, sf_dir)[0]


@query("load_elliptic_edges", "SELECT CAST(c_custkey AS VARCHAR) AS src, CAST(c_nationkey AS VARCHAR) AS dst FROM customer WHERE c_nationkey IN (SELECT c_custkey FROM customer)")
def load_elliptic_edges(spark, sf_dir):
    """Edges between transactions that exist, without the headers' dangling edges."""
    rows, edges = _elliptic(spark, sf_dir)
    known = lambda end: rows.select(F.col("txId").alias(end))
    return edges.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").select("src", "dst")


@query("mlm_export", rf"WITH {_CHUNK}, p AS (SELECT {_PIECE} AS t FROM x WHERE text IS NOT NULL) SELECT form, h, count(*) AS n FROM (SELECT 'json' AS form, md5(t) AS h FROM p UNION ALL SELECT 'text', md5(regexp_replace(t, '\s*[\r\n]\s*', ' ', 'g')) FROM p) GROUP BY 1, 2")
def mlm_export(spark, sf_dir):
    """Chunks of all documents, as lines and as JSON."""
    docs = load(spark, sf_dir, "documents").select("text")
    lines, objects = _folder(spark, "mlm"), _folder(spark, "mlm")
    writers.to_mlm(docs, lines)
    writers.to_mlm(docs, objects, text_only=False)
    both = spark.read.text(lines).select(F.lit("text").alias("form"), "value").union(spark.read.schema("text string").json(objects).select(F.lit("json"), "text"))
    return both.groupBy("form", F.md5("value").alias("h")).agg(F.count("*").alias("n"))


@query("dataset_export", rf"WITH {S}, w AS (SELECT doc_id, text, label, category, source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM s WHERE text IS NOT NULL), c AS (SELECT *, CAST(CASE WHEN len(w) <= 512 THEN 1 ELSE ceil((len(w) - 512) / 448) + 1 END AS INTEGER) AS k FROM w), x AS (SELECT *, unnest(range(k)) AS i FROM c) SELECT CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, doc_id, CAST(i AS INTEGER) AS chunk_index, k AS total_chunks, md5({_PIECE}) AS h, label, category, source FROM x")
def dataset_export(spark, sf_dir):
    """Samples in training format, in chunks, in three splits."""
    at, k = _folder(spark, "dataset"), F.col("doc_id") % 10
    writers.to_dataset(samples(spark, sf_dir), at, F.when(k == 0, "test").when(k == 1, "validation").otherwise("train"), keep=["doc_id"])
    return spark.read.parquet(at).select("split", "doc_id", "chunk_index", "total_chunks", F.md5("text").alias("h"), "label", "category", "source")


_LOG = f"""{E}, m AS (SELECT user_id, step, value + 1e-7 AS r, CAST(event_id % 50 AS DOUBLE) AS l, CASE WHEN event_type = 'purchase' THEN value / 1000 + 1e-8 END AS d, CASE WHEN event_type = 'click' THEN value / 2000 + 1e-8 END AS p FROM e),
z AS (SELECT user_id, count(*) AS n, avg(r) AS ar, max(r) AS mr, avg(r) FILTER (back <= 100) AS fr, avg(l) AS al, arg_max(d, step) FILTER (d IS NOT NULL) AS fd, max(p) AS bf, arg_max(p, step) FILTER (p IS NOT NULL) AS ff FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS back FROM m) GROUP BY user_id)"""


def _experiment(spark, sf_dir):
    """Each user's events as a run, saved and loaded; 1e-7 keeps rounded values off ties."""
    kind, v = F.col("event_type"), F.col("value")
    columns = {"episode_rewards": v + 1e-7, "episode_lengths": F.col("event_id") % 50, "detection_rates": F.when(kind == "purchase", v / 1000 + 1e-8), "f1_score": F.when(kind == "click", v / 2000 + 1e-8)}
    rows = steps(spark, sf_dir).withColumns(columns)
    at = _folder(spark, "experiment")
    experiments.save(experiments.metric_log(rows, "user_id", "step", list(columns)), at, {"gamma": F.lit(0.99)})
    return experiments.load(spark, at)


@query("experiment_archive", f"WITH {_LOG} SELECT CAST(user_id AS VARCHAR) AS experiment_name, n AS total_episodes, '0.99' AS gamma, round(ar, 4) AS avg_reward, round(mr, 4) AS max_reward, round(fr, 4) AS final_avg_reward, round(al, 4) AS avg_episode_length, round(fd, 4) AS final_detection_rate, round(bf, 5) AS best_f1_score, round(ff, 5) AS final_f1_score, CAST(NULL AS DOUBLE) AS final_recall FROM z")
def experiment_archive(spark, sf_dir):
    meta = _experiment(spark, sf_dir)[1].select("experiment_name", "total_episodes", F.col("config")["gamma"].alias("gamma"), "summary.*").drop("final_precision")
    places = {"best_f1_score": 5, "final_f1_score": 5}
    return meta.select("experiment_name", "total_episodes", "gamma", *[rounded(F.col(c), places.get(c, 4)).alias(c) for c in meta.columns[3:]])


@query("experiment_metrics", f"WITH {_LOG} SELECT user_id AS run, step AS idx, metric, round(value, 5) AS value FROM (SELECT user_id, step, 'episode_rewards' AS metric, r AS value FROM m UNION ALL SELECT user_id, step, 'episode_lengths', l FROM m UNION ALL SELECT user_id, step, 'detection_rates', d FROM m UNION ALL SELECT user_id, step, 'f1_score', p FROM m) WHERE value IS NOT NULL")
def experiment_metrics(spark, sf_dir):
    return _r(_experiment(spark, sf_dir)[0].select("run", "idx", "metric", "value"), "run", "idx", "metric", places=5)


def _report_sql() -> str:
    fields = {"total_episodes": "n", "avg_reward": "ar", "max_reward": "mr", "final_avg_reward": "fr", "final_detection_rate": "fd", "best_f1_score": "bf", "final_f1_score": "ff"}
    lines = [f"'{experiments.RULE}'", "'Experiment Report: ' || user_id", f"'{experiments.RULE}'", "''"]
    for words, field, form in experiments.REPORT:
        value = f"coalesce({fields.get(field, 'NULL::DOUBLE')}, 0){' * 100' if '%%' in form else ''}"
        lines.append(f"'{words}'" + (f" || printf('{form}', {value})" if field else ""))
    return f"WITH {_LOG} SELECT CAST(user_id AS VARCHAR) AS run, md5(concat_ws(chr(10), {', '.join(lines)}, '', '{experiments.RULE}')) AS h FROM z"


@query("experiment_report", _report_sql())
def experiment_report(spark, sf_dir):
    meta = _experiment(spark, sf_dir)[1].select(F.col("experiment_name").alias("run"), "total_episodes", "summary.*")
    return meta.select("run", F.md5(experiments.report(F.col("run"))).alias("h"))


@query(
    "evaluator_results",
    f"""WITH {SCORED_SQL}, {CUM_SQL}, t AS (SELECT *, cp / (cp + cn) AS p, lag(cp / (cp + cn), 1, 1.0) OVER (ORDER BY score DESC) AS q FROM k), m AS (SELECT method, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp, count(*) FILTER (label = 1 AND score < t) AS fn, count(*) FILTER (label = 0 AND score < t) AS tn FROM s, (VALUES ('low', 0.3), ('middle', 0.5), ('never', 2.0)) AS v(method, t) GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, tp / (tp + fn) AS re FROM m)
SELECT method, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1_score, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(re, 6) AS detection_rate, round(fp / (fp + tn), 6) AS false_positive_rate,
round((SELECT sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) FROM k), 6) AS roc_auc, round((SELECT sum(pos * (p + q) / 2) / sum(pos) FROM t), 6) AS pr_auc FROM r""",
)
def evaluator_results(spark, sf_dir):
    """Three methods evaluated, saved as JSON and loaded."""
    s, at = scored(spark, sf_dir), _folder(spark, "evaluations")
    reports.save_evaluations({n: reports.evaluation(s, t) for n, t in (("low", 0.3), ("middle", 0.5), ("never", 2.0))}, at)
    return _rounded(reports.load_evaluations(spark, at), "method", "true_positives", "false_positives", "true_negatives", "false_negatives")


@query(
    "traversal_rates",
    """WITH t AS (SELECT client_id, kind, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM clicks WHERE client_id IS NOT NULL), g AS (SELECT client_id, s, s - lag(s) OVER (PARTITION BY client_id ORDER BY s) AS gap FROM t WHERE s IS NOT NULL),
a AS (SELECT client_id, count(*) AS edges, round(CASE WHEN max(s) > min(s) THEN count(*) / (max(s) - min(s)) END, 8) AS traversal_velocity, round(stddev_pop(gap), 2) AS temporal_diversity FROM g GROUP BY client_id), n AS (SELECT client_id, kind, count(*) AS n FROM t GROUP BY 1, 2), p AS (SELECT client_id, coalesce(string_agg(kind || '=' || n, ',' ORDER BY kind) FILTER (kind IS NOT NULL), '') AS patterns FROM n GROUP BY client_id)
SELECT p.client_id, edges, traversal_velocity, temporal_diversity, patterns FROM p LEFT JOIN a USING (client_id)""",
)
def traversal_rates(spark, sf_dir):
    """Clicks of a client as the edges that an episode walked, in edges a second."""
    clicks = load(spark, sf_dir, "clicks").select("client_id", "kind", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    out = episodes.traversal(clicks, "client_id", "at", "kind")
    patterns = F.array_join(F.transform(F.map_entries("patterns"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("client_id", "edges", rounded(F.col("traversal_velocity"), 8).alias("traversal_velocity"), rounded(F.col("temporal_diversity"), 2).alias("temporal_diversity"), patterns.alias("patterns"))

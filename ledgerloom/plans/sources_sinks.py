"""Round trips through sources and sinks, and streaming queries run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import corpus, monitor
from ledgerloom.operators.graph import cut
from ledgerloom.plans.registry import query
from ledgerloom.sources import bson, readers, writers
from ledgerloom.sources.tables import load, rounded
from ledgerloom.streaming import buffer
from ledgerloom.streaming import dedup as stream


def _folder(spark, name: str) -> str:
    cut(spark.range(1))  # makes sure that a shared folder is known
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS h, lang FROM documents")
def jsonl_round_trip(spark, sf_dir):
    at = _folder(spark, "jsonl")
    writers.to_jsonl(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), at)
    return readers.jsonl(spark, at, "doc_id bigint, text string, lang string").select("doc_id", F.md5("text").alias("h"), "lang")


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    at = _folder(spark, "csv")
    writers.to_csv_report(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), at)
    return readers.csv_with_header(spark, at, "c_custkey bigint, c_name string, c_acctbal double")


@query("split_export", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def split_export(spark, sf_dir):
    at = _folder(spark, "splits")
    writers.to_splits(load(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")), at)
    return spark.read.parquet(at).groupBy("split").agg(F.count("*").alias("n"))


@query("clean_values", "SELECT o_orderkey, round(CAST(regexp_replace('$' || o_totalprice || ' USD', '[^0-9.]', '', 'g') AS DOUBLE), 4) AS amount, CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def clean_values(spark, sf_dir):
    """Amounts, ids and dates of mixed formats read back from text."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("d"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("d", "yyyy-MM-dd")).otherwise(F.date_format("d", "MM/dd/yyyy"))
    return o.select(
        "o_orderkey",
        rounded(readers.amount(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,4)").cast("string"), F.lit(" USD"))), 4).alias("amount"),
        readers.transaction_id(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("id"),
        readers.any_date(text).cast("date").cast("string").alias("day"),
    )


@query("stream_running_stats", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def stream_running_stats(spark, sf_dir):
    source = load(spark, sf_dir, "events").select("event_type", "value")
    at = _folder(spark, "in")
    source.write.parquet(at)
    rows = spark.readStream.schema(source.schema).parquet(at)
    out = stream.run_once(stream.running_stats(rows, "event_type", "value"), _folder(spark, "stats"), "complete", _folder(spark, "state"))
    return out.select("event_type", "n", rounded(F.col("total"), 3).alias("total"))


@query("stream_exact_dedup", r"SELECT count(DISTINCT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))) AS n FROM documents")
def stream_exact_dedup(spark, sf_dir):
    source = load(spark, sf_dir, "documents").select("doc_id", "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    at = _folder(spark, "in")
    source.write.parquet(at)
    rows = spark.readStream.schema(source.schema).parquet(at)
    out = stream.run_once(stream.exact_dedup(rows, "text", "at").select("doc_id"), _folder(spark, "unique"), "append", _folder(spark, "state"))
    return out.agg(F.count("*").alias("n"))


def _stream(spark, df, files: int = 4):
    """A stream over a few files, one a micro-batch."""
    at = _folder(spark, "in")
    df.repartition(files).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


@query("stream_scrub", r"SELECT doc_id, regexp_matches(text, '@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email FROM documents WHERE text IS NOT NULL")
def stream_scrub(spark, sf_dir):
    """Records redacted as they come; whether an email was found is compared."""
    rows = _stream(spark, load(spark, sf_dir, "documents").select("doc_id", "text"))
    out = stream.run_once(stream.scrubbed(rows, "doc_id", "text"), _folder(spark, "scrubbed"), "append", _folder(spark, "state"))
    return out.select("doc_id", F.array_contains("pii_types", "EMAIL").alias("has_email"))


@query("stream_episodes", "SELECT user_id, count(*) AS steps, round(sum(value), 3) AS total, count(*) FILTER (event_type = 'purchase') AS hits FROM events GROUP BY user_id")
def stream_episodes(spark, sf_dir):
    """Users' events as episodes over several micro-batches; each user's last row in the last file says done."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_type") == "purchase").cast("int").alias("hit"))
    last = e.groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("done", F.lit(True))
    e = cut(e.join(last, ["user_id", "event_id"], "left").fillna(False, ["done"]))
    at = _folder(spark, "episodes")
    e.where("NOT done").repartition(2).write.parquet(f"{at}/a")
    e.where("done").repartition(1).write.parquet(f"{at}/b")
    rows = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(at)
    out = stream.run_once(stream.finished_episodes(rows, "user_id", "value", "hit", "done"), _folder(spark, "finished"), "append", _folder(spark, "state"))
    return out.select("user_id", "steps", rounded(F.col("total"), 3).alias("total"), "hits")


@query(
    "stream_velocity",
    """WITH m AS (SELECT date_trunc('milliseconds', max(ts)) AS top FROM clicks), w AS (SELECT client_id, CAST(floor(epoch(ts) / (30 * 86400)) AS BIGINT) AS k, count(*) AS n FROM clicks WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT client_id, k * 30 AS first_day, n FROM w, m WHERE (k + 1) * 30 * 86400 <= epoch(top - INTERVAL 1 DAY)""",
)
def stream_velocity(spark, sf_dir):
    """Clicks of a client in windows of 30 days, given out once the watermark, a day behind the latest click, has passed a window's end."""
    clicks = load(spark, sf_dir, "clicks").select("client_id", F.col("ts").cast("timestamp").alias("ts"))
    at = _folder(spark, "in")
    clicks.write.parquet(at)
    rows = spark.readStream.schema(clicks.schema).parquet(at)
    out = stream.run_once(stream.velocity(rows, "client_id", "ts"), _folder(spark, "velocity"), "append", _folder(spark, "state"))
    return out.select("client_id", F.floor(F.unix_seconds("window.start") / 86400).alias("first_day"), "n")


@query(
    "stream_drift",
    """WITH o AS (SELECT user_id % 5 AS k, event_id, value, event_id % 17 AS j FROM events), d AS (SELECT k, event_id, value - lag(value) OVER w AS a, j - lag(j) OVER w AS b, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS r FROM o WINDOW w AS (PARTITION BY k ORDER BY event_id)),
c AS (SELECT k, count(a) AS n, covar_pop(a, b) AS c, stddev_pop(a) AS x, stddev_pop(b) AS y FROM d WHERE r <= 100 GROUP BY k) SELECT k, round(CASE WHEN n >= 10 AND x > 1e-6 AND y > 1e-6 THEN c / (x * y) END, 5) AS correlation FROM c""",
)
def stream_drift(spark, sf_dir):
    """Five series; what is known after all has come is the state of all rows in order."""
    e = load(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("k"), "event_id", "value", (F.col("event_id") % 17).cast("double").alias("j"))
    at = _folder(spark, "series")
    e.coalesce(1).write.parquet(at)
    rows = spark.readStream.schema(e.schema).parquet(at)
    out = stream.run_once(stream.drift_alarms(rows, "k", "event_id", "value", "j"), _folder(spark, "drift"), "update", _folder(spark, "state"))
    return out.select("k", rounded(F.col("correlation"), 5).alias("correlation"))


@query("stream_jsonl_shuffled", "SELECT doc_id, lang FROM documents")
def stream_jsonl_shuffled(spark, sf_dir):
    """JSON lines as a stream, through shuffle buffers of a hundred records: the same rows, whatever their order (which tests compare)."""
    at = _folder(spark, "lines")
    source = load(spark, sf_dir, "documents").select("doc_id", "lang")
    source.repartition(3).write.json(at)
    rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).json(at)
    return buffer.shuffled_once(rows, "doc_id", _folder(spark, "shuffled"), _folder(spark, "state"), size=100).select("doc_id", "lang")


@query("bson_round_trip", "SELECT sale_id, client_id, status, total, strftime(sold_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS sold_at, CAST(priority AS VARCHAR) AS priority FROM sales")
def bson_round_trip(spark, sf_dir):
    """Sales as BSON documents, in plain and in xz files, read back by splits."""
    rows = load(spark, sf_dir, "sales").select("sale_id", "client_id", "status", "total", "sold_at", F.col("priority").cast("string").alias("priority"))
    at = _folder(spark, "bson")
    packed = F.pmod(F.xxhash64("sale_id"), F.lit(4)) == 0
    bson.write_bson(rows.where(~packed), at)
    bson.write_bson(rows.where(packed).coalesce(2), at, packed=True)
    documents = bson.read_bson(spark, at, split_bytes=1 << 18)
    form = "sale_id bigint, client_id bigint, status string, total double, sold_at string, priority string"
    return documents.select(F.from_json("document", form).alias("d")).select("d.*")


@query(
    "pipeline_events",
    r"""WITH a AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), b AS (SELECT * FROM a WHERE length(text) BETWEEN 100 AND 100000), c AS (SELECT min(doc_id) AS doc_id FROM b GROUP BY trim(regexp_replace(lower(text), '\s+', ' ', 'g')))
SELECT 0 AS place, 'loaded' AS stage, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM a UNION ALL SELECT 1, 'length', count(*), CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM b UNION ALL SELECT 2, 'unique', count(*), CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM b WHERE doc_id IN (SELECT doc_id FROM c)""",
)
def pipeline_events(spark, sf_dir):
    """Counts of three stages as callbacks got them while the last one was written."""
    events: list[tuple[int, str, int, int]] = []
    watch = monitor.Monitor()
    watch.add_callback(lambda stage, data: events.append((len(events), stage, data["rows"], data["chars"] or 0)) if data else None)
    chars = F.sum(F.length("text"))
    docs = watch.stage(load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), "loaded", chars=chars)
    sized = cut(watch.stage(docs.where(F.length("text").between(100, 100_000)), "length", chars=chars))
    kept = watch.stage(corpus.exact_dedup(sized, "text", "doc_id"), "unique", chars=chars)
    watch.run(lambda: kept.write.parquet(_folder(spark, "kept")))
    return spark.createDataFrame(events, "place int, stage string, n bigint, chars bigint")


@query("graph_cache", "SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1)) AS sources, 'star' AS name FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def graph_cache(spark, sf_dir):
    """A graph and its report, written and read back."""
    at = _folder(spark, "graph")
    pairs = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    writers.to_graph(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct(), pairs, at, {"name": "star"})
    vertices, edges, meta = writers.read_graph(spark, at)
    return edges.agg(F.count("*").alias("edges")).join(vertices.agg(F.count("*").alias("sources"))).withColumn("name", F.lit(meta["name"]))


@query("embedding_cache", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE round(list_sum(CAST(embedding AS DOUBLE[])), 4) END AS s FROM embeddings")
def embedding_cache(spark, sf_dir):
    """Vectors of one size, those that are missing as zeros, written and read back."""
    at = _folder(spark, "vectors")
    e = load(spark, sf_dir, "embeddings")
    size = F.size("embedding")
    n = e.agg(F.max(size).alias("n")).first().n
    writers.to_embeddings(e.select("vec_id", F.when(F.col("vec_id") % 4 > 0, F.col("embedding")).alias("embedding")), "vec_id", "embedding", n, at)
    return spark.read.parquet(at).select("vec_id", rounded(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("s"))


@query("result_cache", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def result_cache(spark, sf_dir):
    """A result made once: the second call reads what the first has written."""
    at = _folder(spark, "results")
    make = lambda: load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    writers.cached(spark, at, make)
    return writers.cached(spark, at, lambda: make().where("false")).select("lang", "n")


@query("split_report", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def split_report(spark, sf_dir):
    """Counts of an export's splits as a JSON report, written and read back."""
    at = _folder(spark, "report")
    docs = load(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    writers.to_report(spark, writers.split_stats(docs), at)
    found = writers.read_report(spark, at)
    return spark.createDataFrame([(k, v["n"], v["chars"]) for k, v in found.items()], "split string, n bigint, chars bigint")

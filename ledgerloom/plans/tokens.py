"""Queries on token ids: words stand for tokens, an id is a fixed function of a word's length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import tokens
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load

VOCABULARY = 1000
IDS_SQL = r"d AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda w: CAST((length(w) * 37) % 991 + 5 AS INTEGER)) AS ids FROM documents)"


def ids(spark, sf_dir, some: bool = False):
    """With ``some``, texts with a word alone; a filter by the number of ids would split each text once more."""
    docs = load(spark, sf_dir, "documents")
    docs = docs.where(F.col("text").rlike(r"\S")) if some else docs
    return docs.select("doc_id", F.transform(T.words(F.col("text")), lambda w: ((F.length(w) * 37) % 991 + 5).cast("int")).alias("ids"))


def _text(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


@query("chunk_tokens", f"WITH {IDS_SQL}, c AS (SELECT doc_id, ids, CAST(CASE WHEN len(ids) <= 256 THEN 1 ELSE ceil((len(ids) - 256) / 224) + 1 END AS INTEGER) AS k FROM d), x AS (SELECT *, unnest(range(k)) AS i FROM c) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, k AS total_chunks, md5(array_to_string(ids[i * 224 + 1:i * 224 + 256], ',')) AS h FROM x")
def chunk_tokens(spark, sf_dir):
    return tokens.windows(ids(spark, sf_dir), "ids", 256, 32).select("doc_id", "chunk_index", "total_chunks", _text(F.col("chunk")).alias("h"))


def _chunks_sql(size: int) -> str:
    """All ids in chunks of ``size``, the last one shorter; one of a text without ids."""
    return f"c AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, ids[i * {size} + 1:i * {size} + {size}] AS ids FROM (SELECT doc_id, ids, unnest(range(greatest(CAST(ceil(len(ids) / {size}) AS INTEGER), 1))) AS i FROM d))"


@query("packed_sequence", f"WITH {IDS_SQL}, {_chunks_sql(170)}, p AS (SELECT doc_id // 3 AS pack, chunk_index, doc_id, ids, row_number() OVER (PARTITION BY doc_id // 3, chunk_index ORDER BY doc_id) AS r FROM c), j AS (SELECT pack, chunk_index, flatten(list(CASE WHEN r > 1 THEN list_concat([2], ids) ELSE ids END ORDER BY r)) AS a FROM p GROUP BY pack, chunk_index) SELECT pack, chunk_index, len(a) AS used, md5(array_to_string(list_concat(a, list_transform(range(512 - len(a)), lambda i: 0)), ',')) AS h FROM j")
def packed_sequence(spark, sf_dir):
    """Whole texts in chunks of 170 ids; a pack of 512 has the chunks of one number of three texts, and two separators."""
    rows = tokens.windows(ids(spark, sf_dir), "ids", 170, 0).withColumn("pack", F.floor(F.col("doc_id") / 3))
    out = tokens.packed(rows, ["pack", "chunk_index"], "doc_id", "chunk")
    return out.select("pack", "chunk_index", F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("used"), _text(F.col("input_ids")).alias("h"))


def _u(seed: str, position: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || doc_id || ':' || {position}), 1, 8)) AS BIGINT) / 4294967296"


@query(
    "mlm_collator",
    f"""WITH {IDS_SQL}, x AS (SELECT doc_id, unnest(ids) AS x, unnest(range(len(ids))) AS i FROM d), m AS (SELECT doc_id, i, x, {_u('m', 'i')} < 0.15 AS chosen, {_u('r', 'i')} AS r, CAST(floor({_u('t', 'i')} * {VOCABULARY}) AS INTEGER) AS other FROM x),
p AS (SELECT doc_id, i, CASE WHEN NOT chosen THEN x WHEN r < 0.8 THEN 4 WHEN r < 0.9 THEN other ELSE x END AS y, CASE WHEN chosen THEN x ELSE -100 END AS l FROM m) SELECT doc_id, md5(string_agg(y, ',' ORDER BY i)) AS inputs, md5(string_agg(l, ',' ORDER BY i)) AS labels FROM p GROUP BY doc_id""",
)
def mlm_collator(spark, sf_dir):
    given, labels = tokens.masked_lm(F.col("ids"), F.col("doc_id").cast("string"), VOCABULARY)
    return ids(spark, sf_dir, some=True).select("doc_id", _text(given).alias("inputs"), _text(labels).alias("labels"))


@query(
    "whole_word_collator",
    f"""WITH {IDS_SQL}, x AS (SELECT doc_id, unnest(ids) AS x, unnest(range(len(ids))) AS i FROM d), w AS (SELECT DISTINCT doc_id, i // 2 AS w FROM x), k AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY {_u('w', 'w')}, w) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM w), c AS (SELECT doc_id, w FROM k WHERE r <= greatest(1, floor(n * 0.15)))
SELECT x.doc_id, md5(string_agg(CASE WHEN c.w IS NULL THEN x ELSE 4 END, ',' ORDER BY i)) AS inputs, md5(string_agg(CASE WHEN c.w IS NULL THEN -100 ELSE x END, ',' ORDER BY i)) AS labels FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND i // 2 = c.w GROUP BY x.doc_id""",
)
def whole_word_collator(spark, sf_dir):
    """Two ids in a row are a word."""
    rows = ids(spark, sf_dir, some=True).withColumn("words", F.transform("ids", lambda x, i: F.floor(i / 2).cast("int"))).withColumn("key", F.col("doc_id").cast("string"))
    return tokens.whole_words(rows, "ids", "words", "key").select("doc_id", _text(F.col("input_ids")).alias("inputs"), _text(F.col("labels")).alias("labels"))


@query("causal_collator", f"WITH {IDS_SQL}, {_chunks_sql(64)} SELECT doc_id, chunk_index, md5(array_to_string(list_transform(list_concat(ids, list_transform(range(64 - len(ids)), lambda i: 0)), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',')) AS labels FROM c")
def causal_collator(spark, sf_dir):
    """Whole texts in chunks of 64 ids, the last one padded."""
    padded = F.concat("chunk", F.array_repeat(F.lit(tokens.PAD), F.lit(64) - F.size("chunk")))
    return tokens.windows(ids(spark, sf_dir), "ids", 64, 0).select("doc_id", "chunk_index", _text(tokens.causal_lm(padded)).alias("labels"))


@query("span_collator")
def span_collator(spark, sf_dir):
    return tokens.span_batches(ids(spark, sf_dir), "ids", "doc_id", VOCABULARY)


@query("t5_collator")
def t5_collator(spark, sf_dir):
    return tokens.span_batches(ids(spark, sf_dir), "ids", "doc_id", VOCABULARY, sentinels=True)


@query("token_table", f"WITH {IDS_SQL}, {_chunks_sql(128)} SELECT doc_id, chunk_index, CAST(len(ids) AS INTEGER) AS n_tokens, md5(array_to_string(ids, ',')) AS h FROM c")
def token_table(spark, sf_dir):
    """Whole texts in chunks: ids and masks of a fixed width written as a table, and read back without the padding."""
    from ledgerloom.plans.sources_sinks import _folder

    at = _folder(spark, "tokens")
    tokens.packed(tokens.windows(ids(spark, sf_dir), "ids", 128, 0), ["doc_id", "chunk_index"], "doc_id", "chunk", 128).write.parquet(at)
    n = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    return spark.read.parquet(at).select("doc_id", "chunk_index", n.alias("n_tokens"), _text(F.slice("input_ids", F.lit(1), n)).alias("h"))

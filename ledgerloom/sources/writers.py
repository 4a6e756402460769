"""Sinks: every export is a distributed write; only small reports go through the driver."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import corpus
from ledgerloom.sources import loaders


def to_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_jsonl_v2(samples: DataFrame, path: str) -> None:
    """Nested labels and counts."""
    nested = samples.select("sample_id", "text", "source", F.struct(F.col("label").alias("primary"), "risk_level", "typologies", "indicators").alias("labels"), F.create_map(F.lit("char_count"), F.length("text").cast("string")).alias("metadata"))
    nested.write.mode("overwrite").json(path)


def to_training_text(df: DataFrame, path: str, text: str = "text") -> None:
    """One text a line, line ends of any kind as spaces; null texts are left out."""
    df.where(F.col(text).isNotNull()).select(F.regexp_replace(text, r"\s*[\r\n]\s*", " ").alias("value")).write.mode("overwrite").text(path)


def to_mlm(df: DataFrame, path: str, text: str = "text", *, text_only: bool = True, size: int = 512, overlap: int = 64) -> None:
    """Texts in chunks of ``size`` words for masked language models: one a line, or as {"text": ...} with its line ends kept."""
    chunks = corpus.chunk_words(df.select(text).where(F.col(text).isNotNull()), text, size, overlap).select(F.col("chunk").alias("text"))
    if text_only:
        to_training_text(chunks, path)
    else:
        to_jsonl(chunks, path)


def to_dataset(samples: DataFrame, path: str, split: Column, *, keep: list[str] | None = None, chunked: bool = True) -> None:
    """Samples in training format as Parquet, by split; whole or in chunks with chunk_index and total_chunks. A split is read without the others."""
    rows, more = samples.withColumn("split", split), [*(keep or []), "split"]
    if chunked:
        rows = corpus.chunk_words(rows.where("text IS NOT NULL"), "text").drop("text").withColumnRenamed("chunk", "text")
        more += ["chunk_index", "total_chunks"]
    to_splits(loaders.training_format(rows, more), path)


def to_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def to_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def to_markdown(df: DataFrame, most_rows: int = 200) -> str:
    """A report of few rows as a table."""
    names = df.columns
    rows = df.limit(most_rows).collect()
    lines = [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"] + [f"| {' | '.join(str(r[n]) for n in names)} |" for r in rows]
    return "\n".join(lines)


def to_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as one JSON text, by Spark's own writer, so any store will do."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def split_stats(df: DataFrame, split: str = "split") -> dict:
    """Rows and characters by split, and the splits' shares: few rows, for the report beside an export."""
    rows = df.groupBy(split).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    total = sum(r.n for r in rows)
    return {r[split]: {"n": r.n, "chars": r.chars, "share": r.n / total} for r in rows}


def to_graph(vertices: DataFrame, edges: DataFrame, path: str, meta: dict) -> None:
    """Vertices, edges and a report in one folder; the report is written last, so a folder with it is whole."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    to_report(vertices.sparkSession, meta, f"{path}/meta")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), read_report(spark, f"{path}/meta")


def to_embeddings(df: DataFrame, id: str, vector: str, size: int, path: str) -> None:
    """Ids and vectors of one size; what is missing or of another size is a vector of zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    good = F.col(vector).isNotNull() & (F.size(vector) == size)
    df.select(id, F.when(good, F.col(vector).cast("array<float>")).otherwise(zeros).alias(vector)).write.mode("overwrite").parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What is written at ``path``, made and written first if it isn't there yet (a folder counts once its writer has finished)."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").json(path)
    return spark.read.json(path)

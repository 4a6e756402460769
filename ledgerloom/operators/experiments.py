"""Records of experiments: metrics by episode, a summary and a text report of every run, written and read back.

The log is a long table (run, metric, idx, value), so any number of runs and episodes lies in one partitioned data set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The lines of a report; a line with a field has its value behind it.
REPORT = [
    ("Training Summary:", None, ""),
    ("  Total Episodes: ", "total_episodes", "%d"),
    ("  Average Reward: ", "avg_reward", "%.2f"),
    ("  Max Reward: ", "max_reward", "%.2f"),
    ("  Final Avg Reward (last 100): ", "final_avg_reward", "%.2f"),
    ("", None, ""),
    ("Detection Performance:", None, ""),
    ("  Final Detection Rate: ", "final_detection_rate", "%.2f%%"),
    ("  Final Precision: ", "final_precision", "%.2f%%"),
    ("  Final Recall: ", "final_recall", "%.2f%%"),
    ("  Best F1 Score: ", "best_f1_score", "%.2f%%"),
    ("  Final F1 Score: ", "final_f1_score", "%.2f%%"),
]
RULE = "=" * 80


def metric_log(df: DataFrame, run: str, idx: str, metrics: list[str]) -> DataFrame:
    """(run, metric, idx, value) of one row an episode; what is null was not logged."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.col(run).alias("run"), F.col(idx).alias("idx"), F.inline(each)).where("value IS NOT NULL")


def summary(log: DataFrame, last: int = 100) -> DataFrame:
    """One row a run; a metric that a run never logged is null. Of rows with equal idx the greatest value is the final one.

    All but the mean of the last episodes is one aggregate with partial sums; for that one, tasks keep ``last`` rows of a run before the shuffle.
    """
    of = lambda m: F.when(F.col("metric") == m, F.col("value"))
    final = lambda m: F.max(F.when(F.col("metric") == m, F.struct("idx", "value")))["value"]
    out = log.groupBy("run").agg(
        F.count(of("episode_rewards")).alias("total_episodes"),
        F.avg(of("episode_rewards")).alias("avg_reward"),
        F.max(of("episode_rewards")).alias("max_reward"),
        F.avg(of("episode_lengths")).alias("avg_episode_length"),
        final("detection_rates").alias("final_detection_rate"),
        F.max(of("f1_score")).alias("best_f1_score"),
        final("f1_score").alias("final_f1_score"),
        final("precision").alias("final_precision"),
        final("recall").alias("final_recall"),
    )
    order = W.partitionBy("run").orderBy(F.desc("idx"), F.desc("value"))
    recent = log.where("metric = 'episode_rewards'").withColumn("r", F.row_number().over(order)).where(F.col("r") <= last)
    means = recent.groupBy(F.col("run").alias("of_run")).agg(F.avg("value").alias("final_avg_reward"))
    return out.join(means, F.col("run").eqNullSafe(F.col("of_run")), "left").drop("of_run")


def report(name: Column) -> Column:
    """A summary's row as a text; what is null counts as 0."""
    lines = [F.lit(RULE), F.concat(F.lit("Experiment Report: "), name), F.lit(RULE), F.lit("")]
    for words, field, form in REPORT:
        if field is None:
            lines.append(F.lit(words))
            continue
        value = F.coalesce(F.col(field), F.lit(0)) * (100 if "%%" in form else 1)
        lines.append(F.concat(F.lit(words), F.format_string(form, value)))
    return F.array_join(F.array(*lines, F.lit(""), F.lit(RULE)), "\n")


def save(log: DataFrame, path: str, config: dict[str, Column] | None = None) -> None:
    """The log by metric as Parquet, and a line of metadata for every run as JSON: name, config and summary. Metadata is written last."""
    log.write.mode("overwrite").partitionBy("metric").parquet(f"{path}/metrics")
    done = summary(log.sparkSession.read.parquet(f"{path}/metrics"))
    set_to = F.create_map(*[x for k, v in (config or {}).items() for x in (F.lit(k), v.cast("string"))]).cast("map<string,string>")
    numbers = F.struct(*[c for c in done.columns if c not in ("run", "total_episodes")])
    done.select(F.col("run").cast("string").alias("experiment_name"), "total_episodes", set_to.alias("config"), numbers.alias("summary")).write.mode("overwrite").json(f"{path}/metadata")


_NUMBERS = ["avg_reward", "max_reward", "avg_episode_length", "final_detection_rate", "best_f1_score", "final_f1_score", "final_precision", "final_recall", "final_avg_reward"]


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(log, metadata); a metric is read without the files of the others."""
    form = f"experiment_name string, total_episodes bigint, config map<string,string>, summary struct<{', '.join(f'{n}: double' for n in _NUMBERS)}>"
    return spark.read.parquet(f"{path}/metrics"), spark.read.schema(form).json(f"{path}/metadata")

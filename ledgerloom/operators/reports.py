"""Reports over runs, trials, queues and caches, and rolling statistics of series."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import metrics
from ledgerloom.operators.metrics import ratio


def last_rows(df: DataFrame, key: str, order: str, window: int) -> DataFrame:
    """The last ``window`` rows of each key; map tasks keep no more than that of a key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= window).drop("__r")


def rolling_window_stats(df: DataFrame, key: str, order: str, value: str, window: int = 100, success: float = 0.0) -> DataFrame:
    """(key, mean, std, min, max, median, success) of each key's last ``window`` values; success is the share above a limit."""
    v = F.col(value)
    return last_rows(df, key, order, window).groupBy(key).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.5).alias("median"), F.avg((v > success).cast("double")).alias("success"))


def moving_average(df: DataFrame, key: str, order: str, value: str, most: int = 50, share: int = 10) -> DataFrame:
    """``df`` with ``smoothed``: the mean of w rows, w the least of ``most`` and a ``share`` of the series, without the first w - 1 rows."""
    w = W.partitionBy(key).orderBy(order)
    numbered = df.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(W.partitionBy(key)), "__c": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))})
    numbered = numbered.withColumn("__w", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("__n") / share))).cast("int"))
    lagged = numbered.select(F.col(key).alias("__key"), (F.col("__i") + F.col("__w")).alias("__at"), F.col("__c").alias("__before"))
    joined = numbered.where("__i >= __w").join(lagged, (F.col(key) == F.col("__key")) & (F.col("__i") == F.col("__at")), "left")
    return joined.withColumn("smoothed", (F.col("__c") - F.coalesce("__before", F.lit(0.0))) / F.col("__w")).drop("__i", "__n", "__c", "__w", "__key", "__at", "__before")


def rolling_mean(df: DataFrame, key: str, order: str, value: str, window: int, least: int | None = None) -> DataFrame:
    """``df`` with ``rolling``: the mean of the last ``window`` rows, null below ``least`` of them (``window`` if not given)."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(1 - window, 0)
    return df.withColumn("rolling", F.when(F.count(value).over(w) >= (least or window), F.avg(value).over(w)))


def reward_correlation(df: DataFrame, key: str, order: str, a: str, b: str, window: int = 100, least: int = 10) -> DataFrame:
    """(key, correlation) over the last ``window`` rows; 1 where there are fewer than ``least``, or either series is flat."""
    r = last_rows(df, key, order, window).groupBy(key).agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("x"), F.stddev_pop(b).alias("y"))
    flat = (F.col("n") < least) | (F.col("x") < 1e-6) | (F.col("y") < 1e-6)
    return r.select(key, F.when(flat, 1.0).otherwise(F.try_divide("c", F.col("x") * F.col("y"))).alias("correlation"))


def experiment_summary(df: DataFrame, key: str, order: str, reward: str, f1: str, last: int = 100) -> DataFrame:
    """(key, avg_reward, max_reward, final_avg_reward, final_reward, best_f1, final_f1)."""
    whole = df.groupBy(key).agg(F.avg(reward).alias("avg_reward"), F.max(reward).alias("max_reward"), F.max_by(reward, order).alias("final_reward"), F.max(f1).alias("best_f1"), F.max_by(f1, order).alias("final_f1"))
    return whole.join(last_rows(df, key, order, last).groupBy(key).agg(F.avg(reward).alias("final_avg_reward")), key)


def judge_metrics(df: DataFrame, kind: str, reward: str, latency: str) -> DataFrame:
    """(kind, n, mean, std, min, max, p99) by kind of fraud, and in all (kind null), from one grouping."""
    stats = [F.count("*").alias("n"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.min(reward).alias("min"), F.max(reward).alias("max"), F.percentile(latency, 0.99).alias("p99")]
    return df.rollup(kind).agg(*stats)


def replay_stats(df: DataFrame, episode: str, fraud: str) -> DataFrame:
    """One row: episodes, those with fraud and their ratio, fraud an episode on average and at most."""
    each = df.groupBy(episode).agg(F.sum(F.col(fraud).cast("long")).alias("n"))
    some = F.sum((F.col("n") > 0).cast("long"))
    return each.agg(F.count("*").alias("episodes"), some.alias("fraud_episodes"), ratio(some, F.count("*")).alias("fraud_ratio"), F.avg("n").alias("avg_fraud"), F.max("n").alias("max_fraud"))


def param_importance(trials: DataFrame, metric: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(param, importance): absolute correlation of a number, variance of group means over that of the metric of a category (sample variances)."""
    numbers = trials.agg(*[F.abs(F.corr(c, metric)).alias(c) for c in numeric], F.var_samp(metric).alias("__v"))
    rows = numbers.select(F.inline(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).alias("importance")) for c in numeric])))
    whole = numbers.select("__v")
    for c in categorical:
        means = trials.groupBy(c).agg(F.avg(metric).alias("m")).agg(F.var_samp("m").alias("v"))
        rows = rows.union(means.join(F.broadcast(whole)).select(F.lit(c), F.try_divide("v", "__v")))
    return rows


def message_stats(messages: DataFrame, step: str, kind: str, proposal: str = "proposal") -> DataFrame:
    """One row: messages, distinct kinds, steps, proposals and proposals a step."""
    is_proposal = F.sum((F.col(kind) == proposal).cast("long"))
    return messages.agg(F.count("*").alias("messages"), F.count_distinct(kind).alias("kinds"), F.count_distinct(step).alias("steps"), is_proposal.alias("proposals")).withColumn("proposals_per_step", ratio(F.col("proposals"), F.col("steps")))


def packing_stats(packs: DataFrame, keys: list[str], tokens: str, size: int) -> DataFrame:
    """One row of (keys, tokens) packs: packs, documents and tokens a pack, and the share of a pack that is used."""
    each = packs.groupBy(*keys).agg(F.count("*").alias("docs"), F.least(F.sum(tokens), F.lit(size)).alias("used"))
    return each.agg(F.count("*").alias("packs"), F.avg("docs").alias("docs_per_pack"), F.avg("used").alias("tokens_per_pack"), (F.sum("used") / (F.count("*") * size)).alias("efficiency"))


def pretokenize_stats(df: DataFrame, words: Column, most: int = 512) -> DataFrame:
    """One row: documents, tokens as int(words * 1.3), and how many documents have more than ``most``."""
    tokens = F.floor(words * 1.3).cast("long")
    return df.agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"), F.sum((tokens > most).cast("long")).alias("truncated"))


def judge_updates(episodes: DataFrame, episode: str, buffered: str, *, warmup: int = 200, every: int = 100, least: int = 50, frozen: int = 5000) -> DataFrame:
    """Episodes in which the judge is to be updated."""
    e = F.col(episode)
    return episodes.where((e >= warmup) & (e < frozen) & (F.col(buffered) >= least) & ((e - warmup) % every == 0))


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, histogram): a map from value to count, in order of value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value).alias("k"), "n")))).alias("histogram"))


def lru_stats(df: DataFrame, key: str, order: str, item: str, capacity: int) -> DataFrame:
    """(key, size, hits, misses, hit_rate) of a cache of ``capacity`` items for each key (a shard of requests in order).

    Eviction is an ordered fold: shards are sorted in Spark and stream through a task, which holds one shard's cache at a time.
    """
    kind = dict(df.dtypes)[key]

    def row(shard, cache, hits, misses):
        return pd.DataFrame({key: [shard], "size": [len(cache)], "hits": [hits], "misses": [misses], "hit_rate": [hits / (hits + misses) if hits + misses else 0.0]})

    def run(parts):
        shard, cache, hits, misses = None, None, 0, 0
        for pdf in parts:
            for k, x in zip(pdf[key].tolist(), pdf[item].tolist(), strict=True):
                if cache is None or k != shard:
                    if cache is not None:
                        yield row(shard, cache, hits, misses)
                    shard, cache, hits, misses = k, OrderedDict(), 0, 0
                if x in cache:
                    cache.move_to_end(x)
                    hits += 1
                else:
                    misses += 1
                    if len(cache) >= capacity:
                        cache.popitem(last=False)
                    cache[x] = None
        if cache is not None:
            yield row(shard, cache, hits, misses)

    rows = df.where(F.col(key).isNotNull()).select(key, order, item).repartition(key).sortWithinPartitions(key, order)
    return rows.select(key, item).mapInPandas(run, f"{key} {kind}, size bigint, hits bigint, misses bigint, hit_rate double")


def scheme_overlap(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(scheme, size, overlap): of each true scheme (scheme, node), the greatest share that one discovered set (found, node) holds."""
    sizes = truth.groupBy("scheme").agg(F.count_distinct("node").alias("size"))
    shared = truth.select("scheme", "node").distinct().join(found.select("found", "node").distinct(), "node").groupBy("scheme", "found").agg(F.count("*").alias("n"))
    best = shared.groupBy("scheme").agg(F.max("n").alias("n"))
    return sizes.join(best, "scheme", "left").select("scheme", "size", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("overlap"))


def scheme_detection(truth: DataFrame, found: DataFrame, *, whole: float = 0.8, part: float = 0.3) -> DataFrame:
    """One row: shares of schemes found and found in part, of fraud nodes covered, mean size of a set, and nodes explored."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    o = F.col("overlap")
    schemes = scheme_overlap(truth, found).agg(share(o >= whole).alias("detection_rate"), share((o >= part) & (o < whole)).alias("partial_rate"))
    nodes, explored = truth.select("node").distinct(), found.select("node").distinct()
    covered = nodes.agg(F.count("*").alias("fraud")).join(nodes.join(explored, "node", "left_semi").agg(F.count("*").alias("covered")))
    sets = found.groupBy("found").agg(F.count_distinct("node").alias("n")).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_size"))
    one = schemes.join(covered).join(sets).join(explored.agg(F.count("*").alias("explored")))
    return one.select("detection_rate", "partial_rate", ratio(F.col("covered"), F.col("fraud")).alias("coverage"), "avg_size", "explored")


def proposal_outcomes(proposals: DataFrame, truth: DataFrame) -> DataFrame:
    """(sender, n, accepted, right, precision, agreement) of proposals (sender, node, score, accepted) against fraud nodes (node)."""
    judged = proposals.join(truth.select("node").distinct().withColumn("fraud", F.lit(1)), "node", "left").fillna(0, ["fraud"])
    count = lambda c: F.sum(c.cast("long"))
    said = F.col("score") >= 0.5
    out = judged.groupBy("sender").agg(F.count("*").alias("n"), count(F.col("accepted")).alias("accepted"), count(F.col("accepted") & (F.col("fraud") == 1)).alias("right"), F.avg((said == F.col("accepted")).cast("double")).alias("agreement"))
    return out.withColumn("precision", ratio(F.col("right"), F.col("accepted")))


def comparison_table(metrics: dict[str, DataFrame]) -> DataFrame:
    """(model, metric, value): one-row tables of metrics, one a model, as a long table."""
    parts = []
    for model, df in metrics.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        parts.append(df.select(F.lit(model).alias("model"), F.inline(pairs)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corpus_estimates(characters: Column, *, per_token: float = 4.0, tokens_per_second: float = 1e5, epochs: int = 1) -> dict[str, Column]:
    """Tokens, bytes of ids (4 each) and hours of training for so many characters."""
    tokens = F.floor(characters / per_token)
    return {"tokens": tokens, "id_bytes": tokens * 4, "hours": tokens * epochs / tokens_per_second / 3600}


def proposal_encoding(proposals: DataFrame, group: str, *, most: int = 10, width: int = 4) -> DataFrame:
    """(group, v): the ``most`` proposals of highest score as ``width`` numbers each, padded with zeros: score, 1 for an edge, priority, connectivity.

    ``proposals`` has score, is_edge, is_high_priority, neighbours and place (which orders equal scores). An edge has priority above 0.7 and
    connectivity 0.5, a node that of its neighbours, 20 being all. Ranks up to ``most`` are kept by map tasks before the shuffle.
    """
    edge = F.coalesce("is_edge", F.lit(False))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    four = F.array(
        score,
        edge.cast("double"),
        F.when(edge, (score > 0.7).cast("double")).otherwise(F.coalesce("is_high_priority", F.lit(False)).cast("double")),
        F.when(edge, 0.5).otherwise(F.least(F.coalesce("neighbours", F.lit(0)) / 20, F.lit(1.0))),
    )
    ranked = proposals.select(group, score.alias("__s"), F.col("place").alias("__p"), four.alias("__v")).withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("__s"), "__p")))
    kept = ranked.where(F.col("__r") <= most).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__r", "__v"))).alias("l"))
    flat = F.flatten(F.transform("l", lambda x: F.slice(F.concat(x["__v"], F.array_repeat(F.lit(0.0), width)), 1, width)))
    return kept.select(group, F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), most * width)), 1, most * width).alias("v"))


def evaluation(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: what a method that calls scores from ``threshold`` positive gets right, and the areas under its curves.

    Rates over nothing are 0; both areas are null where one of the labels has no rows.
    """
    tn, fp, fn, tp = (F.coalesce(c, F.lit(0)) for c in ("tn", "fp", "fn", "tp"))
    counted = metrics.confusion(scored, threshold).select(tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"))
    areas = metrics.roc_auc(scored).join(metrics.pr_auc_trapezoid(scored))
    return metrics.rates(counted).join(areas).select(
        "precision",
        "recall",
        F.col("f1").alias("f1_score"),
        "accuracy",
        F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"),
        F.col("tn").alias("true_negatives"),
        F.col("fn").alias("false_negatives"),
        F.col("recall").alias("detection_rate"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"),
        "roc_auc",
        F.when(F.col("roc_auc").isNotNull(), F.col("pr_auc")).alias("pr_auc"),
    )


def save_evaluations(methods: dict[str, DataFrame], path: str) -> None:
    """Evaluations by name of method, a JSON line each, nulls as such."""
    rows = [df.select(F.lit(name).alias("method"), *df.columns) for name, df in methods.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


_COUNTS = ["true_positives", "false_positives", "true_negatives", "false_negatives"]
_RATES = ["precision", "recall", "f1_score", "accuracy", "detection_rate", "false_positive_rate", "roc_auc", "pr_auc"]


def load_evaluations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(["method string", *[f"{c} bigint" for c in _COUNTS], *[f"{c} double" for c in _RATES]])).json(path)


def comparison_line(name: str = "method") -> Column:
    """An evaluation as a line of a table: name, five rates in percent and the area under the ROC curve; nulls as 0."""
    percent = [F.format_string("%9.2f%%", F.coalesce(c, F.lit(0.0)) * 100) for c in ("precision", "recall", "f1_score", "detection_rate", "false_positive_rate")]
    return F.concat_ws(" | ", F.format_string("%-20s", F.col(name)), *percent, F.format_string("%10.4f", F.coalesce("roc_auc", F.lit(0.0))))

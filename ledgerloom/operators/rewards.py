"""Rewards of walks over a graph: expressions, and the one fold that needs what an episode did before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Steps from a node that no path leads to fraud from.
FAR = 999


def flag_reward(fraud: Column, confidence: Column, hit: float = 10.0, miss: float = -10.0) -> Column:
    return F.when(fraud, hit).otherwise(miss) * (0.5 + 0.5 * confidence)


def proximity_reward(before: Column, now: Column, gamma: float = 0.99, scale: float = 0.05) -> Column:
    """Shaping by the change in distance to fraud; no distance is far."""
    return scale * (F.coalesce(before, F.lit(FAR)) - gamma * F.coalesce(now, F.lit(FAR)))


def curiosity_reward(visits: Column, fraud: Column, scale: float = 0.05) -> Column:
    """By how often a node was visited before, twice that at fraud."""
    return F.when(fraud, 2.0).otherwise(1.0) * scale / (1 + visits)


def flag_step_rewards(steps: DataFrame, episode: str, step: str, *, cooldown: int = 3, most: int = 5, miss: float = -0.5) -> DataFrame:
    """(episode, step, reward, reason) of the flag steps of each episode (node, is_flag, hit: true, false or null).

    The first rule that fails gives the reward: fewer than ``cooldown`` steps since the last flag attempt or the
    start (-0.5), ``most`` flags made already (-0.3), a node flagged before (-0.2); else 1 for a hit, ``miss``
    for none, 0.1 where unknown. A penalised attempt is no flag, but starts the cooldown anew, so whether an attempt
    passes it depends on the attempts' places alone; only the count of flags and the flagged nodes are folded.
    """
    w = W.partitionBy(episode).orderBy(step)
    place = steps.withColumn("i", F.row_number().over(w)).where("is_flag")
    tried = place.withColumn("since", F.col("i") - F.coalesce(F.lag("i").over(w), F.lit(0)))
    asked = tried.withColumn("ready", F.col("since") >= cooldown)
    # Of the attempts that are ready, the first at each node is new; the first ``most`` of those are flags.
    node = W.partitionBy(episode, "node", "ready").orderBy(step)
    asked = asked.withColumn("first", F.col("ready") & (F.row_number().over(node) == 1))
    made = asked.withColumn("flags", F.coalesce(F.sum(F.col("first").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    reason = F.when(~F.col("ready"), "cooldown_violation").when(F.col("flags") >= most, "max_flags_exceeded").when(~F.col("first"), "duplicate_flag")
    reason = reason.when(F.col("hit"), "true_positive").when(~F.col("hit"), "false_positive").otherwise("unknown")
    reward = F.create_map(*[F.lit(x) for pair in {"cooldown_violation": -0.5, "max_flags_exceeded": -0.3, "duplicate_flag": -0.2, "true_positive": 1.0, "false_positive": miss, "unknown": 0.1}.items() for x in pair])
    return made.select(episode, step, reason.alias("reason")).withColumn("reward", reward[F.col("reason")])


def move_step_rewards(steps: DataFrame, episode: str, step: str, node: str, risk: Column, weight: float = 0.1) -> DataFrame:
    """``steps`` with ``reward``: -0.01, a bonus for a node's first visit, and one for risk above one half."""
    first = F.row_number().over(W.partitionBy(episode, node).orderBy(step)) == 1
    return steps.withColumn("reward", -0.01 + F.when(first, weight * 0.05).otherwise(0.0) + F.when(risk > 0.5, weight * risk * 0.1).otherwise(0.0))


def split_rewards(fraud: Column, confidence: Column, hit: float = 10.0, miss: float = -5.0, caught: float = -10.0) -> tuple[Column, Column]:
    """Of the detector and of the adversary, who loses where fraud is flagged and gains half of what a false alarm costs."""
    detector = flag_reward(fraud, confidence, hit, miss)
    return detector, F.when(fraud, caught).otherwise(F.abs(detector) * 0.5)


def softmax(df: DataFrame, key: str, score: str, temperature: float = 1.0) -> DataFrame:
    """``df`` with ``p``: the share of exp(score / temperature) in its key, from the greatest down so that nothing overflows."""
    tops = df.groupBy(key).agg(F.max(score).alias("__top"))
    scaled = df.join(tops, key).withColumn("__e", F.exp((F.col(score) - F.col("__top")) / temperature))
    return scaled.join(scaled.groupBy(key).agg(F.sum("__e").alias("__sum")), key).withColumn("p", F.col("__e") / F.col("__sum")).drop("__e", "__sum", "__top")


def augmented_scores(nodes: DataFrame, proposals: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, proposal, judge, combined): the best proposal that names a node or an edge of it, the judge's (score + 1) / 2 times confidence, 0.4 and 0.6 of them."""
    marked = proposals.select(F.explode(F.array_compact(F.array("src", "dst"))).alias("id"), "score").groupBy("id").agg(F.max("score").alias("proposal"))
    judge = judged.groupBy("id").agg(F.max((F.col("score") + 1) / 2 * F.col("confidence")).alias("judge"))
    rows = nodes.select("id").join(marked, "id", "left").join(judge, "id", "left").fillna(0.0, ["proposal", "judge"])
    return rows.withColumn("combined", 0.4 * F.col("proposal") + 0.6 * F.col("judge"))


def target_reward(f1: Column) -> Column:
    """From -1 to 1."""
    return 2 * f1 - 1


def set_f1(found: Column, truth: Column) -> Column:
    """F1 of a set of nodes against the true one; 0 where either is empty."""
    both = F.size(F.array_intersect(found, truth))
    total = F.size(F.array_distinct(found)) + F.size(F.array_distinct(truth))
    return F.when((F.size(found) == 0) | (F.size(truth) == 0), 0.0).otherwise(2 * both / total)


def focal_weight(p: Column, label: Column, gamma: float = 2.0) -> Column:
    """(1 - probability of the true class) ^ gamma."""
    return F.pow(1 - F.when(label == 1, p).otherwise(1 - p), F.lit(gamma))


def temporal_weights(df: DataFrame, t: str, decay: float) -> DataFrame:
    """``df`` with ``weight``: exp(decay * t) over its mean; the mean is one row, broadcast."""
    w = F.exp(decay * F.col(t).cast("double"))
    return df.join(F.broadcast(df.agg(F.avg(w).alias("__mean")))).withColumn("weight", w / F.col("__mean")).drop("__mean")


def drawn(df: DataFrame, group: str, item: str, logit: str, temperature: float, *, seed: int = 7, draws: int = 1) -> DataFrame:
    """(group, draw, item): for each group, ``draws`` items with chances in the proportion exp(logit / temperature), each draw from all items.

    The item with the largest logit / temperature plus a Gumbel number has just these chances, so a draw is an aggregate that map tasks
    reduce; the number comes from a digest of seed, draw, group and item, so draws repeat. Rows without a logit can't be drawn.
    """
    rows = df.where(F.col(logit).isNotNull()).select(group, item, F.col(logit).alias("__l"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", group, item))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    score = F.col("__l") / temperature - F.log(-F.log(u))
    return rows.groupBy(group, "draw").agg(F.max(F.struct(score.alias("s"), F.col(item).alias("i"))).alias("m")).select(group, "draw", F.col("m.i").alias(item))

"""Episode and event analytics: returns, curves, drift, samples, queues, anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import features


def episode_stats(steps: DataFrame, episode: str, step: str, reward: str, gamma: float = 0.99) -> DataFrame:
    """(episode, length, total, discounted): discounting needs only the step's number, so it is a plain aggregate."""
    return steps.groupBy(episode).agg(F.count("*").alias("length"), F.sum(reward).alias("total_return"), F.sum(F.pow(F.lit(gamma), F.col(step)) * F.col(reward)).alias("discounted_return"))


def n_step_returns(steps: DataFrame, episode: str, step: str, reward: str, n: int, gamma: float) -> DataFrame:
    """Sum of gamma^i times the reward i steps ahead, i below n; partial at the end of an episode."""
    order = W.partitionBy(episode).orderBy(step)
    total: Column = F.lit(0.0)
    for i in range(n):
        total = total + F.coalesce(F.lead(reward, i).over(order) if i else F.col(reward), F.lit(0.0)) * gamma**i
    return steps.withColumn("n_step_return", total)


def trailing_mean(df: DataFrame, key: str, order: str, value: str, window: int = 10) -> DataFrame:
    """Trailing mean, partial at the start; series shorter than the window stay as they are."""
    w = W.partitionBy(key).orderBy(order)
    n = F.count("*").over(W.partitionBy(key))
    return df.withColumn("smoothed", F.when(n < window, F.col(value)).otherwise(F.avg(value).over(w.rowsBetween(1 - window, 0))))


def episodes_to_target(curve: DataFrame, key: str, index: str, target: float) -> DataFrame:
    """(key, first index whose smoothed value reaches the target, else -1)."""
    return curve.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("smoothed") >= target, F.col(index))), F.lit(-1)).alias("episodes_to_target"))


def convergence(df: DataFrame, key: str, index: str, value: str, window: int, tolerance: float) -> DataFrame:
    """(key, first index from ``window`` to n - window whose next ``window`` values have a population variance below the tolerance, else n)."""
    w = W.partitionBy(key).orderBy(index)
    n = F.count("*").over(W.partitionBy(key))
    ahead = df.withColumn("__v", F.var_pop(value).over(w.rowsBetween(0, window - 1))).withColumn("n", n)
    hit = F.when((F.col(index) >= window) & (F.col(index) < F.col("n") - window) & (F.col("__v") < tolerance), F.col(index))
    return ahead.groupBy(key).agg(F.coalesce(F.min(hit), F.first("n")).alias("converged_at"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient; ranks come from counts by value, so equal values share one row."""
    from ledgerloom.operators.metrics import running_sums

    by = running_sums(df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c")), "x", "c", descending=False)
    # A value's c rows have ranks cum - c + 1 to cum.
    ranks = F.col("c") * (F.col("cum_c") - F.col("c")) + F.col("c") * (F.col("c") + 1) / 2
    n, total = F.sum("c"), F.sum(F.col("c") * F.col("x"))
    return by.agg(F.when(total == 0, 0.0).otherwise((2 * F.sum(ranks * F.col("x")) - (n + 1) * total) / (n * total)).alias("gini"))


def workload_balance(df: DataFrame, key: str) -> DataFrame:
    """1 / (1 + deviation / mean) of the counts by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg((1 / (1 + F.stddev_pop("n") / F.avg("n"))).alias("workload_balance"))


def rolling_correlation(df: DataFrame, key: str, order: str, a: str, b: str, window: int, least: int) -> DataFrame:
    """(…, corr, alarm): correlation of the differences of two series over the last ``window`` rows; alarm below -0.3 with ``least`` rows or more."""
    w = W.partitionBy(key).orderBy(order)
    d = df.withColumn("__a", F.col(a) - F.lag(a).over(w)).withColumn("__b", F.col(b) - F.lag(b).over(w))
    span = w.rowsBetween(1 - window, 0)
    flat = (F.stddev_pop("__a").over(span) <= 1e-6) | (F.stddev_pop("__b").over(span) <= 1e-6) | (F.count("__a").over(span) < least)
    spread = F.stddev_pop("__a").over(span) * F.stddev_pop("__b").over(span)
    corr = F.when(~flat, F.try_divide(F.covar_pop("__a", "__b").over(span), spread))
    return d.withColumn("corr", corr).withColumn("alarm", F.coalesce(F.col("corr") < -0.3, F.lit(False))).drop("__a", "__b")


def ring_buffer(df: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """The last ``capacity`` rows of each key; map tasks keep no more than that of a key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= capacity).drop("__r")


def priority_queue(df: DataFrame, key: str, priority: str, seq: str, capacity: int) -> DataFrame:
    """(…, position): by falling priority, first come first served among equals; the lowest are dropped beyond capacity."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(F.desc(priority), seq))).where(F.col("position") <= capacity)


def prioritized_sample(df: DataFrame, weight: Column, u: Column, k: int, tie: str, alpha: float = 0.6) -> DataFrame:
    """k rows without replacement with probability by weight^alpha: the k greatest u^(1/w), as -ln(u)/w ascending."""
    return df.withColumn("key", -F.log(u) / F.pow(weight, alpha)).orderBy("key", tie).limit(k)


def ema(df: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """(key, ema): d * ema + (1 - d) * x in order, from the first value. An ordered fold as a closed-form sum of weights."""
    w = W.partitionBy(key)
    numbered = df.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    share = F.pow(F.lit(decay), F.col("__n") - F.col("__i")) * F.when(F.col("__i") == 1, 1.0).otherwise(1 - decay)
    return numbered.groupBy(key).agg(F.sum(share * F.col(value)).alias("ema"))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, first, last, n): maximal runs of one value."""
    w = W.partitionBy(key).orderBy(order)
    started = df.withColumn("__s", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)).withColumn("__g", F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return started.groupBy(key, "__g", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__g")


def cvar(values: Column, alpha: float) -> Column:
    """Mean of the max(1, int((1 - alpha) n)) smallest."""
    k = F.greatest(F.lit(1), F.floor((1 - alpha) * F.size(values)).cast("int"))
    return F.aggregate(F.slice(F.array_sort(values), 1, k), F.lit(0.0), lambda s, x: s + x) / k


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def anomaly_zscore(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, score): tanh of the mean absolute z-score over dimensions, statistics by dimension."""
    long = vectors.select(id, F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    stats = long.groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))  # one row a dimension
    z = F.abs((F.col("x") - F.col("m")) / (F.col("s") + 1e-8))
    return long.join(F.broadcast(stats), "d").groupBy(id).agg(F.tanh(F.avg(z)).alias("score"))


def anomaly_centroid(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, score): distance to the centroid over the greatest such distance."""
    long = vectors.select(id, F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    mean = long.groupBy("d").agg(F.avg("x").alias("m"))
    far = long.join(F.broadcast(mean), "d").groupBy(id).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2))).alias("distance"))
    return far.join(F.broadcast(far.agg(F.max("distance").alias("most")))).select(id, (F.col("distance") / (F.col("most") + 1e-8)).alias("score"))


def two_places(x: Column) -> Column:
    """Two decimals, halves to even, as text; 0.00 for what is no finite number."""
    sane = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.replace(F.format_number(sane, 2), F.lit(","), F.lit(""))


def anonymous(id: Column) -> Column:
    return F.substring(F.sha2(id.cast("string"), 256), 1, 8)


def serialized(steps: DataFrame, episode: str, *, most_nodes: int = 50, most_edges: int = 100) -> DataFrame:
    """(episode, text) of steps (episode, step, node, kind, risk, balance, action, is_flag, amount): five sections that name no node and no label.

    Nodes are those visited first, with hashed ids, kind, risk and balance on a log scale; edges lead from each step's node to the next
    one's, with the amount and the step; both are listed by the digest of what they show beside ids. Actions are counted, times and
    amounts summed up.
    """
    w = W.partitionBy(episode).orderBy("step")
    log = lambda c: F.signum(c) * F.log1p(F.abs(c))
    shown = F.concat(F.lit("type:"), "kind", F.lit(" risk:"), two_places(F.col("risk")), F.lit(" bal:"), two_places(log(F.col("balance"))))
    first = steps.groupBy(episode, "node").agg(F.min(F.struct("step", shown.alias("shown"))).alias("f")).select(episode, F.col("f.step").alias("step"), "node", F.col("f.shown").alias("shown"))
    visits = first.withColumn("r", F.row_number().over(w))
    listed = lambda text: F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= F.lit(most_nodes if text == "n" else most_edges), F.struct(F.sha2("shown", 256).alias("h"), F.concat(F.lit(f"{text}:"), "who", F.lit(" "), "shown").alias("t"))))), lambda x: x["t"])
    nodes = visits.withColumn("who", anonymous(F.col("node"))).groupBy(episode).agg(F.array_join(listed("n"), " | ").alias("nodes"), F.count("*").alias("unique"))
    edges = steps.withColumn("to", F.lead("node").over(w)).where("`to` IS NOT NULL").withColumn("r", F.row_number().over(w))
    edges = edges.select(episode, "r", "step", "amount", F.concat(anonymous(F.col("node")), F.lit("->"), anonymous(F.col("to"))).alias("who"), F.concat(F.lit("amt:"), two_places(log(F.col("amount"))), F.lit(" t:"), "step").alias("shown"))
    span = F.max("step") - F.min("step") + 1
    times = F.when(F.count("*") > 1, F.concat(F.lit("velocity:"), two_places(F.count("*") / span), F.lit(" ")))
    amounts = F.concat(F.lit("amt_mean:"), two_places(F.avg("amount")), F.lit(" amt_std:"), two_places(F.stddev_pop("amount")), F.lit(" amt_max:"), two_places(F.max("amount")))
    edges = edges.groupBy(episode).agg(F.array_join(listed("e"), " | ").alias("edges"), F.concat(F.coalesce(times, F.lit("")), amounts).alias("temporal"))
    counts = steps.groupBy(episode, "action").agg(F.count("*").alias("n"), F.sum(F.col("is_flag").cast("long")).alias("flags"))
    actions = counts.groupBy(episode).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("action", "n"))), lambda x: F.concat(F.lit("a"), x["action"], F.lit(":"), x["n"])), " ").alias("actions"), F.sum("n").alias("total"), F.sum("flags").alias("flags"))
    rows = actions.join(nodes, episode).join(edges, episode, "left")
    parts = [
        F.concat(F.lit("[META] episode_length:"), "total", F.lit(" unique_nodes:"), "unique", F.lit(" flags_used:"), "flags"),
        F.concat(F.lit("[NODES] "), "nodes"),
        F.concat(F.lit("[EDGES] "), F.coalesce("edges", F.lit("empty"))),
        F.concat(F.lit("[ACTIONS] "), "actions", F.lit(" total:"), "total"),
        F.concat(F.lit("[TEMPORAL] "), "temporal"),
    ]
    return rows.select(episode, F.concat_ws(" ", *parts).alias("text"))


def episode_text(steps: DataFrame, episode: str, *, most_flags: int = 20, most_steps: int = 30, most_words: int = 8000) -> DataFrame:
    """(episode, text) of steps (episode, step, node, action, is_flag, fraud, confidence, reward): flags, first steps and metrics, cut after so many words."""
    w = W.partitionBy(episode).orderBy("step")
    places = lambda x, n: F.replace(F.format_number(x, n), F.lit(","), F.lit(""))
    ranked = steps.withColumn("r", F.row_number().over(w)).withColumn("f", F.sum(F.col("is_flag").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    flag = F.concat(F.lit("- TXN node="), "node", F.lit(", confidence="), places(F.col("confidence"), 2), F.lit(", is_fraud="), F.initcap(F.col("fraud").cast("string")))
    step = F.concat(F.lit("- STEP "), "step", F.lit(": "), "action", F.lit(" node="), "node", F.lit(" reward="), places(F.col("reward"), 3))
    in_order = lambda c, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("step", text.alias("t"))))), lambda x: x["t"]), "\n")
    count = lambda c: F.sum(c.cast("long"))
    is_flag, fraud = F.col("is_flag"), F.col("fraud")
    rows = ranked.groupBy(episode).agg(
        in_order(is_flag & (F.col("f") <= most_flags), flag).alias("flags"),
        in_order(F.col("r") <= most_steps, step).alias("steps"),
        F.count("*").alias("n"),
        count(is_flag).alias("flagged"),
        count(is_flag & fraud).alias("tp"),
        count(is_flag & ~fraud).alias("fp"),
        count(~is_flag & fraud).alias("fn"),
    )
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    parts = [
        F.concat(F.lit("[EPISODE id="), F.col(episode), F.lit("]")),
        F.when(F.col("flagged") > 0, F.concat(F.lit("\n[FLAGGED_TRANSACTIONS count="), "flagged", F.lit("]\n"), "flags")),
        F.concat(F.lit("\n[AGENT_ACTIONS count="), "n", F.lit("]\n"), "steps"),
        F.lit("\n[METRICS]"),
        *[F.concat(F.lit(f"{k}="), places(v, 3)) for k, v in (("precision", p), ("recall", r), ("f1", f1))],
        F.concat(F.lit("true_positives="), "tp"),
        F.concat(F.lit("false_positives="), "fp"),
    ]
    text = F.concat_ws("\n", *parts)
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    cut = F.concat(F.array_join(F.slice(words, 1, most_words), " "), F.lit("\n[TRUNCATED]"))
    return rows.select(episode, F.when(F.size(words) > most_words, cut).otherwise(text).alias("text"))


def median_low(values: Column) -> Column:
    """The lower of the two middle values."""
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) / 2).cast("int"))


def anomaly_pairwise(vectors: DataFrame, id: str, vector: str, blocks: int = 8) -> DataFrame:
    """(id, score): each vector's mean squared distance to all others, scaled to 0 to 1 over all.

    The sum over others follows from the sum of vectors and of squared norms, so nothing is compared in pairs:
    n |x|^2 + sum |y|^2 - 2 x . sum y.
    """
    x = F.col(vector).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rows = vectors.select(id, x.alias("x"), dot(x, x).alias("q"))
    sums = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda e: e["v"]).alias("s"))
    totals = rows.agg(F.count("*").alias("n"), F.sum("q").alias("t")).join(sums)  # one row
    each = rows.join(F.broadcast(totals)).select(id, ((F.col("n") * F.col("q") + F.col("t") - 2 * dot(F.col("x"), F.col("s"))) / F.greatest(F.col("n") - 1, F.lit(1))).alias("m"))
    ends = each.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    return each.join(F.broadcast(ends)).select(id, ((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)).alias("score"))


def exploration_rates(steps: DataFrame, episode: str, node: str, fraud_edge: Column, fraud_node: Column, flagged: Column | None = None) -> DataFrame:
    """Of each episode: edges walked and those of fraud, distinct nodes and those of fraud, their rates, and nodes an edge; with ``flagged``, precision, recall and F1 of flags on edges.

    Nodes are counted in two steps, first by (episode, node), so an episode of any length is reduced in map tasks. A node is one of fraud if any visit says so.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    flags = [one(flagged & fraud_edge).alias("tp"), one(flagged & ~fraud_edge).alias("fp"), one(~flagged & fraud_edge).alias("fn")] if flagged is not None else []
    by_node = steps.groupBy(episode, node).agg(F.count("*").alias("n"), one(fraud_edge).alias("hits"), F.max(fraud_node.cast("int")).alias("bad"), *flags)
    names = [f for f in ("tp", "fp", "fn") if flagged is not None]
    total = by_node.groupBy(episode).agg(F.sum("n").alias("edges"), F.sum("hits").alias("fraud_edges_found"), F.count(node).alias("unique_nodes_explored"), F.sum(F.when(F.col(node).isNotNull(), F.coalesce("bad", F.lit(0))).otherwise(0)).alias("fraud_nodes_visited"), *[F.sum(f).alias(f) for f in names])
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    out = total.select(
        episode,
        "fraud_edges_found",
        share("fraud_edges_found", "edges").alias("fraud_edge_discovery_rate"),
        "unique_nodes_explored",
        "fraud_nodes_visited",
        share("fraud_nodes_visited", "unique_nodes_explored").alias("fraud_node_rate"),
        share("unique_nodes_explored", "edges").alias("exploration_efficiency"),
        *names,
    )
    if flagged is None:
        return out
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return out.withColumns({"precision": p, "recall": r, "f1": 2 * p * r / F.greatest(p + r, F.lit(1e-8))}).drop(*names)


def coordination_stats(messages: DataFrame, episode: str, step: str, kind: str, proposals: str) -> DataFrame:
    """(episode, total_steps, messages, kinds, avg_proposals_per_step): what agents sent each other; steps are counted by (episode, step) first."""
    by_step = messages.groupBy(episode, step, kind).agg(F.count("*").alias("n"), F.sum(F.coalesce(proposals, F.lit(0))).alias("p"))
    by_kind = by_step.groupBy(episode, kind).agg(F.sum("n").alias("n"))
    kinds = by_kind.groupBy(episode).agg(F.array_sort(F.collect_list(F.concat_ws("=", kind, "n"))).alias("kinds"), F.sum("n").alias("messages"))
    each = by_step.groupBy(episode, step).agg(F.sum("p").alias("p")).groupBy(episode).agg(F.count("*").alias("total_steps"), F.avg("p").alias("avg_proposals_per_step"))
    return each.join(kinds, episode).select(episode, "total_steps", "messages", F.array_join("kinds", ",").alias("kinds"), "avg_proposals_per_step")


def banded(pairs: DataFrame, id: str, a: Column, b: Column, high: float, medium: float) -> DataFrame:
    """(id, band, weight): the cosine's band, and the distance over the largest one of all pairs (one row, broadcast); 0 where all are 0."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    c = cosine(a, b)
    rows = pairs.select(id, F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low").alias("band"), F.sqrt(squares).alias("d"))
    top = rows.agg(F.max("d").alias("top"))
    return rows.join(F.broadcast(top)).select(id, "band", F.when(F.col("top") > 0, F.col("d") / F.col("top")).otherwise(0.0).alias("weight"))


def traversal(edges: DataFrame, episode: str, at: str, pattern: str) -> DataFrame:
    """(episode, edges, traversal_velocity, temporal_diversity, patterns) of the edges that an episode walked, from their times and kinds.

    Velocity is edges over the span of their times, null where that is 0; diversity is the population deviation of the gaps between sorted
    times, null for a single edge; patterns is a map from kind to its number, without null kinds. Edges without an episode don't count, those without
    a time count for patterns only. Times are counted by (episode, time) before they are sorted.
    """
    known = edges.where(F.col(episode).isNotNull())
    timed = known.where(F.col(at).isNotNull())
    span = timed.groupBy(episode).agg((F.max(at) - F.min(at)).alias("__span"))
    gaps = features.gap_deviation(timed, episode, at).join(span, episode)
    timing = gaps.select(episode, F.col("n").alias("edges"), F.try_divide(F.col("n"), F.nullif(F.col("__span"), F.lit(0))).alias("traversal_velocity"), F.col("gap_std").alias("temporal_diversity"))
    kinds = known.groupBy(episode, pattern).agg(F.count("*").alias("n")).groupBy(episode)
    entry = F.when(F.col(pattern).isNotNull(), F.struct(pattern, "n"))
    return kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("patterns")).join(timing, episode, "left").select(episode, "edges", "traversal_velocity", "temporal_diversity", "patterns")

"""Classification, ranking and calibration metrics over (id, label, score) tables.

Cumulative metrics never sort all rows in one task: rows are first counted by distinct score
(combined in the map tasks), and running sums go over ranges of scores in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(df: DataFrame, order: str, *values: str, descending: bool = True, slices: int = 256) -> DataFrame:
    """``df`` (one row for each value of ``order``) with cum_<value>: sums up to and with the row.

    Rows are cut into slices of about equal numbers of rows, at approximate percentiles of the order; sums run within a
    slice, and the totals of earlier slices (a table of ``slices`` rows) are added. Exact whatever the slices hold.
    """
    shares = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    bounds = df.agg(F.array_distinct(F.percentile_approx(order, shares, F.lit(10_000))).alias("__bounds"))  # one row
    part = F.size(F.filter("__bounds", lambda b: b <= F.col(order)))
    cut = df.join(F.broadcast(bounds)).withColumn("__part", -part if descending else part).drop("__bounds")
    totals = cut.groupBy("__part").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__part", *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__b_{v}") for v in values])
    within = W.partitionBy("__part").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(F.broadcast(totals), "__part")
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(within) + F.col(f"__b_{v}"))
    return out.drop("__part", *[f"__b_{v}" for v in values])


def by_score(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) with running sums cum_pos and cum_neg, by falling score."""
    counts = scored.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return running_sums(counts, "score", "pos", "neg")


def confusion(scored: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    y, p = F.col(label) == 1, F.col(score) >= threshold
    count = lambda c: F.sum(c.cast("long"))
    return scored.agg(count(~y & ~p).alias("tn"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"), count(y & p).alias("tp"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def rates(c: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of confusion counts."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})


def per_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, precision, recall, f1, support) of every class that occurs as truth or guess."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array_distinct(F.array("t", "g"))).alias("class"), "t", "g", "n")
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    is_t, is_g = F.col("t") == F.col("class"), F.col("g") == F.col("class")
    c = sides.groupBy("class").agg(hit(is_t & is_g).alias("tp"), hit(~is_t & is_g).alias("fp"), hit(is_t & ~is_g).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Tie-aware area under the ROC curve from counts by score; null without rows of both labels."""
    c = by_score(scored)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    return c.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct thresholds of the step in recall times precision."""
    c = by_score(scored)
    return c.agg((F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / F.sum("pos")).alias("average_precision"))


def pr_auc_trapezoid(scored: DataFrame) -> DataFrame:
    """Trapezoid area under precision over recall, from the point (0, 1); null without positive rows."""
    c = by_score(scored).withColumn("precision", F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    before_pos, before_neg = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    before = F.when(before_pos + before_neg == 0, 1.0).otherwise(before_pos / (before_pos + before_neg))
    return c.agg(F.try_divide(F.sum(F.col("pos") * (F.col("precision") + before) / 2), F.sum("pos")).alias("pr_auc"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of highest score, ties by id; Spark keeps k rows a task."""
    return scored.orderBy(F.desc("score"), "id").limit(k)


def at_k(scored: DataFrame, ks: list[int]) -> DataFrame:
    """(k, tp, precision, recall, f1) at each budget; a budget beyond the table is the whole table."""
    top = top_k(scored, max(ks)).withColumn("r", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    totals = scored.agg(F.sum(F.col("label").cast("long")).alias("total"), F.count("*").alias("n"))
    budgets = scored.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hits = budgets.join(top, F.col("r") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("tp"))
    out = hits.join(F.broadcast(totals))
    p, r = ratio(F.col("tp"), F.least("k", "n")), ratio(F.col("tp"), F.col("total"))
    return out.select("k", "tp", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def recall_curve(scored: DataFrame, most: int) -> DataFrame:
    """(k, tp, recall) for each k up to ``most``."""
    top = top_k(scored, most).withColumn("k", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    totals = scored.agg(F.sum(F.col("label").cast("long")).alias("total"))
    tp = F.sum(F.col("label").cast("long")).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return top.withColumn("tp", tp).join(F.broadcast(totals)).select(F.col("k").cast("long").alias("k"), "tp", ratio(F.col("tp"), F.col("total")).alias("recall"))


def ndcg_at_k(scored: DataFrame, query: str, k: int) -> DataFrame:
    """(query, ndcg): gains 2^rel - 1, discounts log2(rank + 1), ideal order by label."""
    rank = lambda *o: F.row_number().over(W.partitionBy(query).orderBy(*o))
    gain = lambda r: F.when(F.col(r) <= k, (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col(r) + 1)).otherwise(0.0)
    ranked = scored.withColumn("r", rank(F.desc("score"), "id")).withColumn("i", rank(F.desc("label"), "id"))
    return ranked.groupBy(query).agg(ratio(F.sum(gain("r")), F.sum(gain("i"))).alias("ndcg"))


def mrr(scored: DataFrame, query: str) -> DataFrame:
    """(query, rr): 1 / rank of the first relevant row, 0 without one."""
    ranked = scored.withColumn("r", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), "id")))
    return ranked.groupBy(query).agg(F.coalesce(1 / F.min(F.when(F.col("label") == 1, F.col("r"))), F.lit(0.0)).alias("rr"))


def mean_average_precision(scored: DataFrame, query: str) -> DataFrame:
    """(query, ap) with relevance above one half; 0 without relevant rows."""
    order = W.partitionBy(query).orderBy(F.desc("score"), "id")
    relevant = (F.col("label") > 0.5).cast("long")
    ranked = scored.withColumn("r", F.row_number().over(order)).withColumn("rel", relevant).withColumn("hits", F.sum("rel").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.groupBy(query).agg(ratio(F.sum(F.col("rel") * F.col("hits") / F.col("r")), F.sum("rel")).alias("ap"))


def threshold_curve(scored: DataFrame, points: int = 100) -> DataFrame:
    """(threshold, tp, fp, precision, recall, f1) at evenly spaced thresholds from 0 to 1: rows are counted once by threshold bucket."""
    grid = scored.sparkSession.range(points).select(F.col("id").alias("bucket"), (F.col("id") / (points - 1)).alias("threshold"))
    bucket = F.floor(F.col("score") * (points - 1)).cast("long")
    # A score that lies below its bucket's threshold by rounding belongs to the one before.
    exact = F.when(F.col("score") >= bucket / (points - 1), bucket).otherwise(bucket - 1)
    exact = F.when(F.col("score") >= (exact + 1) / (points - 1), exact + 1).otherwise(exact)
    counts = scored.groupBy(exact.alias("b")).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))
    totals = scored.agg(F.sum(F.col("label").cast("long")).alias("total"))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = grid.join(F.broadcast(counts), F.col("b") >= F.col("bucket"), "left").groupBy("bucket", "threshold").agg(some("pos").alias("tp"), some("neg").alias("fp")).join(F.broadcast(totals))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("total"))
    return out.select("bucket", "threshold", "tp", "fp", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def optimal_threshold(scored: DataFrame, metric: str = "f1", least_recall: float = 0.0) -> DataFrame:
    """(threshold, value): the score that, as threshold, has the best metric; the lowest of equals."""
    c = by_score(scored)
    totals = c.agg(F.sum("pos").alias("total"))
    p, r = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), ratio(F.col("cum_pos"), F.col("total"))
    c = c.join(F.broadcast(totals)).select("score", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")).where(F.col("recall") >= least_recall)
    best = c.agg(F.min(F.struct((-F.round(metric, 12)).alias("m"), "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), (-F.col("b.m")).alias("value"))


def calibration_bins(scored: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, confidence, accuracy) of the bins of equal width that have rows; the last is closed on the right."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("label").cast("double")).alias("accuracy"))


def calibration_errors(scored: DataFrame, bins: int = 15) -> DataFrame:
    """(ece, mce)."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return calibration_bins(scored, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier(scored: DataFrame, bins: int = 15) -> DataFrame:
    """(brier, reliability, resolution, uncertainty)."""
    whole = scored.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"), F.avg(F.col("label").cast("double")).alias("base"))
    c = calibration_bins(scored, bins).join(F.broadcast(whole))
    mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    return c.agg(
        F.first("brier").alias("brier"),
        mean(F.pow(F.col("confidence") - F.col("accuracy"), 2)).alias("reliability"),
        mean(F.pow(F.col("accuracy") - F.col("base"), 2)).alias("resolution"),
        F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )


def confidence_errors(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Overconfidence: mean confidence less accuracy of confident guesses; underconfidence: accuracy less confidence of the others (0 at least)."""
    guess = (F.col("score") >= 0.5).cast("int")
    confidence, right = F.greatest("score", 1 - F.col("score")), (guess == F.col("label")).cast("double")
    sure = confidence >= threshold
    mean = lambda x, c: F.coalesce(F.avg(F.when(c, x)), F.lit(0.0))
    return scored.agg(
        F.greatest(F.lit(0.0), mean(confidence, sure) - mean(right, sure)).alias("overconfidence"), F.greatest(F.lit(0.0), mean(right, ~sure) - mean(confidence, ~sure)).alias("underconfidence")
    )


def marginal_ece(scored: DataFrame, bins: int = 15) -> DataFrame:
    """(ece): the mean over classes of their errors one against all, from (truth, probs)."""
    return classwise(scored, bins).agg(F.avg("ece").alias("ece"))


def binary_nll(t: float) -> Column:
    """Negative log likelihood of a row (logit, label) at a temperature."""
    z = F.col("logit") / t
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col("label")


def softmax_nll(t: float) -> Column:
    """Negative log likelihood of a row (logits, label) of several classes, or of a token of a vocabulary, at a temperature."""
    z = F.transform("logits", lambda x: x / t)
    top = F.array_max(z)
    whole = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.log(whole) + top - F.get(z, F.col("label"))


def best_temperature(logits: DataFrame, nll=binary_nll, *, low: float = 0.05, high: float = 10.0, passes: int = 5, points: int = 21) -> DataFrame:
    """(temperature, nll): where the mean negative log likelihood is least; one row, of nulls without rows.

    Each pass over the rows takes ``points`` temperatures between two bounds at once; the next one takes the range between the
    neighbours of the best. The likelihood has one minimum over the temperature, so it is never left behind. A float goes to the driver a point.
    """
    spark, best = logits.sparkSession, (None, None)
    for _ in range(passes):
        step = (high - low) / (points - 1)
        at = [low + k * step for k in range(points)]
        row = logits.agg(*[F.avg(nll(t)).alias(f"t{k}") for k, t in enumerate(at)]).first()
        if row[0] is None:
            break
        k = min(range(points), key=lambda k: row[k])
        best = (at[k], row[k])
        low, high = at[max(k - 1, 0)], at[min(k + 1, points - 1)]
    return spark.createDataFrame([best], "temperature double, nll double")


def temperature_grid(logits: DataFrame, temperatures: list[float]) -> DataFrame:
    """(temperature, nll): mean negative log likelihood at each temperature, in one pass over (logit, label)."""
    row = logits.agg(*[F.avg(binary_nll(t)).alias(str(k)) for k, t in enumerate(temperatures)])
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"`{k}`").alias("nll")) for k, t in enumerate(temperatures)])
    return row.select(F.inline(pairs))


def quantile_calibration(scored: DataFrame, bins: int = 15) -> DataFrame:
    """(ece, mce) with bins of equal numbers of rows: edges are the scores' percentiles, found from counts by score; the last bin is closed on the right."""
    shares = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    edges = scored.agg(F.percentile("score", shares).alias("__e"))  # one row
    s = F.col("score")
    inner = F.filter(F.slice("__e", 2, bins - 1), lambda e: e <= s)
    binned = scored.join(F.broadcast(edges)).withColumn("bin", F.size(inner))
    bin_stats = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("label").cast("double")).alias("accuracy"))
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return bin_stats.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def classwise(scored: DataFrame, bins: int = 15) -> DataFrame:
    """(class, ece, brier) one against all, from (truth, probs): a row's probabilities are unpacked, one class each."""
    each = scored.select("truth", F.posexplode("probs").alias("class", "score")).withColumn("label", (F.col("truth") == F.col("class")).cast("int"))
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    by_bin = each.groupBy("class", b.alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("label").alias("y"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("q"))
    return by_bin.groupBy("class").agg((F.sum(F.abs(F.col("y") - F.col("s"))) / F.sum("n")).alias("ece"), (F.sum("q") / F.sum("n")).alias("brier"))


def top_label(scored: DataFrame) -> DataFrame:
    """(id, label, score): confidence of the most probable class (the first of equals), and whether it is the true one."""
    top = F.array_max("probs")
    return scored.select("id", (F.array_position("probs", top) - 1 == F.col("truth")).cast("int").alias("label"), top.alias("score"))

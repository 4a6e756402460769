"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model on hashed words is fitted in numpy from confirmed toxic texts and unlabelled
ones. The risk of a labelled negative class is estimated from the unlabelled texts minus the
share that the class prior says is toxic; where that estimate falls below zero, the step goes the
other way (non-negative correction), so that the model can't win by calling the confirmed
texts all there is. Labels only say which texts are confirmed: a label 0 is not used. The class
prior is estimated from how much rarer high scores are among unlabelled texts than among
confirmed ones. The fit takes a bounded sample (``most_rows``); scoring is a narrow map over whole
texts, with the weights broadcast (a fixed size).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import forget, slices, utf8, written
from ledgerloom.llm.words import ALNUM, word_bounds, word_hashes

DIMENSIONS = 1 << 19
#: Bytes of a word that stand for its stem.
STEM = 5


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: Steps of the fit in which the estimated risk of the negative class was below zero, and was corrected.
    corrections: int = 0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return _sigmoid(margin + self.bias)


def feature_sets(raw: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS):
    """For each row, its distinct hashed words (A-Z as a-z; digits, letters and what is beyond ASCII) and first bytes of
    words, which inflected forms of a word share."""
    starts, ends, first = word_bounds(raw, offsets, ALNUM)
    half = np.uint64(dimensions // 2 - 1)
    whole = (word_hashes(raw, starts, ends) & half).astype(np.int32)
    stem = (word_hashes(raw, starts, np.minimum(ends, starts + STEM)) & half).astype(np.int32) + dimensions // 2
    at = np.stack([whole, stem], 1).ravel()
    first = 2 * first
    for i in range(len(offsets) - 1):
        yield np.unique(at[first[i] : first[i + 1]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(values: np.ndarray, sizes: np.ndarray, positive: np.ndarray, prior: float, unlabelled: np.ndarray | None = None, *, dimensions: int = DIMENSIONS, steps: int = 200, rate: float = 0.1, shrink: float = 2e-4, least: int = 3, lift: float = 1.2) -> Model:
    """Non-negative PU fit: ``positive`` marks confirmed rows, ``unlabelled`` the rows of the unlabelled sample (if not given, all).

    ``values`` holds the features of all rows end to end, ``sizes`` how many each row has. A word
    takes part if ``least`` confirmed rows or more have it, at a rate of ``lift`` times that of the
    unlabelled rows. An L1 penalty of ``shrink`` chooses among them; a second pass without it, over the chosen
    words alone, undoes what the penalty took from their weights. Without confirmed rows all
    scores are near 0.
    """
    weights = np.zeros(dimensions)
    unlabelled = np.ones(len(sizes), bool) if unlabelled is None else unlabelled
    if not positive.any() or not unlabelled.any():
        return Model(weights, -40.0)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    seen = np.bincount(values[unlabelled[row]], minlength=dimensions)
    in_p = np.bincount(values[positive[row]], minlength=dimensions)
    useful = (in_p >= least) & (in_p * int(unlabelled.sum()) > lift * seen * int(positive.sum()))
    keep = useful[values]
    index, row = values[keep], row[keep].astype(np.int64)
    bias = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    corrections = 0
    for penalty in (shrink, 0.0):
        words, at = np.unique(index, return_inverse=True)
        found, bias, corrected = _descend(weights[words], bias, at, row, positive, unlabelled, prior, steps, rate, penalty)
        corrections += corrected
        weights = np.zeros(dimensions)
        weights[words] = found
        keep = weights[index] != 0
        index, row = index[keep], row[keep]
    return Model(weights, bias, corrections)


def risks(margin: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positive class's part of the risk, the estimate of the negative class's, and the slope of the step to take.

    With logistic loss l: prior * mean of l(+) over confirmed rows; mean of l(-) over unlabelled rows minus
    prior * mean of l(-) over confirmed rows. The slope (with respect to each row's margin) is that of their
    sum where the second is not negative, and else the second's, turned round.
    """
    p, n_p, n_u = _sigmoid(margin), int(positive.sum()), int(unlabelled.sum())
    loss_n = np.logaddexp(0, margin)  # of calling a row negative; that of calling it positive is less by the margin
    positive_risk = prior * (loss_n - margin)[positive].mean()
    negative_risk = loss_n[unlabelled].mean() - prior * loss_n[positive].mean()
    as_positive = np.where(positive, -(1 - p) * prior / n_p, 0.0)
    as_negative = np.where(unlabelled, p / n_u, 0.0) - np.where(positive, p * prior / n_p, 0.0)
    return positive_risk, negative_risk, as_positive + as_negative if negative_risk >= 0 else -as_negative


def _descend(weights: np.ndarray, bias: float, index: np.ndarray, row: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, rate: float, shrink: float) -> tuple[np.ndarray, float, int]:
    """Adam on the non-negative PU risk with logistic loss, then a proximal step for the L1 penalty; and how many steps were corrected."""
    n, size, corrections = len(positive), len(weights), 0
    m, v, bias_m, bias_v = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        _, negative_risk, slope = risks(np.bincount(row, weights[index], n) + bias, positive, unlabelled, prior)
        corrections += negative_risk < 0
        gradient = np.bincount(index, slope[row], size)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        pace = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        weights = weights - pace * m / (1 - 0.9**t)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * shrink, 0)
        g = slope.sum()
        bias_m, bias_v = 0.9 * bias_m + 0.1 * g, 0.99 * bias_v + 0.01 * g * g
        bias -= rate * (bias_m / (1 - 0.9**t)) / (np.sqrt(bias_v / (1 - 0.99**t)) + 1e-6)
    return weights, bias, corrections


def margins(rows, model: Model) -> np.ndarray:
    return np.array([model.weights[r].sum() for r in rows]) if len(rows) else np.zeros(0)


def class_prior(values: np.ndarray, sizes: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, *, dimensions: int = DIMENSIONS, guess: float = 0.1, most: float = 0.5, least_rows: int = 50) -> float:
    """Share of toxic rows in the unlabelled sample, from confirmed and unlabelled rows alone (best bin estimation).

    A model fitted on one half of the rows scores the other, and the other way round. Of the rows that score
    at least c, the unlabelled share over the confirmed share bounds the prior from above, whatever the model;
    the c is taken where that bound with its sampling error is least, and the lower bound of the two halves. Rows
    are halved by their features, so equal texts are in one half. ``guess`` serves these models, and is the
    answer where a half has fewer than ``least_rows`` confirmed rows, which say too little.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    half = np.bincount(row, values, len(sizes)).astype(np.int64) % 2 == 1
    bounds = []
    for own in (half, ~half):
        model = fit(values[own[row]], sizes[own], positive[own], guess, unlabelled[own], dimensions=dimensions)
        score = np.bincount(row, model.weights[values], len(sizes))
        p, u = np.sort(score[positive & ~own]), np.sort(score[unlabelled & ~own])
        if len(p) < least_rows or not len(u):
            return guess
        c = np.unique(p)
        q_p, q_u = 1 - np.searchsorted(p, c) / len(p), 1 - np.searchsorted(u, c) / len(u)
        error = 1.01 * (np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u)))
        best = ((q_u + error) / q_p).argmin()
        bounds.append(float(np.clip(q_u[best] / q_p[best], 1 / len(u), most)))
    return min(bounds)


def sample(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 20_000, fold: int = 3, left_out: int = 1) -> DataFrame:
    """(features, positive, unlabelled) of documents outside the left-out fold: at most ``most_rows`` / 2 confirmed ids, those with
    the least hash, and about as many documents by another hash, whether they have labels or not; a document may be both.

    A document with several labels counts as toxic if one of them says so; other labels, and those of
    no document, take no part. Of several documents with one id, each is taken.
    """
    inside = fold_of(F.col(id), fold) != left_out
    confirmed = labels.where(F.col(id).isNotNull() & (F.col(label) == 1) & inside)
    picked = confirmed.select(F.col(id).alias("of")).distinct().orderBy(F.xxhash64("of"), "of").limit(most_rows // 2).withColumn("positive", F.lit(True))
    share = most_rows / 2 / max(docs.where(inside).count(), 1)
    drawn = F.pmod(F.xxhash64(F.col(id), F.lit("unlabelled")), F.lit(1 << 30)) < int(min(share, 1) * (1 << 30))
    # Bounded by most_rows, whatever the corpus; its size in bytes is 16 a row.
    rows = docs.where(inside).select(F.col(id).alias("of"), F.col(text).alias("text"), drawn.alias("unlabelled")).join(F.broadcast(picked), "of", "left")
    rows = rows.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), "unlabelled").where("positive OR unlabelled")
    schema = pa.schema([("features", pa.list_(pa.int32())), ("positive", pa.bool_()), ("unlabelled", pa.bool_())])

    def run(batches):
        forget()
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            found = []
            for i, j in slices(offsets):
                found += feature_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([pa.array(found, schema[0].type), batch.column(1), batch.column(2)], schema=schema)

    return rows.mapInArrow(run, "features array<int>, positive boolean, unlabelled boolean")


def fold_of(id: Column, fold: int = 3) -> Column:
    return F.crc32(id.cast("string")) % fold


def train(docs: DataFrame, labels: DataFrame, *, most_features: int = 16_000_000, least: int = 3, **options: object) -> Model:
    """Fit on the driver from the bounded sample, with the prior that ``class_prior`` finds in it.

    The sample is written once. Of its rows, only features that ``least`` confirmed rows or more hold go to the
    driver: no fit uses others. They are counted first. Where there are more than ``most_features`` (4 bytes each), confirmed and
    other rows have half of them each (or what the others leave), and so much smaller a share of the rows is taken, by a hash of their
    features. A ValueError says so where that leaves no confirmed or no unlabelled row. Without features that ``least`` confirmed
    rows hold (so without confirmed rows) the model has no weights, and all scores are near 0.
    """
    rows = written(sample(docs, labels, **options), "sample")
    counts = rows.where("positive").select(F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # At most DIMENSIONS numbers.
    known = np.zeros(DIMENSIONS, bool)
    known[[r.f for r in counts.select("f").collect()]] = True
    if not known.any():
        return Model(np.zeros(DIMENSIONS), -40.0)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(known))

    def run(batches):
        held = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            kept = [x[held[x]] for x in (features.values.to_numpy() for features in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["features", "positive", "unlabelled"])

    rows = written(rows.mapInArrow(run, "features array<int>, positive boolean, unlabelled boolean"), "features")
    sizes = rows.agg(F.coalesce(F.sum(F.when(F.col("positive"), F.size("features"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(~F.col("positive"), F.size("features"))), F.lit(1)).alias("u")).first()
    part = lambda own, other: min(1.0, max(most_features / 2, most_features - other) / max(own, 1))
    of_confirmed, of_others = part(sizes.p, sizes.u), part(sizes.u, sizes.p)
    if of_confirmed < 1 or of_others < 1:
        share = F.when(F.col("positive"), int(of_confirmed * (1 << 30))).otherwise(int(of_others * (1 << 30)))
        rows = rows.where(F.pmod(F.xxhash64("features"), F.lit(1 << 30)) < share)
    table = rows.toArrow()
    lists, positive, unlabelled = table.column(0).combine_chunks(), table.column(1).to_numpy().astype(bool), table.column(2).to_numpy().astype(bool)
    del table
    if not positive.any() or not unlabelled.any():
        raise ValueError(f"of the sample, {positive.sum()} confirmed and {unlabelled.sum()} unlabelled rows are left: most_features ({most_features}) is too small")
    values, sizes = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy()
    return fit(values, sizes, positive, class_prior(values, sizes, positive, unlabelled), unlabelled, least=least)


def scored(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a double column ``into`` from 0 to 1 (which must be a new name).

    Null and empty texts have the score of the bias alone. Equal texts have equal scores. All
    columns of ``docs`` are kept.
    """
    if into in docs.columns:
        raise ValueError(f"docs already has a column {into}")
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights).astype(np.int32), model.weights[model.weights != 0], model.bias, len(model.weights)))
    kept = docs.columns

    def run(batches):
        forget()
        at, found, bias, size = shared.value
        weights = np.zeros(size)
        weights[at] = found
        here = Model(weights, bias)
        for batch in batches:
            raw, offsets = utf8(batch.column(batch.schema.names.index(text)))
            scores = []
            for i, j in slices(offsets):
                scores.append(here.probability(margins(list(feature_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)), here)))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*kept, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))

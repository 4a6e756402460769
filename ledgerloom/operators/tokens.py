"""Sequences of token ids: windows, packs, and what a language model's training step makes of them.

Draws come from digests of (key, position, seed), so a row's masks do not depend on how rows are dealt out.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.session import short_batches

# Ids of padding, separator and mask, the label that is left out of a loss; ids below FIRST are special.
PAD, SEP, MASK, FIRST, IGNORED = 0, 2, 4, 5, -100


def windows(df: DataFrame, ids: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """``df`` without ``ids``, a row for each window: chunk_index, total_chunks, chunk. Up to ``size`` ids are one window."""
    n = F.size(ids)
    rows = df.withColumn("__starts", T.chunk_starts(n, size, overlap)).withColumn("total_chunks", F.size("__starts"))
    rows = rows.select("*", F.posexplode("__starts").alias("chunk_index", "__at"))
    return rows.withColumn("chunk", F.slice(ids, F.col("__at") + 1, size)).drop("__starts", "__at", ids)


def packed(df: DataFrame, pack: list[str], order: str, ids: str, size: int = 512) -> DataFrame:
    """(pack, input_ids, attention_mask): documents in order with a separator between, cut to ``size``, padded.

    Of a document only what a pack can hold is gathered; a pack's documents are few, as each takes a place at least.
    """
    short = df.select(*pack, order, F.slice(ids, 1, size).alias("__ids"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "__ids"))), lambda x: x["__ids"])
    joined = F.flatten(F.transform("__parts", lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(SEP)), x)).otherwise(x)))
    rows = short.groupBy(*pack).agg(parts.alias("__parts")).withColumn("__all", F.slice(joined, 1, size))
    room = F.lit(size) - F.size("__all")
    return rows.select(*pack, F.concat("__all", F.array_repeat(F.lit(PAD), room)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size("__all")), F.array_repeat(F.lit(0), room)).alias("attention_mask"))


def draw(key: Column, position: Column, seed: str) -> Column:
    """A number in [0, 1) from a digest: eight hexadecimal digits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, position)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def masked_lm(ids: Column, key: Column, vocabulary: int, share: float = 0.15) -> tuple[Column, Column]:
    """(input_ids, labels): a ``share`` of ordinary ids is masked; of those 80 % become the mask, 10 % another id, the rest stay. Labels of the others are ignored."""
    chosen = lambda x, i: (x >= FIRST) & (draw(key, i, "m") < share)
    other = lambda i: F.floor(draw(key, i, "t") * vocabulary).cast("int")
    put = lambda x, i: F.when(~chosen(x, i), x).when(draw(key, i, "r") < 0.8, F.lit(MASK)).when(draw(key, i, "r") < 0.9, other(i)).otherwise(x)
    return F.transform(ids, put), F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(IGNORED)))


def whole_words(df: DataFrame, ids: str, words: str, key: str, share: float = 0.15) -> DataFrame:
    """``df`` with input_ids and labels: max(1, int(words * share)) whole words, those of the least draws, are masked; ``words`` has each id's word number, null for special ids."""
    # A draw as text: eight hexadecimal digits of a digest, then the word's number in sixteen, so that strings sort as (draw, number) and hash as one value.
    drawn = lambda w: F.concat(F.substring(F.md5(F.concat_ws(":", F.lit("w"), F.col(key), w)), 1, 8), F.hex(w.cast("bigint") + (1 << 62)))
    df = df.withColumn("__drawn", F.transform(words, lambda w: F.when(w.isNotNull(), drawn(w))))  # once for each id
    draws = F.sort_array(F.array_distinct(F.filter("__drawn", lambda d: d.isNotNull())))
    count = F.greatest(F.lit(1), F.floor(F.size(draws) * share).cast("int"))
    last = F.try_element_at(draws, F.least(count, F.greatest(F.size(draws), F.lit(1))))
    # The last draw that counts is found once a row and laid beside each id: inside a lambda it would be found anew each time.
    masked = F.zip_with("__drawn", F.array_repeat(last, F.size("__drawn")), lambda d, c: F.coalesce(d <= c, F.lit(False)))
    rows = df.withColumn("__masked", masked)
    put = F.zip_with(ids, "__masked", lambda x, m: F.when(m, F.lit(MASK)).otherwise(x))
    keep = F.zip_with(ids, "__masked", lambda x, m: F.when(m, x).otherwise(F.lit(IGNORED)))
    return rows.withColumn("input_ids", put).withColumn("labels", keep).drop("__masked", "__drawn")


def causal_lm(ids: Column) -> Column:
    """Labels of a causal model: the ids themselves, padding ignored."""
    return F.transform(ids, lambda x: F.when(x == PAD, F.lit(IGNORED)).otherwise(x))


def _spans(n: int, valid: list[int], share: float, mean: float, most: int, rng) -> list[tuple[int, int]]:
    """Spans of valid positions until ``share`` of them is covered; lengths are geometric with a cap, starts not taken before."""
    wanted, taken, spans, left = max(1, int(len(valid) * share)), set(), [], list(valid)
    allowed = set(valid)
    while len(taken) < wanted and left:
        start = left.pop(int(rng.integers(len(left))))
        length = min(int(rng.geometric(1 / mean)), most)
        new = [p for p in range(start, min(start + length, n)) if p in allowed and p not in taken][: wanted - len(taken)]
        taken.update(new)
    run: list[int] = []
    for p in sorted(taken):
        if run and p != run[-1] + 1:
            spans.append((run[0], run[-1] + 1))
            run = []
        run.append(p)
    return [*spans, (run[0], run[-1] + 1)] if run else spans


def span_batches(df: DataFrame, ids: str, key: str, vocabulary: int, *, share: float = 0.15, mean: float = 3.0, most: int = 10, sentinels: bool = False) -> DataFrame:
    """``df`` without ``ids``, with input_ids and labels: spans of ids are masked (80 % mask, 10 % another id, the rest stay).

    With ``sentinels`` each span is one id from the vocabulary's end downwards, and the labels are, for each,
    that id and the span's ids, then one more such id. Spans depend on what was drawn before, so a row is
    folded in Python, in Arrow batches; its generator is seeded by its key.
    """
    import numpy as np

    names = [c for c in df.columns if c != ids]

    def run(batches):
        for pdf in batches:
            inputs, labels = [], []
            for k, row in zip(pdf[key], pdf[ids], strict=True):
                row = [int(x) for x in row]
                rng = np.random.default_rng(zlib.crc32(str(k).encode()))
                spans = _spans(len(row), [i for i, x in enumerate(row) if x >= FIRST], share, mean, most, rng) if any(x >= FIRST for x in row) else []
                if sentinels:
                    given, wanted, at = [], [], 0
                    for j, (a, b) in enumerate(spans):
                        given += [*row[at:a], vocabulary - 1 - j]
                        wanted += [vocabulary - 1 - j, *row[a:b]]
                        at = b
                    inputs.append([*given, *row[at:]])
                    labels.append([*wanted, vocabulary - 1 - len(spans)])
                    continue
                given, wanted = list(row), [IGNORED] * len(row)
                for a, b in spans:
                    for p in range(a, b):
                        wanted[p], u = row[p], rng.random()
                        given[p] = MASK if u < 0.8 else int(rng.integers(vocabulary)) if u < 0.9 else row[p]
                inputs.append(given)
                labels.append(wanted)
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame({"input_ids": pd.Series(inputs, dtype=object), "labels": pd.Series(labels, dtype=object)})], axis=1)

    short_batches(df.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*names).dtypes)
    return df.mapInPandas(run, f"{schema}, input_ids array<int>, labels array<int>")

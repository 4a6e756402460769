"""Runs of characters of whole texts, as digests, in numpy on code points."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import short_batches


def distinct_runs(text: str, k: int = 5) -> np.ndarray:
    """Code points (rows of k) of a text's distinct runs of k characters, in order; the text has k characters or more.

    Characters are numbered in order, so a run is one number where k of these fit into 64 bits, else a few, compared one after the other.
    """
    known, at = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
    n, bits = len(at) - k + 1, max(1, int(len(known) - 1).bit_length())
    each = 64 // bits
    words = []
    for first in range(0, k, each):
        word = np.zeros(n, np.uint64)
        for i in range(first, min(k, first + each)):
            word = (word << np.uint64(bits)) | at[i : i + n].astype(np.uint64)
        words.append(word)
    if len(words) == 1:
        starts = np.unique(words[0], return_index=True)[1]
    else:
        order = np.lexsort(words[::-1])
        new = np.ones(n, bool)
        new[1:] = np.any([w[order][1:] != w[order][:-1] for w in words], axis=0)
        starts = order[new]
    return known[at[starts[:, None] + np.arange(k)]]


def digest(text: str, k: int = 5) -> tuple[int, str]:
    """Number of a text's distinct runs, and the MD5 of these in order, joined by a character 0; a shorter text is its own."""
    if len(text) < k:
        return 1, hashlib.md5(text.encode()).hexdigest()
    runs = distinct_runs(text, k)
    joined = np.zeros((len(runs), k + 1), "<u4")
    joined[:, :k] = runs
    return len(runs), hashlib.md5(joined.tobytes()[:-4].decode("utf-32-le").encode()).hexdigest()


def digests(df: DataFrame, id: str, text: str, k: int = 5) -> DataFrame:
    """(id, n, h) of each row whose text is not null. Batches are of few rows, as texts are long."""
    short_batches(df.sparkSession)
    schema = f"{id} {df.schema[id].dataType.simpleString()}, n int, h string"

    def run(batches):
        for batch in batches:
            found = [digest(t, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([h for _, h in found], pa.string())], names=[id, "n", "h"])

    return df.select(id, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)

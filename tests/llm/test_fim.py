"""Fill-in-the-middle: the whole-batch kernel against plain loops over code points."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fim
from ledgerloom.llm.shared import utf8

PIECES = ["a", "Z", "9", " ", "\n", "\t", "é", "ß", "漢", "😀", "<", "P", ">", "<P>", "<S", "M>", "_", "."]
UNIT = {"char": r"(?s).", "word": r"[ \t\n\v\f\r]+|[0-9A-Za-z\u0080-\U0010ffff]+|[\x00-\x7f]", "line": r"(?s)[^\n]*\n|[^\n]+"}


def by_hand(text, key, unit="char"):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_equals_a_loop(spark, unit):
    rng = random.Random(4)
    rows = [(k // 2, "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 2, 5, 40])))) for k in range(400)] + [(None, "abc def"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("output", F.lit("x")).withColumn("form", F.lit("y")).withColumn("restored", F.lit("z"))
    got = fim.restored(fim.transform(docs, unit=unit)).collect()
    want = [(key, *by_hand(text, key, unit), text or "") for key, text in rows]
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rows_of_a_slice_are_cut_like_rows_of_their_own():
    texts = ["", "é😀", None, "abc", "", "漢字" * 50, ""]
    whole = pa.array(["zz", *texts, "yy"]).slice(1, len(texts))
    draws = np.array([[5, 1, 3, 2, 8, 77, 0], [9, 2, 1, 3, 1, 30, 0]], np.int64)
    n, chosen, at = fim.cuts(*utf8(whole), draws)
    start = 0
    for k, t in enumerate(texts):
        t = t or ""
        assert n[k] == len(t)
        assert [start + len(t[:c].encode()) for c in chosen[:, k]] == at[:, k].tolist()
        start += len(t.encode())


def test_cuts_that_would_build_a_mark_are_told_apart(spark):
    """A prefix may end in what starts a mark; the text is still rebuilt."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("<P<S<M<>P>S>M><").alias("text"))
    rows = fim.restored(fim.transform(docs)).collect()
    assert {r.restored for r in rows} == {"<P<S<M<>P>S>M><"} and sum(r.form != "plain" for r in rows) > 200


def test_a_very_long_text_and_an_empty_table(spark):
    text = "é😀x" * 700_000
    got = fim.restored(fim.transform(spark.createDataFrame([(3, text)], "doc_id bigint, text string"))).first()
    assert tuple(got)[1:5] == by_hand(text, 3)[:4] and got.output == by_hand(text, 3)[4] and got.restored == text
    assert fim.restored(fim.transform(spark.createDataFrame([], "doc_id bigint, text string"))).collect() == []


def test_marks_must_not_overlap_and_damage_is_reported():
    with pytest.raises(ValueError, match="overlap"):
        fim.Marks("<P<", "<S>", "<M>")
    with pytest.raises(ValueError, match="different"):
        fim.Marks("<P>", "<P>", "<M>")
    with pytest.raises(ValueError, match="once"):
        fim.rebuilt(*utf8(pa.array(["<P>a<S>b"])), np.array(["psm"], object), fim.Marks())

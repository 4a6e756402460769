"""The corpus pipeline, stage by stage, against brute force on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import queries, sentencepieces
from tests.llm.test_operators import brute_components, brute_hits, brute_pii


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").limit(150)
    schema = docs.schema
    names = [n for n, _ in corpus_pipeline.STAGES]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas())
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name != names[-1]:
            assert docs.columns == schema.names
        out[name] = before, after
    before, after = out[names[0]]
    scores = {r.doc_id: r.score for r in queries.op4_toxicity(spark, sf_dir).collect()}
    assert set(after) == {i for i in before if scores[i] < corpus_pipeline.TOXIC}
    before, after = out[names[1]]
    by = brute_components([(i, r.text) for i, r in before.items()])
    assert set(after) == {c if n else i for i, (n, c) in by.items()}
    assert all(after[i] == before[i] for i in after)
    before, after = out[names[2]]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    for i, r in before.items():
        n, hit, _ = brute_hits(r.text, items)
        assert (i not in after) == (hit > 0 and 20 * hit >= n)
    before, after = out[names[3]]
    assert set(before) == set(after)
    assert all(not brute_pii(r.text) and r.n_chars == len(r.text) for r in after.values())
    before, after = out[names[4]]
    with open("/opt/tokenizers/piece_bpe_32k.model", "rb") as f:
        processor = sentencepieces.Pieces(f.read()).processor
    assert set(before) == set(after)
    assert all(list(after[i].ids) == processor.encode(r.text) for i, r in before.items())


def test_stages_of_awkward_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, repeated rows, more columns of clashing names, and an empty table, through every stage."""
    docs = queries.table(spark, sf_dir, "documents")
    words = " ".join(f"word{k % 977} other{k % 1009}" for k in range(40_000))
    schema = docs.schema.simpleString()[7:-1].replace(":", " ")
    rows = [
        (900_001, None, "en", "src0", None),
        (900_002, "", None, None, 0),
        (900_003, words, "en", "src0", len(words)),
        (900_004, "short one a@b.co", "en", "src1", 16),
        (900_004, "short one a@b.co", "en", "src1", 16),
        (None, "no id here at all, but ten words of text stand", None, None, 1),
        (None, None, None, None, None),
    ]
    names = docs.columns
    order = ["doc_id", "text", "lang", "source", "n_chars"]
    given = spark.createDataFrame([tuple(r[order.index(c)] for c in names) for r in rows], schema)
    clashing = ["__score", "__content", "__id", "__contamination", "content", "class", "key", "spans", "score", "blob", "__gone", "__gone_content", "__again", "__blob", "__found", "__positive", "__pii_spans", "__pii_of", "__spans", "__of", "__other_id", "of", "positive"]
    for c in clashing:
        given = given.withColumn(c, F.lit(c))
    left = {"toxicity": 7, "n-gram Jaccard join": 6, "benchmark decontamination": 6, "PII": 6, "SentencePiece encoding and decoding": 6}
    for (name, stage), empty in zip(corpus_pipeline.STAGES, [given.limit(0)] * 5, strict=True):
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, given, sf_dir)
        given = spark.createDataFrame(out.collect(), out.schema)
        assert given.count() == left[name]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert given.columns == [*names, *clashing]
            assert given.where(" or ".join(f"{c} <> '{c}'" for c in clashing)).count() == 0

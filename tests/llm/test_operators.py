"""Text operators: SQL twins, brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, components, decontaminate, jaccard, licenses, media, pii, queries, secrets, sentencepieces, tokencount, toxicity
from ledgerloom.llm.shared import hot_keys, split_join, written

TOKENIZERS = "/opt/tokenizers"
#: Nulls, empty texts, repeated rows, ties, columns with clashing names.
EDGES = [
    (1, None, "x"),
    (2, "", "x"),
    (3, " \n\t ", None),
    (3, " \n\t ", None),
    (None, "password = abcdef0123456789abcdef and a@b.co", "x"),
    (4, "password = abcdef0123456789abcdef and a@b.co", "x"),
    (5, "The é 😀 ▁ end. " * 3, "x"),
]
SCHEMA = "doc_id bigint, text string, id string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).withColumn("label", F.lit(1)).withColumn("content", F.lit("c")).withColumn("blob", F.lit("b")).withColumn("digest", F.lit("d"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(name, spark, sf_dir, duck, same):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLES[name]).df())


# 1: decontamination


def brute_hits(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        x = words(t)
        k = min(window, len(x))
        for j in range(len(x) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == x[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("a b c d é".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 5, 6, 9])))) for i in range(12)] + [(99, None)]
    texts = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(60)] + [(100, None), (100, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    for words_each in (10_000, 12):  # one automaton, and one after another
        got = decontaminate.find(docs, bench, window=5, words_each=words_each).select("doc_id", "contamination.*", decontaminate.n_hit().alias("n_hit")).collect()
        want = sorted((i, *brute_hits(t, items, 5)) for i, t in texts)
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got) == want


def test_decontamination_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, "password abcdef0123456789abcdef and a b co")], "item_id int, text string")
    kept = decontaminate.decontaminate(edges, bench)
    assert kept.columns == edges.columns and kept.count() == 5
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(edges, bench.limit(0)).count() == len(EDGES)
    assert decontaminate.cut_text("Keep, this one: out! End", [[1, 3]]) == "Keep, : out! End"
    long = "clean é-words, " * 200_000 + "one two THREE four five"
    rows = spark.createDataFrame([(1, long, 7), (2, None, 7), (3, "one two three four five", 7), (4, "one two three", 7)], "doc_id int, text string, __contamination int")
    item = spark.createDataFrame([("a", "one two three four")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(rows, item, action="cut").collect()}
    assert set(got) == {1, 2, 4} and got[1].text == long[: -len("one two THREE four five")] + " five" and got[4].text == "one two three"
    assert got[1].asDict()["__contamination"] == 7 and decontaminate.decontaminate(rows, item).where("doc_id = 1").first().text == long


# 2: chat


def test_chat_escapes_reversibly():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["<|", "|>", "\\", "<", "|", "im_end", "a", "\n"]) for _ in range(rng.randrange(12)))
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
        turns = [(rng.choice(["user", "assistant", "<|x", "a\nb"]), text), ("assistant", text[::-1])]
        out, spans = chat.render(chat.chat_template, turns)
        assert chat.read_back(out, spans) == turns


def test_chat_detects_rewritten_history():
    def forgetful(turns, open_assistant=False):
        """Drops the thoughts of earlier assistant turns."""
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t.split('#')[-1]};" for k, (r, t) in enumerate(turns))

    out, spans = chat.render(forgetful, [("user", "a"), ("assistant", "think#b"), ("user", "c")])
    assert [s.rewrites_at is not None for s in spans] == [False, False, True]
    assert out == "[user]a;[assistant]b;[user]c;" and [out[s.text_start : s.text_end] for s in spans] == ["a", "b", "c"]

    def thoughtless(turns, open_assistant=False):
        return chat.chat_template([(r, t if k == len(turns) - 1 else t.split("#")[-1]) for k, (r, t) in enumerate(turns)])

    turns = [("user", "hi <|im_start|> there"), ("assistant", "hm#"), ("a\nb", ""), ("assistant", "why#so"), ("user", "ok then")]
    out, spans = chat.render(thoughtless, turns)
    assert spans[2].rewrites_at is not None and chat.read_back(out, spans) == [(r, t.split("#")[-1]) for r, t in turns]


def test_chat_spans_of_other_templates(spark):
    """Numbered turns, a last turn that is treated apart, and one that leaves earlier turns out, all as black boxes."""
    def numbered(turns, open_assistant=False):
        return "".join(f"[{k}|{r}]{t}\n" for k, (r, t) in enumerate(turns))

    turns = [(("user", "assistant")[k % 2], f"t{k}" * (k % 3)) for k in range(23)]
    out, spans = chat.render(numbered, turns)
    assert [out[s.text_start : s.text_end] for s in spans] == [t for _, t in turns]
    assert "".join(out[s.start : s.end] for s in spans) == out and all(s.rewrites_at is None for s in spans)

    def marked_last(turns, open_assistant=False):
        return "".join(f"{r}: {t}{'<end>' if k == len(turns) - 1 else ';'}" for k, (r, t) in enumerate(turns))

    out, spans = chat.render(marked_last, turns)
    assert [out[s.text_start : s.text_end] for s in spans] == [t for _, t in turns] and spans[1].rewrites_at is not None

    def short_memory(turns, open_assistant=False):
        return "".join(f"<{r}>{t}" for r, t in turns[-2:])

    rows = spark.createDataFrame([(1, k, r, f"say {k}") for k, (r, _) in enumerate(turns)], "conv_id bigint, turn int, role string, text string")
    (got,) = chat.format_conversations(rows, short_memory).collect()
    assert got.rewrites_history and [s.text_start for s in got.spans[:21]] == [None] * 21
    assert [got.formatted[a:b] for a, b in got.loss_mask] == ["say 21"]


def test_chat_common_ends_equal_a_loop():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert chat._common(a, b) == want and chat._common_end(a[::-1], b[::-1], min(len(a), len(b))) == want


def test_chat_of_800_turns_is_rendered_in_a_second():
    turns = [(("user", "assistant")[k % 2], f"turn {k} <| " * 8) for k in range(800)]
    began = time.process_time()
    out, spans = chat.render(chat.chat_template, turns)
    assert time.process_time() - began < 3 and chat.read_back(out, spans) == turns


def test_chat_long_conversation(spark):
    rows = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("long <| "), 40).alias("text"))
    (got,) = chat.digests(chat.format_conversations(rows)).collect()
    assert got.n_turns == 300 and got.loss_chars == 150 * 40 * 8


def test_chat_edges(spark):
    rows = spark.createDataFrame([(1, 0, "user", None, "z"), (1, 1, None, "b", "z"), (None, 0, "assistant", "c", "z"), (1, 1, None, "b", "z")], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 1
    assert chat.digests(chat.format_conversations(rows.limit(0))).count() == 0


# 3: media


def test_media_round_trip(spark, documents, edges, empty):
    for docs in (documents.limit(60), edges):
        want = sorted((str(i), hashlib.sha256(media.padded((t or "").encode())).hexdigest(), zlib.crc32(media.padded((t or "").encode())[-32:])) for i, t in docs.select("doc_id", "text").collect())
        got = media.described(media.media_columns(docs)).collect()
        assert sorted((str(r.doc_id), r.payload_sha256, r.tail_crc32) for r in got) == want
        assert all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 and r.error is None for r in got)
    assert media.media_columns(empty).count() == 0


def test_media_members_fail_alone(tmp_path):
    writer = media.ArchiveWriter(str(tmp_path), 1 << 20)
    for i in range(3):
        writer.add(i, media.encode_png(media.padded(b"x" * i)), i)
    writer.close()
    path = writer.done[0][0]
    offset = media._directory(path)[1][2]
    with open(path, "r+b") as f:
        f.seek(offset + 60)
        f.write(b"\0\1\2")
    reader = media.ArchiveReader({"list": str(tmp_path), "tries": "2"})
    (batch,) = list(reader.read(media.ByteRange(path, 0, 1 << 20)))
    assert [e is None for e in batch.column(5).to_pylist()] == [True, False, True]


# 4: toxicity


def test_toxicity_learns_and_covers_edges(spark, sf_dir, documents, edges, empty):
    model = toxicity.train(documents, queries.table(spark, sf_dir, "labels"))
    assert np.count_nonzero(model.weights) < 2000
    scores = toxicity.scored(edges, model).select("doc_id", "score").collect()
    assert len(scores) == len(EDGES) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.scored(empty, model).count() == 0
    nothing = toxicity.train(documents, queries.table(spark, sf_dir, "labels").limit(0))
    assert toxicity.scored(edges, nothing).agg(F.max("score")).first()[0] < 0.01


def test_toxicity_held_out_accuracy(spark):
    out = queries.op4_toxicity(spark, "/root/testdata/sf0.1").join(queries.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").toPandas()
    positive = out.toxic == 1
    rank = out.score.rank()
    auc = (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.95
    assert (out.predicted[~positive] == 1).mean() < 0.02


def test_toxicity_non_negative_risk():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 200, 30)) for _ in range(600)]
    positive = np.arange(600) < 40
    rows = [np.union1d(r, [300]) if k < 80 else r for k, r in enumerate(rows)]  # 80 toxic rows, 40 of them confirmed
    model = toxicity.fit(np.concatenate(rows).astype(np.int32), np.array([len(r) for r in rows]), positive, 80 / 600, dimensions=512)
    assert model.weights.argmax() == 300 and model.corrections > 0
    assert model.probability(toxicity.margins(rows[40:80], model)).mean() > 0.5 > model.probability(toxicity.margins(rows[80:], model)).mean()


def test_toxicity_learns_from_unlabelled_documents_only(spark):
    """Neither the label 0 nor documents with it change the fit; unlabelled documents without any label do take part."""
    docs = spark.createDataFrame([(k, f"word{k % 7} other{k % 5} " + ("vile" if k % 10 == 0 else "kind")) for k in range(600)], "doc_id bigint, text string")
    toxic = [(k, 1) for k in range(0, 600, 20)]
    bare = spark.createDataFrame(toxic, "doc_id bigint, toxic int")
    clean = spark.createDataFrame(toxic + [(k, 0) for k in range(1, 600, 3)], "doc_id bigint, toxic int")
    got = toxicity.sample(docs, bare).toArrow()
    inside = docs.where(toxicity.fold_of(F.col("doc_id")) != 1)
    assert got.num_rows == sum(got.column("unlabelled").to_pylist()) == inside.count()
    a, b = toxicity.train(docs, bare), toxicity.train(docs, clean)
    assert np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)
    score = {r.doc_id: r.score for r in toxicity.scored(docs, a).collect()}
    assert min(s for k, s in score.items() if k % 10 == 0) > 0.5 > max(s for k, s in score.items() if k % 10)


def test_toxicity_prior_is_not_the_share_of_confirmed_rows():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 200, 30)) for _ in range(4000)]
    rows = [np.union1d(r, rng.choice([300, 301, 302], 2)) if k < 800 else r for k, r in enumerate(rows)]  # 800 toxic rows, 200 of them confirmed
    positive = np.arange(4000) < 200
    prior = toxicity.class_prior(np.concatenate(rows).astype(np.int32), np.array([len(r) for r in rows]), positive, np.ones(4000, bool), dimensions=512)
    assert prior == pytest.approx(0.2, abs=0.04)


def test_toxicity_risk_and_slope_equal_a_loop():
    """In both branches; the slope is that of the risk (or of the corrected part) by finite differences."""
    rng = np.random.default_rng(4)
    branches = set()
    for prior in (0.05, 0.3, 0.9):
        for shift in (-3, 0, 3):
            margin, positive, unlabelled = rng.normal(0, 2, 30), np.arange(30) < 10, np.arange(30) >= 8
            margin[positive] += shift

            def loop(z):
                p = [prior * math.log(1 + math.exp(-z[i])) / positive.sum() for i in range(30) if positive[i]]
                u = [math.log(1 + math.exp(z[i])) / unlabelled.sum() for i in range(30) if unlabelled[i]]
                n = [prior * math.log(1 + math.exp(z[i])) / positive.sum() for i in range(30) if positive[i]]
                return sum(p), sum(u) - sum(n)

            pos, neg, slope = toxicity.risks(margin, positive, unlabelled, prior)
            assert (pos, neg) == pytest.approx(loop(margin))
            branches.add(neg >= 0)
            target = (lambda z: sum(loop(z))) if neg >= 0 else (lambda z: -loop(z)[1])
            for i in range(30):
                step = np.zeros(30)
                step[i] = 1e-5
                assert slope[i] == pytest.approx((target(margin + step) - target(margin - step)) / 2e-5, abs=1e-6)
    assert branches == {True, False}


def test_toxicity_scores_equal_a_loop(spark, sf_dir, documents):
    """Scores of whole texts, word by word, from the model's weights."""
    model = toxicity.train(documents, queries.table(spark, sf_dir, "labels"))
    half = toxicity.DIMENSIONS // 2
    for r in toxicity.scored(documents.limit(40), model).collect():
        seen = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.text or "").encode()):
            for part, shift in ((w, 0), (w[: toxicity.STEM], half)):
                raw = np.frombuffer(part, np.uint8)
                seen.add(int(toxicity.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0] & np.uint64(half - 1)) + shift)
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(model.weights[sorted(seen)]) - model.bias)))


def test_toxicity_sample_is_bounded_in_bytes(spark, sf_dir, documents):
    """A small bound thins confirmed and other rows alike and still gives a model; one that leaves no rows is an error."""
    at = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, at, "documents"), queries.table(spark, at, "labels")
    model = toxicity.train(docs, labels, most_features=100_000)
    out = toxicity.scored(docs.where(toxicity.fold_of(F.col("doc_id")) == 1).select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    positive = out.toxic == 1
    auc = (out.score.rank()[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert np.count_nonzero(model.weights) > 20 and auc > 0.9 and (out.score[positive] >= 0.7).mean() > 0.5
    with pytest.raises(ValueError, match="too small"):
        toxicity.train(documents, queries.table(spark, sf_dir, "labels"), most_features=0)


def test_toxicity_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, "vile" if k % 4 == 0 else f"kind{k % 3}", 1, 2, 3) for k in range(200)], "doc_id bigint, text string, of int, positive int, __id int").withColumn("__positive", F.lit(0)).withColumn("features", F.lit(0))
    labels = spark.createDataFrame([(k, 1, "x") for k in range(0, 200, 8)], "doc_id bigint, toxic int, of string").withColumn("text", F.lit("t")).withColumn("unlabelled", F.lit(0))
    assert toxicity.scored(docs, toxicity.train(docs, labels)).columns == [*docs.columns, "score"]


# 5: secrets


def test_secret_ledger_scans_blobs_once(spark, edges):
    first = secrets.scan(edges).cache()
    assert first.count() == edges.select(F.coalesce("text", F.lit(""))).distinct().count()
    more = edges.unionByName(edges.limit(1).withColumn("text", F.lit("AKIA" + "A" * 16)))
    assert secrets.scan(more, first).count() == 1
    again = secrets.scan(more, first, rule_versions={"hex": 2}).collect()
    assert sorted(len(r.rules) for r in again) == [1] * first.count() + [6]
    found = secrets.findings(more, first.unionByName(secrets.scan(more, first)))
    assert found.columns == ["doc_id", "id", "label", "content", "blob", "digest", "blob_", "spans"]
    assert found.count() == len(EDGES) + 1 and found.where(F.size("spans") > 0).count() == 3 and found.where("blob = 'b'").count() == len(EDGES) + 1


def test_secret_ledger_is_kept(spark, sf_dir, tmp_path, empty):
    """A second run of the query over the same rows scans nothing and finds the same."""
    spark.conf.set("ledgerloom.secrets.ledger", f"{tmp_path}/ledger")
    try:
        first = queries.op5_secret_scans(spark, sf_dir).toPandas()
        rows = secrets.ledger_at(spark, f"{tmp_path}/ledger").count()
        assert rows == queries.table(spark, sf_dir, "documents").select("text").distinct().count()
        second = queries.op5_secret_scans(spark, sf_dir).toPandas()
        assert secrets.ledger_at(spark, f"{tmp_path}/ledger").count() == rows
        assert first.sort_values("doc_id").values.tolist() == second.sort_values("doc_id").values.tolist()
    finally:
        spark.conf.unset("ledgerloom.secrets.ledger")
    assert secrets.scan_paths(empty).count() == 0


def test_secret_spans_of_a_long_text(spark):
    text = ("é" * 100_000 + " ") * 3 + "token: abcdefghijklmnop"
    (row,) = secrets.scan_paths(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(s.start, s.kind, s.end) for s in row.spans] == [(300_003, 0, 300_026)]


def test_secret_findings_take_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "token = abcdefghijkl", 1, 2, 3), (2, None, 1, 2, 3)], "doc_id int, text string, __blob int, __found int, __blob_ int").withColumn("spans", F.lit("s"))
    got = secrets.scan_paths(rows).collect()
    assert sorted((r.doc_id, len(r.spans_), r.spans, r["__blob"]) for r in got) == [(1, 1, "s", 1), (2, 0, "s", 1)]


def test_secret_literals_are_in_every_match():
    """What is sought before a pattern is part of whatever the pattern matches."""
    rng = random.Random(8)
    starts = ["Password", "PASSWD", "sEcret", "Token", "api_key", "APIKEY", "apikey", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "gho_", "glpat-", "xoxa", "xoxb", "xoxp", "xoxr", "sk_live_", "AKIA" + "ABCDEFGH12345678", "eyJabcdefgh.eyJabcdefgh.abcdefgh"]
    for kind, pattern, *_ in [*secrets.BASE_RULES, *secrets.MORE_RULES]:
        if kind not in secrets.LITERALS:
            continue
        found = 0
        for _ in range(400):
            text = rng.choice(starts) + rng.choice(["", " = ", ':"', "="]) + "".join(rng.choice("ABCdef019_-") for _ in range(20)) + "A" * 20
            if m := re.search(pattern, text):
                found += 1
                assert any(x in m[0].lower() for x in secrets.LITERALS[kind])
        assert found > 5


def test_secret_pattern_is_matched_once_a_part(spark):
    """Each rule's pattern stands in the plan once for the test, the gaps, the matches and, if it counts one, a group."""
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = secrets.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 + len(secrets.BASE_RULES) + len(secrets.MORE_RULES)
    assert "SortAggregate" not in secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()


# 6: personal data


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_spans_equal_brute_force(documents):
    rng = random.Random(5)
    pieces = ["a@b.co", "@", ".", "x.y@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "-", " ", "é", "%", "a@b.com@c.org", "00012", "+"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(1500)] + [r.text for r in documents.select("text").collect()]
    assert all(pii.base_spans(t) == brute_pii(t) for t in texts)


def test_pii_contexts_discover_identifiers(spark, edges, empty):
    rows = [(i, f"Please write to agent mail{i}@example.com today") for i in range(12)]
    rows += [(100, "Please write to agent 55-1234-99 today"), (101, "An unrelated 55-1234-98 number")]
    found = {r.id: r.spans for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=3).collect()}
    assert [s.kind for s in found[100]] == [len(pii.KINDS)] and found[101] == []
    masked = pii.redacted(edges.withColumn("n_chars", F.length("text")), n_chars="n_chars")
    assert masked.count() == len(EDGES) and masked.where("text like '%[EMAIL]%'").count() == 2
    assert pii.detect(empty).count() == 0


def test_pii_patterns_and_scores_equal_brute_force(spark):
    rng = random.Random(8)
    edges = {(f"p{rng.randrange(6)}", f"i{rng.randrange(12)}"): rng.randrange(1, 5) for _ in range(40)}
    seeds = {f"i{k}" for k in range(4)}
    frame = spark.createDataFrame([(p, i, i in seeds, n) for (p, i), n in edges.items()], "pattern string, instance string, seed boolean, n int")
    score = {i: float(i in seeds) for _, i in edges}
    for _ in range(3):
        confidence = {p: sum(n * score[i] for (q, i), n in edges.items() if q == p) / (sum(n for (q, _), n in edges.items() if q == p) + 2) for p, _ in edges}
        score = {i: max(float(i in seeds), sum(n * confidence[p] for (p, j), n in edges.items() if j == i) / sum(n for (_, j), n in edges.items() if j == i)) for i in score}
    assert {r.pattern: r.confidence for r in pii.score_patterns(frame).collect()} == pytest.approx(confidence)
    edges = {(p.replace("p", "b" if int(p[1:]) % 2 else "s"), i): n for (p, i), n in edges.items()}
    frame = spark.createDataFrame([(p, i, i in seeds, n) for (p, i), n in edges.items()], "pattern string, instance string, seed boolean, n int")
    measured = {p: rng.choice([1, 30]) for p in sorted({p for p, _ in edges}) if p in ("b1", "b3")}
    score = {i: float(i in seeds) for _, i in edges}
    for _ in range(3):
        confidence = {}
        for p in {p for p, _ in edges}:
            mine = {i: n for (q, i), n in edges.items() if q == p}
            weak = p[0] == "b" and (p not in measured or sum(score[i] for i in mine) < 2)
            confidence[p] = 0.0 if weak else sum(n * score[i] for i, n in mine.items()) / (max(sum(mine.values()), measured.get(p, 0)) + 2)
        score = {i: max(float(i in seeds), sum(n * confidence[p] for (p, j), n in edges.items() if j == i) / sum(n for (_, j), n in edges.items() if j == i)) for i in score}
    got = pii.score_patterns(frame, spark.createDataFrame(list(measured.items()), "pattern string, n bigint"), support=2.0)
    assert {r.pattern: r.confidence for r in got.collect()} == pytest.approx(confidence)
    text = "Call Anna, now: «AB-12x» or else"
    assert pii.patterns(pii.word_ends(text), "AB-12x", 17, 23) == ["b now", "f or", "a anna now _ or", "s a-x3", "o a-x"]
    assert pii.patterns(pii.word_ends("77777"), "77777", 0, 5) == ["s 05"]
    assert [pii.words_of(p) for p in ("b now", "f or", "a anna now _ or", "s 05")] == [("now",), ("or",), ("anna", "now"), None]
    again = "The now or the now, the now 1234 or now. Or"
    assert pii.occurrences(again, {"now", "or"}, {("the", "now"), ("now", "the")}, {"the", "now"}) == {("now",): 4, ("or",): 3, ("the", "now"): 3, ("now", "the"): 1}


@pytest.mark.parametrize("keys", [[], [0] * 30 + [1] * 4 + list(range(2, 40)), [None, 0, 0]])
def test_split_join_equals_plain_join(spark, keys):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k bigint, i bigint")
    table = written(spark.createDataFrame([(k, -k) for k in range(50)], "k bigint, v bigint"), "table")
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), "k", "n", most=10)
    assert {r.k for r in hot.where("k is not null").collect()} == {k for k in set(keys) - {None} if keys.count(k) * 10 >= len(keys)}
    assert sorted(map(tuple, split_join(rows, table, "k", hot).collect())) == sorted((k, i, -k) for i, k in enumerate(keys) if k is not None)


def planted_identifiers(rng):
    """Texts of neutral prose with seeds in contexts, identifiers of other forms in the same contexts, and decoys that are none.

    Returns rows (doc_id, text), and the identifiers and decoys.
    """
    syllables = "ba de ki lo mu ra se ti vo".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", word(), word()]) for _ in range(n))
    frames = ["please contact {} directly", "my personal number {} belongs", "reach customer {} by", "account holder {} signed"]
    other = [lambda k: f"ID-{k:05d}-X", lambda k: f"{k:04d}/77/{k % 10}", lambda k: f"user{k:06d}", lambda k: f"DE{k:016d}"]
    rows, wanted, decoys = [], [], []
    for k in range(240):
        rows.append(f"{prose(20)} {frames[k % 4].format(rng.choice([f'm{k}@x{k}.org', f'+1 (555) 010-{k:04d}']))} {prose(15)}")
    for k in range(80):
        wanted.append(other[k // 4 % 4](k))
        rows.append(f"{prose(12)} {frames[k % 4].format(wanted[-1])} {prose(12)}")
    for k in range(120):  # numbers that fail the checksum, order numbers in a context of their own, seeds after common words
        number = f"{4000000000000000 + 7 * k}"
        decoys.append(f"{int(number) + 1 if pii.luhn(number) else number}")
        rows.append(f"{prose(12)} {decoys[-1]} {prose(12)}")
        decoys.append(f"A{k:05d}-{k % 9}")
        rows.append(f"{prose(6)} order {decoys[-1]} shipped {prose(6)}")
        rows.append(f"{prose(6)} the n{k}@y.org {prose(6)}")
    return list(enumerate(rows)), wanted, decoys


def test_pii_finds_planted_identifiers_and_no_decoy(spark):
    rows, wanted, decoys = planted_identifiers(random.Random(11))
    texts = dict(rows)
    got = [texts[r.id][s.start : s.end] for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() for s in r.spans if s.kind == len(pii.KINDS)]
    right = len(set(got) & set(wanted))
    assert right >= 0.9 * len(wanted) and right >= 0.95 * len(got)
    assert not set(got) & set(decoys)


def test_pii_discovered_equals_brute_force(spark):
    rows, _, _ = planted_identifiers(random.Random(12))
    rows = rows[::3] + rows[:40]
    occurrences, edges, all_words = {}, defaultdict(int), [[w.lower() for w in re.findall(r"[^\W\d_]+", t)] for _, t in rows]
    for _, text in rows:
        spans = pii.base_spans(text)
        words = pii.word_ends(text)
        for a, b, seed in [(a, b, True) for a, _, b in spans] + [(a, b, False) for a, b, _ in pii.candidates(text, spans)]:
            patterns = pii.patterns(words, text[a:b], a, b)
            occurrences[text, a, b] = (text[a:b].lower(), patterns, seed)
            for p in patterns:
                edges[p, text[a:b].lower()] += 1
    seeds = {i for i, _, seed in occurrences.values() if seed}
    by_pattern, by_instance = defaultdict(dict), defaultdict(dict)
    for (p, i), n in edges.items():
        by_pattern[p][i] = by_instance[i][p] = n
    measures = {}
    for p, mine in by_pattern.items():
        if p[0] in "bfa" and len(mine) >= 3:
            x = p[2:].split(" ")[: 2 if p[0] == "a" else 1]
            measures[p] = sum(w[k : k + len(x)] == x for w in all_words for k in range(len(w)))
    score = {i: float(i in seeds) for i in by_instance}
    for _ in range(3):
        confidence = {}
        for p, mine in by_pattern.items():
            weak = p[0] in "bfa" and (p not in measures or sum(score[i] for i in mine) < 3)
            confidence[p] = 0.0 if weak else sum(n * score[i] for i, n in mine.items()) / (max(sum(mine.values()), measures.get(p, 0)) + 2)
        score = {i: max(float(i in seeds), sum(n * confidence[p] for p, n in mine.items()) / sum(mine.values())) for i, mine in by_instance.items()}
    want = {}
    for (text, a, b), (_, patterns, seed) in occurrences.items():
        words = max([confidence[p] for p in patterns if p[0] in "bfa"], default=0.0)
        form = max([confidence[p] for p in patterns if p[0] in "so"], default=0.0)
        if not seed and words >= 0.25 and max(words, (words + form) / 2) >= 0.5:
            want[hashlib.md5(text.encode()).hexdigest(), a, b] = max(words, (words + form) / 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, found = pii.contexts_of(written(pii.extracted(docs), "extracted"))
    got = {}
    for most in (200_000, 10):  # one pass, and several
        counted = pii.measured(docs, found, most=most)
        assert {r.pattern: r.n for r in counted.collect()} == measures
        got[most] = {(r.content, r.start, r.end): r.score for r in pii.discovered(seen, found, counted).collect()}
    assert len(want) > 10 and got[10] == got[200_000] == pytest.approx(want)


def test_pii_form_alone_is_never_enough(spark):
    """In the given documents identifiers stand among random words: nothing is discovered there, and numbers that fail the checksum stay."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    spans = pii.detect(docs).select(F.explode("spans").alias("s")).where(F.col("s.kind") == len(pii.KINDS))
    assert spans.isEmpty()
    helpers = ["__content", "__of", "__spans", "__pii_spans", "__pii_of", "content", "of"]
    named = docs.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(helpers)]).limit(50)
    masked = pii.redacted(named)
    assert masked.columns == named.columns and masked.count() == 50 and masked.select(*helpers).distinct().count() == 1


def test_pii_long_values_and_far_words():
    value = "7" * 500 + "x" * 80
    assert [v for *_, v in pii.candidates(f"see ({value}), now", [])] == [value]
    words = pii.word_ends(f"left {'- ' * 200}{value} {'- ' * 200}right")
    assert pii.patterns(words, value, 405, 985)[:2] == ["b left", "f right"]


# 7: token counts


def test_token_attribution_rules():
    ends, starts, stops = np.array([3, 5, 9]), np.array([0, 4]), np.array([4, 9])
    assert tokencount.attribute(ends, starts, stops, "start").tolist() == [2, 1]
    assert tokencount.attribute(ends, starts, stops, "most").tolist() == [2, 1]
    assert tokencount.attribute(ends, starts, stops, "split").tolist() == [1.5, 1.5]


def test_token_counts_equal_offsets_of_another_library(spark, documents, edges, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    for docs in (documents.limit(80), edges):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in tokencount.count_tokens(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken").collect():
            t = texts[r.id]
            assert r.n_tokens == len(tok.encode(t, add_special_tokens=False).ids)
            assert sum(r.section_tokens) + r.outside == r.n_tokens
            if t.isascii():
                starts = [a for a, _ in tok.encode(t, add_special_tokens=False).offsets]
                want = [sum(a <= s < b for s in starts) for _, a, b in tokencount.paragraphs(t)]
                assert [int(x) for x in r.section_tokens] == want
    assert tokencount.count_tokens(empty, f"{TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0


# 8: Jaccard join


def brute_components(rows, k=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed, n_families, size, edits):
    """Near copies that are partly linked with each other: texts of one family differ in a few words from its first."""
    rng, rows = random.Random(seed), []
    for f in range(n_families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 8, 60, 120]))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "n", "size", "edits"), [(1, 12, 6, 3), (2, 3, 60, 6), (3, 2, 90, 3)])
def test_jaccard_equals_brute_force(spark, seed, n, size, edits, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "SMALL_RUN", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = [*families(seed, n, size, edits), (10_000, None), (10_001, ""), (10_002, "one"), (10_003, "One"), (10_004, "a b c d e"), (10_005, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = jaccard.jaccard_join(docs)[0].collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    if seed == 2:
        return
    # All links of classes, each once.
    if seed == 2:
        return
    # All links of classes, each once.
    rows_of, links = jaccard.jaccard_join(docs, all_links=True)
    of, sets = {r.id: bytes(r["class"] or b"") for r in rows_of.collect()}, {}
    for i, t in rows:
        w = (t or "").lower().split()
        if w:
            sets[of[i]] = {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    keys = sorted(sets)
    want = {(x, y, len(sets[x] & sets[y]), len(sets[x] | sets[y])) for k, x in enumerate(keys) for y in keys[k + 1 :] if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
    found = [(bytes(r.x), bytes(r.y), r.shared, r.total) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_jaccard_edges(spark, edges, empty):
    rows, _ = jaccard.jaccard_join(edges)
    assert rows.count() == len(EDGES)
    edges = edges.withColumn("__content", F.lit("c")).withColumn("__id", F.lit(1))
    kept = jaccard.deduplicated(edges)
    assert kept.columns == edges.columns
    # The empty rows stay (null, empty and twice blank), the rows that share a text leave one.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "3", "4", "5"]
    assert jaccard.deduplicated(empty).count() == 0
    twice = spark.createDataFrame([(7, "a b c d e f g")] * 3, "doc_id bigint, text string")
    assert jaccard.deduplicated(twice).count() == 1


def test_jaccard_deduplicated_takes_columns_of_any_name(spark):
    names = ["__gone", "__gone_content", "__again", "__again_content", "__other_id", "__other_content", "__content", "__id", "content", "rows", "best"]
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (1, "a b c d e f g"), (3, "h i"), (3, "h i"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = jaccard.deduplicated(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b c d e f g"), (3, "h i"), (4, None)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 470)]
    group = defaultdict(set)
    for a, b in links:
        merged = group[a] | group[b] | {a, b}
        for x in merged:
            group[x] = merged
    got = components.components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()
    assert {r.vertex: r.component for r in got} == {x: min(g) for x, g in group.items() if len(g) > 1}


# 9: SentencePiece


@pytest.fixture(scope="module")
def pieces():
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        return sentencepieces.Pieces(f.read())


def test_scan_equals_the_library(pieces, documents):
    rng = random.Random(4)
    alphabet = ["a", "b", "ab", " ", "the", "ing", "é", "Z", "\n", "漢", "😀", "1", "==", "....", "   ", "aaaa", "▁", "<s>", "x" * 30]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))) for _ in range(300)] + [r.text for r in documents.limit(12).collect()]
    for t in texts:
        for chunk in (17, 64):
            assert sentencepieces.encode_giant(pieces, t, chunk) == pieces.processor.encode(t)
        if "▁" not in t:
            assert sentencepieces.decoded(pieces, pieces.processor.encode(t)) == t


def test_matrices_combine_associatively(pieces):
    text = pieces.processor.normalize("unbelievable antidisestablishmentarianism " * 3)
    bounds = sentencepieces._bounds(len(text), 20)
    a, b, c = (sentencepieces.transfer(pieces, text, *x, False) for x in bounds[:3])
    both = sentencepieces.combined
    assert both(both(a, b), c) == both(a, both(b, c))


def test_giant_rows_equal_the_library(spark, documents, edges, empty, pieces):
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    for docs in (documents.limit(40), edges.unionByName(edges)):
        got = sentencepieces.encode(docs, model, giant=30, chunk=50).collect()
        assert len(got) == docs.count() and all(list(r.ids) == pieces.processor.encode(r.text) for r in got)
        assert all(r.path == ("scan" if len(r.text) > 30 else "library") for r in got)
    out = sentencepieces.round_trips(edges, model).collect()
    assert [r.round_trip for r in out if r.doc_id != 5] == [True] * 6 and not [r for r in out if r.doc_id == 5][0].round_trip
    assert sentencepieces.encode(empty, model).count() == 0


def test_scan_in_blocks_and_without_a_path(spark, pieces, monkeypatch):
    """Many blocks give the library's pieces; a text whose scan finds no one path is encoded by the library."""
    monkeypatch.setattr(sentencepieces, "BLOCK", 3)
    monkeypatch.setattr(sentencepieces, "bounded", lambda df: df)
    model, rng = f"{TOKENIZERS}/piece_bpe_32k.model", random.Random(6)
    rows = [(k, "".join(rng.choice(["word", " ", "ing", "漢字", "==", "  ", "x" * 40, "é"]) for _ in range(300))) for k in range(4)]
    got = sentencepieces.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), model, giant=30, chunk=25).collect()
    assert all(r.path == "scan" and list(r.ids) == pieces.processor.encode(r.text) for r in got)
    assert sentencepieces.cut_states([{(-1, 0): {(5, -1): 0.0, (6, -2): 0.0}}]) is None and sentencepieces.cut_states([{}]) is None
    monkeypatch.setattr(sentencepieces, "cut_states", lambda *_: None)
    got = sentencepieces.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), model, giant=30, chunk=25).collect()
    assert len(got) == 4 and all(r.path == "library" and list(r.ids) == pieces.processor.encode(r.text) for r in got)


def test_product_is_a_tree_of_products(pieces):
    text = pieces.processor.normalize("unbelievable antidisestablishmentarianism " * 3)
    matrices = [sentencepieces.transfer(pieces, text, a, b, b == len(text)) for a, b in sentencepieces._bounds(len(text), 20)]
    whole = matrices[0]
    for m in matrices[1:]:
        whole = sentencepieces.combined(whole, m)
    assert sentencepieces.product(matrices) == whole and len(sentencepieces.cut_states(matrices)) == len(matrices) + 1


# 10: licences


def test_licences(spark, edges, empty):
    rows = [(1, "Copyright (c) 2020 Someone\nreleased under the  mit LICENCE"), (2, "Text.\nLicensed under the Apache License, Version 2.0.\nMore."), (3, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].license == "MIT" and got[1].line_licenses == "MIT"
    assert got[2].license is None and got[2].line_licenses == "Apache-2.0" and got[2].n_license_lines == 1
    assert got[3].license is None and licenses.scan(edges).count() == len(EDGES) and licenses.scan(empty).count() == 0


def test_licences_of_whole_texts(spark):
    """Planted texts are found with other case, punctuation, copyright lines, spellings and line breaks, and not with another word."""
    rng, rows = random.Random(9), []
    for k, (name, body) in enumerate(licenses.KNOWN):
        changed = re.sub(r"\backnowledgment\b", "acknowledgement", re.sub(r"\blicense\b", "licence", body)).upper() if k % 2 else body.swapcase()
        changed = re.sub(r"[.,;:]", lambda m: rng.choice([m[0], " ", "--"]), changed.replace(" ", "  \t", 3))
        words = changed.split(" ")
        for at in rng.sample(range(1, len(words)), min(3, len(words) - 1)):
            if "copyright" not in " ".join(words[at : at + 2]).lower() and "(" not in words[at]:
                words[at] = "\n" + words[at]
        rows.append((k, name, f"Copyright (c) 2019 Some One, and others\n(C) 2020 Another\n\n{' '.join(words)}\nAll rights reserved.\n"))
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, name string, text string")).collect()}
    assert got == {k: name for k, name, _ in rows}
    near = spark.createDataFrame([(k, f"{t} extra") for k, _, t in rows], "doc_id int, text string")
    assert licenses.scan(near).where("license IS NOT NULL").count() == 0
    twice = licenses.known_licenses(spark, [("B", "some text"), ("A", "Some text!")]).union(spark.createDataFrame([(hashlib.sha256(b"some text").hexdigest(), "C", 9)], "digest string, license string, n_chars int"))
    assert [tuple(r)[2:] for r in licenses.scan(spark.createDataFrame([(1, "SOME\ntext")], "doc_id int, text string"), twice).collect()] == [("A", 0, "")]


def test_licence_digests_are_of_this_canonical_form(spark):
    """Held against the texts that many systems ship, where they are here."""
    listed = {name: digest for name, digest in licenses.DIGESTS}
    shipped = {"GPL-3.0": "GPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}
    rows = [(name, open(path, encoding="utf-8").read()) for name, file in shipped.items() if os.path.exists(path := f"/usr/share/common-licenses/{file}")]
    got = spark.createDataFrame(rows, "doc_id string, text string") if rows else None
    assert got is None or all(r.digest == listed[r.doc_id] and r.license == r.doc_id for r in licenses.scan(got).collect())


def test_licence_text_is_brought_to_canonical_form_once(spark, documents, capsys):
    rows = licenses.canonical_rows(documents, "doc_id", "text").select(licenses.digest_of(F.col("__lines")), F.filter("__lines", lambda x: F.length(x) == 5))
    rows.explain()
    assert capsys.readouterr().out.count("all rights reserved") == 1


def test_licence_of_a_very_long_text(spark):
    long = "word, " * 400_000 + "\nSPDX-License-Identifier: MIT\n"
    (row,) = licenses.scan(spark.createDataFrame([(1, long)], "doc_id int, text string")).collect()
    assert row.license is None and row.line_licenses == "MIT"


class _Worker:
    """Stands in for a table: gives the function that would run in a Python worker."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_worker_drops_what_another_operator_remembered(spark):
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        model = f.read()
    pieces = sentencepieces.pieces_of(model)
    pieces.word("▁remembered")
    assert sentencepieces.pieces_of(model) is pieces
    assert list(pii.extracted(_Worker())(iter([]))) == []
    fresh = sentencepieces.pieces_of(model)
    assert fresh is not pieces and not fresh._words

"""Draws, temperatures, exploration and coordination of episodes, late data, redacted streams, strict cleaning: against plain loops."""

from __future__ import annotations

import html
import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import episodes, graph, metrics, rewards, scrub, vectors
from ledgerloom.streaming import dedup as stream


def test_draws_follow_the_softmax(spark):
    logits = {"a": 0.0, "b": 20.0, "c": 40.0, "d": None}
    rows = [(g, i, x) for g in range(3) for i, x in logits.items()]
    df = spark.createDataFrame(rows, "g int, item string, x double")
    got = rewards.drawn(df, "g", "item", "x", 20.0, draws=3000).collect()
    assert len(got) == 9000 and {(r.g, r.draw) for r in got} == {(g, d) for g in range(3) for d in range(3000)}
    total = sum(math.exp(x / 20) for x in logits.values() if x is not None)
    count = Counter(r.item for r in got)
    for i, x in logits.items():
        want = 0 if x is None else math.exp(x / 20) / total
        assert count[i] / 9000 == pytest.approx(want, abs=0.02)
    again = rewards.drawn(df.orderBy(F.desc("item")), "g", "item", "x", 20.0, draws=50).collect()
    assert sorted(map(tuple, again)) == sorted((r.g, r.draw, r.item) for r in got if r.draw < 50)
    assert sorted(map(tuple, rewards.drawn(df, "g", "item", "x", 20.0, seed=8, draws=50).collect())) != sorted(map(tuple, again))


def test_best_temperature(spark):
    rng = random.Random(2)
    rows = [(z := rng.gauss(0, 4), int(rng.random() < 1 / (1 + math.exp(-z / 2.5)))) for _ in range(400)]
    nll = lambda t: sum(math.log1p(math.exp(-abs(z / t))) + max(z / t, 0) - z / t * y for z, y in rows) / len(rows)
    want = min((0.01 * k for k in range(5, 1000)), key=nll)
    got = metrics.best_temperature(spark.createDataFrame(rows, "logit double, label int")).first()
    assert got.temperature == pytest.approx(want, abs=0.02) and got.nll == pytest.approx(nll(got.temperature)) and got.nll <= nll(want) + 1e-9
    assert tuple(metrics.best_temperature(spark.createDataFrame([], "logit double, label int")).first()) == (None, None)


def test_best_temperature_of_several_classes(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        z = [rng.gauss(0, 3) for _ in range(4)]
        w = [math.exp(x / 1.7) for x in z]
        rows.append((z, rng.choices(range(4), w)[0]))
    nll = lambda t: sum(math.log(sum(math.exp(x / t) for x in z)) - z[y] / t for z, y in rows) / len(rows)
    got = metrics.best_temperature(spark.createDataFrame(rows, "logits array<double>, label int"), metrics.softmax_nll).first()
    assert got.nll == pytest.approx(nll(got.temperature)) and got.temperature == pytest.approx(min((0.01 * k for k in range(50, 500)), key=nll), abs=0.02)


def test_exploration_rates(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), rng.choice(["a", "b", "c", None]), rng.random() < 0.3, rng.random() < 0.4, rng.random() < 0.5) for _ in range(200)] + [(9, None, False, False, False)]
    got = {r.e: r for r in episodes.exploration_rates(spark.createDataFrame(rows, "e int, node string, fe boolean, fn boolean, fl boolean"), "e", "node", F.col("fe"), F.col("fn"), F.col("fl")).collect()}
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e]
        nodes, bad = {r[1] for r in mine if r[1]}, {r[1] for r in mine if r[1] and r[3]}
        tp, fp, fn = (sum(f(r) for r in mine) for f in (lambda r: r[4] and r[2], lambda r: r[4] and not r[2], lambda r: not r[4] and r[2]))
        p, q = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
        found = sum(r[2] for r in mine)
        want = (e, found, found / len(mine), len(nodes), len(bad), len(bad) / max(len(nodes), 1), len(nodes) / len(mine), p, q, 2 * p * q / max(p + q, 1e-8))
        assert tuple(got[e]) == pytest.approx(want)


def test_coordination_stats(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), rng.randrange(5), rng.choice("xyz"), rng.choice([None, 0, 2, 3])) for _ in range(60)]
    got = {r.e: r for r in episodes.coordination_stats(spark.createDataFrame(rows, "e int, s int, k string, p int"), "e", "s", "k", "p").collect()}
    for e in range(3):
        steps, kinds = defaultdict(int), Counter()
        for _, s, k, p in (r for r in rows if r[0] == e):
            steps[s] += p or 0
            kinds[k] += 1
        assert tuple(got[e])[:4] == (e, len(steps), sum(kinds.values()), ",".join(f"{k}={n}" for k, n in sorted(kinds.items())))
        assert got[e].avg_proposals_per_step == pytest.approx(sum(steps.values()) / len(steps))


def test_candidate_proposals_of_each_walk(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (3, 1), (4, 5)], "src int, dst int")
    visited = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 3)], "walk string, id int")
    proposed = spark.createDataFrame([("b", 4)], "walk string, id int")
    assert sorted(map(tuple, graph.candidate_proposals(edges, visited, proposed, by="walk").collect())) == [("a", 3), ("b", 1)]
    assert [r.id for r in graph.candidate_proposals(edges, visited, proposed.limit(0)).collect()] == [4]


def test_velocity_drops_late_rows(spark, tmp_path):
    """What comes more than the delay behind the latest row of an earlier micro-batch is not counted, what comes less late is."""
    files = [["2024-01-05", "2024-03-20"], ["2024-03-20 00:01:00"], ["2024-01-06", "2024-03-19 12:00:00"], ["2024-06-30"]]
    for k, days in enumerate(files):
        spark.createDataFrame([("x", d) for d in days], "key string, d string").select("key", F.col("d").cast("timestamp").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    paths = sorted((tmp_path / "in").glob("*/*.parquet"))
    for k, p in enumerate(paths):  # files are taken in order of their times
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    rows = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = stream.run_once(stream.velocity(rows, "key", "at", delay="2 days"), f"{tmp_path}/out", "append", f"{tmp_path}/state")
    got = {str(r.window.start.date()): r.n for r in out.collect()}
    # January's window had closed before the third file came, so 2024-01-06 is late; March's was open for 2024-03-19.
    assert sorted(got.values()) == [1, 3] and max(got, key=got.get) > "2024-02-15"


def test_scrubbed_stream_equals_the_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream.run_once(stream.scrubbed(rows, "doc_id", "text"), f"{tmp_path}/out", "append", f"{tmp_path}/state")
    want = scrub.scrub(docs, "doc_id", "text")
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty() and out.where("pii_count > 0").count() > 5


def test_strict_html(spark, sf_dir):
    def one(x):
        for p in (r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", r"<!--.*?-->", r"<[^>]+>"):
            x = re.sub(p, " ", x, flags=re.I | re.S)
        for entity in ("&lt;", "&gt;", "&quot;", "&apos;", "&#39;", "&amp;"):
            x = x.replace(entity, html.unescape(entity))
        for p in (r"&[a-zA-Z]+;", r"&#\d+;"):
            x = re.sub(p, " ", x)
        for p, by in T.WHITESPACE:
            x = re.sub(p, by, x, flags=re.M)
        return x.strip()

    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    given = [*pages, "<SCRIPT>if (a<b) x()</script >kept<style>p{}</style><!-- a > b -->&copy; 1 &lt; 2 &#169; &amp;", "<p\nclass='x'>a</p>  b\n\n\n\nc", ""]
    rows = spark.createDataFrame(list(enumerate(given)), "id int, html string")
    got = {r.id: r.t for r in rows.select("id", T.normalize_whitespace(T.strip_html(F.col("html"), "strict")).alias("t")).collect()}
    assert {k: v for k, v in got.items()} == {k: one(x) for k, x in enumerate(given)}


def test_entities(spark):
    rng = random.Random(3)
    pieces = ['"Blue Sky"', "First National Bank", "Acme Holdings LLC", "the", "Bank", "Ltd", "Foo Inc", "of", "X Corp", '"', "Alpha Beta Gamma Limited", "bank", "McDuck Ltd."]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(200)] + [" ".join(f"Name{chr(97 + k)} Bank and" for k in range(26)).replace("Name", "N"), ""]
    patterns = [r'"([^"]+)"', r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+Bank\b)", r"(\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:LLC|Ltd|Inc|Corp|Limited)\b)"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.entities(F.col("t")).alias("e")).collect()
    assert {r.id: r.e for r in got} == {k: sorted({m for p in patterns for m in re.findall(p, t)})[:20] for k, t in enumerate(texts)}


def test_accounts_have_their_clustering(spark):
    tx = spark.createDataFrame([("a", "b", 1.0, 1), ("b", "c", 2.0, 2), ("a", "c", 3.0, 3), ("c", "d", 4.0, 4)], "nameOrig string, nameDest string, amount double, step bigint")
    tx = tx.select("*", F.lit(0).alias("isMoneyLaundering"), F.lit(0.0).alias("oldbalanceOrg"), F.lit(0.0).alias("newbalanceOrig"), F.lit("x").alias("type"))
    got = {r.id: r.v for r in vectors.account_vectors(tx, tx.select(F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst"), "amount", "step")).collect()}
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys("abcd", 20)
    assert {k: v[17] for k, v in got.items()} == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3), "d": 0.0} or {k: v[16] for k, v in got.items()} == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3), "d": 0.0}


@pytest.mark.parametrize("name", sorted(T.TYPOLOGIES))
def test_hints_are_in_every_match(name):
    """What is sought before a pattern is part of whatever the pattern matches."""
    inner = T.TYPOLOGIES[name].removeprefix(r"\b").removesuffix(r"\b")
    seen = set()

    @settings(max_examples=200, database=None, derandomize=True)
    @given(st.from_regex(re.compile(inner, re.ASCII), fullmatch=True))
    def check(text):
        seen.add(text)
        assert any(h in text for h in T.HINTS[T.TYPOLOGIES[name]])

    check()
    assert len(seen) > 1

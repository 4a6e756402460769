"""Small inputs whose answers are worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import corpus, episodes, features, graph, metrics, sampling, scrub


def one(df):
    return df.first()[0]


@pytest.fixture
def scored(spark):
    rows = zip(range(5), [1, 0, 1, 0, 0], [0.9, 0.1, 0.8, 0.05, 0.7], strict=True)
    return spark.createDataFrame(list(rows), "id bigint, label int, score double")


def test_ranking_metrics(scored):
    at = {r.k: r for r in metrics.at_k(scored, [2, 3]).collect()}
    assert at[2].recall == 1.0 and at[2].f1 == 1.0
    assert at[3].precision == pytest.approx(2 / 3)
    assert one(metrics.average_precision(scored)) == 1.0
    assert one(metrics.roc_auc(scored)) == 1.0
    assert metrics.mrr(scored.withColumn("q", F.lit(0)), "q").first().rr == 1.0


def test_calibration_of_a_coin(spark):
    coin = spark.createDataFrame([(0, 0, 0.5), (1, 1, 0.5)], "id int, label int, score double")
    assert metrics.calibration_errors(coin).first().ece == 0
    assert metrics.brier(coin).first().brier == 0.25


def test_running_sums_are_exact_in_few_slices(spark):
    rows = spark.range(100).select((F.col("id") * F.col("id")).cast("double").alias("x"), F.lit(1).alias("c"))
    got = {r.x: r.cum_c for r in metrics.running_sums(rows, "x", "c", descending=False, slices=3).collect()}
    assert got == {float(i * i): i + 1 for i in range(100)}


def test_cvar(spark):
    values = F.array(*[F.lit(float(v)) for v in range(50, 141, 10)])
    assert one(spark.range(1).select(episodes.cvar(values, 0.9))) == 50.0


@pytest.mark.parametrize(("n", "starts"), [(512, [0]), (513, [0, 448]), (960, [0, 448]), (961, [0, 448, 896])])
def test_chunk_starts(spark, n, starts):
    assert list(one(spark.range(1).select(T.chunk_starts(F.lit(n))))) == starts


def test_n_step_returns(spark):
    steps = spark.createDataFrame([(0, i, 1.0) for i in range(4)], "e int, s int, r double")
    out = episodes.n_step_returns(steps, "e", "s", "r", 3, 0.5).orderBy("s").collect()
    assert [r.n_step_return for r in out] == [1.75, 1.75, 1.5, 1.0]


def test_velocity(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("b", 5), ("c", 2), ("c", 6)], "k string, s int")
    assert {r.k: r.tx_velocity for r in features.velocity(rows, "k", "s").collect()} == {"a": 0.0, "b": 2.0, "c": 0.5}


def test_triangle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {r.clustering for r in graph.clustering(edges).collect()} == {1.0}
    assert {r.degree_centrality for r in graph.degree_centrality(edges).collect()} == {1.0}
    assert {r.degree_centrality for r in graph.degree_centrality(edges, "half").collect()} == {0.5}


def test_distances_on_a_path(spark):
    edges = spark.createDataFrame([("f", "f", 1), ("f", "x", 0), ("x", "y", 0), ("z", "z", 0)], "src string, dst string, fraud int")
    assert {r.id: r.distance for r in graph.distances(edges, graph.fraud_nodes(edges)).collect()} == {"f": 0, "x": 1, "y": 2}


def test_exact_dedup_keeps_punctuation(spark):
    rows = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "a, b")], "id int, t string")
    assert sorted(r.id for r in corpus.exact_dedup(rows, "t", "id").collect()) == [1, 3]


def test_greedy_keep_is_no_component(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert sorted(r.id for r in corpus.greedy_keep(ids, pairs).collect()) == [1, 3, 4]


def test_html_modes(spark):
    html = F.lit("<p>Hi &amp; bye</p><script>x()</script>")
    compat, strict = spark.range(1).select(T.strip_html(html), T.strip_html(html, "strict")).first()
    assert "x()" in compat and "&" not in compat
    assert "x()" not in strict and "&" in strict


def test_scrub(spark):
    rows = spark.createDataFrame([(1, "mail a@b.com now"), (2, None), (3, "")], "id bigint, t string")
    got = lambda style: {r.id: r.t for r in scrub.scrub(rows, "id", "t", style=style).collect()}
    assert got("mask") == {1: "mail [EMAIL] now", 2: None, 3: ""}
    assert got("remove")[1] == "mail  now"


def test_weighted_copies(spark):
    w = lambda x, u: one(spark.range(1).select(sampling.weighted_copies(F.lit(x), F.lit(u))))
    assert w(3.0, 0.5) == 3 and w(0.25, 0.2) == 1 and w(0.25, 0.3) == 0


def test_balance_keeps_unknown(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate("FFNNNNNUUU")], "id int, k string").withColumn("h", F.md5(F.col("id").cast("string")))
    counts = {r.k: r["count"] for r in sampling.balance(rows, "k", "h", keep=["U"]).groupBy("k").count().collect()}
    assert counts == {"F": 2, "N": 2, "U": 3}


def test_gini(spark):
    assert one(episodes.gini(spark.createDataFrame([(0,), (0,), (10,)], "x int"), "x")) == pytest.approx(2 / 3)


def test_suspicious_patterns(spark):
    acts = F.array(*[F.lit(a) for a in ["login_failed", "login_failed", "login", "add_beneficiary", "transfer_external", "logout"]])
    assert one(spark.range(1).select(corpus.suspicious_patterns(acts))) == ["login_add_beneficiary", "login_failed_login_failed", "multiple_failed_logins", "new_beneficiary_transfer"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "src int, dst int")
    assert {r.id: r.component for r in graph.weakly_connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}

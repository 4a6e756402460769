"""One small test for each finding of the fourth round that changed code."""

import random

import pytest

from ledgerloom.operators import corpus, graph, hops, paths


def test_betweenness_levels_join_nothing(spark, monkeypatch):
    """A level is one shuffle; only the search's start joins nodes with their arcs, however many levels follow."""
    joins = []

    def cut(df):
        joins.append("Join " in df._jdf.queryExecution().optimizedPlan().toString())
        return graph.cut(df)

    monkeypatch.setattr(paths, "cut", cut)
    ring = spark.createDataFrame([(k, (k + 1) % 6) for k in range(6)], "src int, dst int")
    got = {r.id: round(r.betweenness, 6) for r in paths.betweenness(ring, batch_rows=18).collect()}
    assert got == dict.fromkeys(range(6), 0.5)
    assert len(joins) > 20 and sum(joins) <= 2 * 2


def two_kinds(spark):
    """120 payers of 30 payees, each payer of 20 of these."""
    return spark.createDataFrame([(f"C{c}", f"M{(c + k) % 30}") for c in range(120) for k in range(20)], "src string, dst string")


@pytest.mark.parametrize("query", ["k_hop_neighbors", "local_network_features"])
def test_hops_write_few_edges(spark, monkeypatch, query):
    """Edges are written once, not once more for each direction and for the lists that only deal nodes to blocks."""
    rows = []

    def cut(df):
        out = graph_cut(df)
        rows.append(out.count())
        return out

    graph_cut = graph.cut
    monkeypatch.setattr(graph, "cut", cut)
    monkeypatch.setattr(hops, "cut", cut)
    edges = two_kinds(spark)
    if query == "k_hop_neighbors":
        assert hops.two_hops(edges).count() == 120 * 140 + 30 * 110
    else:
        got = {(r.seed[0], r.n, r.m, r.out_mean, r.out_std) for r in graph.local_features(edges, None, 2).collect()}
        assert got == {("C", 140, 1600, 0.0, 0.0), ("M", 110, 1600, 0.0, 0.0)}
    assert max(rows) <= 2400


def test_local_features_of_successors(spark):
    """Mean and deviation of successors' degrees, of which some are 0."""
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("e", None)], "src string, dst string")
    got = {r.seed: (round(r.out_mean, 6), round(r.out_std, 6)) for r in graph.local_features(edges, None, 2).collect()}
    assert got == {"a": (1.0, 0.816497), "b": (0.5, 0.5), "c": (0.0, 0.0), "d": (0.0, 0.0), "e": (0.0, 0.0), None: (0.0, 0.0)}


def test_near_dedup_moves_no_sets_to_find_copies(spark, monkeypatch):
    """Sets stay where they were made while equal ones are found, and short and long ones lose no pair."""
    plans, cut = [], corpus.cut
    monkeypatch.setattr(corpus, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    r = random.Random(3)
    rows = []
    for k in range(60):
        words = [r.choice("abcdefghij") for _ in range(r.choice([1, 3, 4, 9, 30]))]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words)), (3 * k + 2, " ".join([*words, "z"]))]
    kept = []
    for i, t in rows:
        w = t.split()
        s = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or {t}
        if all(len(s & o) / len(s | o) < 0.8 for _, o in kept):
            kept.append((i, s))
    got = corpus.near_dedup(spark.createDataFrame(rows, "id int, text string"), "id", "text", 0.8).collect()
    assert sorted(x.id for x in got) == [i for i, _ in kept]
    assert not any("first(s" in p for p in plans)


def test_edge_vectors_look_for_no_triangles_between_two_kinds(spark, monkeypatch):
    """No edges are written for triangles where no account is both reached and left; else they are counted."""
    from ledgerloom.operators import vectors

    columns = []

    def cut(df):
        columns.append(tuple(df.columns))
        return graph_cut(df)

    graph_cut = graph.cut
    monkeypatch.setattr(graph, "cut", cut)
    tx = lambda pairs: spark.createDataFrame([(a, b, 2.0, k, 0) for k, (a, b) in enumerate(pairs)], "nameOrig string, nameDest string, amount double, step bigint, isMoneyLaundering int")
    edges = lambda t: t.selectExpr("nameOrig AS src", "nameDest AS dst", "amount", "step")
    for pairs, closed in (([("C1", "M1"), ("C1", "M2"), ("C2", "M1"), ("C2", "M2")], 0.0), ([("C1", "C2"), ("C2", "M1"), ("C1", "M1")], 1.0)):
        t = tx(pairs)
        got = vectors.edge_vectors(edges(t), vectors.account_vectors(t, edges(t), distinct=False)).collect()
        assert {(r.src, r.dst) for r in got} == set(pairs) and all(len(r.v) == 42 and r.v[16] == r.v[36] == closed for r in got)
        assert (("a", "b") in columns) == bool(closed)

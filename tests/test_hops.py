"""Two-hop neighbourhoods of all nodes against plain loops, and what they write and shuffle."""

import random

import pytest

from ledgerloom.operators import graph, hops
from ledgerloom.plans import registry  # first, as it imports the others
from ledgerloom.plans import graph as graph_plans


def loops(pairs, wanted):
    around = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            around.setdefault(x, set())
            if None not in (x, y) and x != y:
                around[x].add(y)
    out = {}
    for x in wanted:
        one = around.get(x, set())
        two = {z for y in one for z in around[y]}
        out[x] = {z: 2 for z in two} | {z: 1 for z in one} | {x: 0}
    return out


def dense(n, m, seed):
    r = random.Random(seed)
    return [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]


PARTS = [
    dense(40, 70, 1),
    dense(12, 90, 2),
    [("a", None), ("a", "b"), (None, "c"), ("d", "d"), ("b", "a"), ("e", "c"), ("e", "c")],
    [(f"s{k}", f"d{k // 2}") for k in range(60)] + [(f"c{k}", f"c{k + 1}") for k in range(30)],
    [(f"C{a}", f"M{b}") for a in range(40) for b in range(9) if (a * 7 + b * b) % 5 == 0],
]
#: Graphs beside each other: at random, nearly full, with nulls and loops, in short parts and a chain, of two kinds of nodes.
PAIRS = [tuple(x and f"{k}{x}" for x in p) for k, part in enumerate(PARTS) for p in part]
SOME = {x for k, x in enumerate(sorted({x for p in PAIRS for x in p}, key=str)) if k % 3 == 0} | {"nowhere"}


@pytest.mark.parametrize("block", [2000, 5])
def test_two_hops(spark, monkeypatch, block):
    monkeypatch.setattr(hops, "_BLOCK", block)
    edges = spark.createDataFrame(PAIRS, "src string, dst string")
    wanted, seeds = ({x for p in PAIRS for x in p}, graph.nodes(edges)) if block == 5 else (SOME, spark.createDataFrame([(x,) for x in SOME], "id string"))
    got = [tuple(r) for r in hops.two_hops(edges, seeds).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y, d) for x, near in loops(PAIRS, wanted).items() for y, d in near.items()}


def counted_writes(monkeypatch, rows):
    """Counts the rows that operators write between their steps."""
    write = graph.cut

    def count(df):
        out = write(df)
        rows.append(out.count())
        return out

    for module in (graph, hops):
        monkeypatch.setattr(module, "cut", count)


def star(spark, monkeypatch):
    """300 payers of one payee, so 300 * 300 pairs within two hops."""
    frame = spark.createDataFrame([(f"C{c}", "M1", 1.0, c, 0) for c in range(300)], "src string, dst string, amount double, step bigint, fraud int")
    monkeypatch.setattr(graph_plans, "edges", lambda *_: frame)


def test_k_hop_neighbors_writes_no_pairs(spark, sf_dir, monkeypatch):
    rows = []
    star(spark, monkeypatch)
    counted_writes(monkeypatch, rows)
    assert registry.QUERIES["k_hop_neighbors"](spark, sf_dir).count() == 301 * 301
    assert sum(rows) < 20 * 300


@pytest.mark.parametrize("part", [None, 4])
def test_local_features(spark, part):
    pairs = PAIRS if part is None else [(a, b) for a, b in PAIRS if str(a)[0] == str(part)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    near = loops(pairs, {x for p in pairs for x in p})
    got = {r.seed: (r.n, r.m) for r in graph.local_features(edges, graph.nodes(edges), 2).collect()}
    assert got == {x: (len(ball), sum(None not in (a, b) and a in ball and b in ball for a, b in set(pairs))) for x, ball in near.items()}


def test_local_network_features_writes_no_pairs(spark, sf_dir, monkeypatch):
    rows = []
    star(spark, monkeypatch)
    counted_writes(monkeypatch, rows)
    got = {r.seed: (r.n, r.m, r.density) for r in registry.QUERIES["local_network_features"](spark, sf_dir).collect()}
    assert got == {x: (301, 300, 0.003322) for x in ["M1", *(f"C{c}" for c in range(300))]}
    assert sum(rows) < 20 * 300

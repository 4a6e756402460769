"""Property graphs as two DataFrames: vertices(id, ...) and edges(src, dst, ...).

Iterative operators write each round to shared storage (``cut``) instead of growing the lineage,
so a lost executor costs a round's reread and not the whole history.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder of spark.checkpoint.dir and read back (a temporary folder only where that is unset)."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
        at = spark.sparkContext.getCheckpointDir()
    path = f"{at.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def last_edges(tx: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each (nameOrig, nameDest): the last row by ``order`` wins; an aggregate, so map tasks keep one row a pair."""
    row = F.struct(*order, "isMoneyLaundering")
    last = tx.groupBy(F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst")).agg(F.max(row).alias("r"))
    return last.select("src", "dst", F.col("r.amount").alias("amount"), F.col("r.step").alias("step"), F.col("r.isMoneyLaundering").alias("fraud"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame, *, distinct: bool = True) -> DataFrame:
    """(id, in_degree, out_degree, degree) over distinct edges, in one shuffle of partial counts. With ``distinct`` false the edges are known to be."""
    pairs = edges.select("src", "dst")
    pairs = pairs.distinct() if distinct else pairs
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame, norm: str = "nx") -> DataFrame:
    """degree / (n - 1), or half of that (norm 'half')."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    scale = (F.col("n") - 1) * (1 if norm == "nx" else 2)
    return d.join(F.broadcast(n)).select("id", F.when(F.col("n") > 1, F.col("degree") / scale).otherwise(0.0).alias("degree_centrality"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b; self-loops excluded."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) once each. Edges point from the end of lower degree to the other, so that a hub has few outgoing ones.

    Of the pairs of edges that leave a node, only those are made whose first one ends where another begins: without
    triangles of this kind, as between two kinds of accounts, there are few of them or none.
    """
    und = cut(undirected(edges))
    return _closed(und, _ends(und, "d"))


def _ends(und: DataFrame, into: str) -> DataFrame:
    return und.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias(into))


def _closed(und: DataFrame, deg: DataFrame) -> DataFrame:
    """Triangles of distinct undirected edges (a, b) and their ends' degrees (id, d)."""
    both = und.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    arcs = cut(arcs)
    xy = cut(arcs.join(arcs.select(F.col("x").alias("y")).distinct(), "y", "left_semi").select("x", "y"))
    xz, yz = arcs.select("x", F.col("y").alias("z")), arcs.select(F.col("x").alias("y"), F.col("y").alias("z"))
    return xy.join(xz, "x").where("y <> z").join(yz, ["y", "z"]).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, triangles, clustering) of the undirected projection: 2T / (k (k - 1)), 0 below two neighbours."""
    und = cut(undirected(edges))
    k = cut(_ends(und, "k"))
    t = _closed(und, k.select("id", F.col("k").alias("d"))).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    rows = nodes(edges).join(k, "id", "left").join(t, "id", "left").fillna(0, ["k", "t"])
    return rows.select("id", F.col("t").alias("triangles"), F.when(F.col("k") >= 2, 2 * F.col("t") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def graph_statistics(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.agg(F.count("*").alias("n"), F.sum("out_degree").alias("m"), F.avg("in_degree").alias("avg_in"), F.avg("out_degree").alias("avg_out"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out")).withColumn(
        "density", F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    )


def neighbor_degree_avg(edges: DataFrame) -> DataFrame:
    """(id, in_avg, out_avg): mean in-degree of in-neighbours, mean out-degree of out-neighbours; 0 without any."""
    d, pairs = degrees(edges), edges.select("src", "dst").distinct()
    ins = pairs.join(d.select(F.col("id").alias("src"), "in_degree"), "src").groupBy(F.col("dst").alias("id")).agg(F.avg("in_degree").alias("in_avg"))
    outs = pairs.join(d.select(F.col("id").alias("dst"), "out_degree"), "dst").groupBy(F.col("src").alias("id")).agg(F.avg("out_degree").alias("out_avg"))
    return d.select("id").join(ins, "id", "left").join(outs, "id", "left").fillna(0.0)


def fraud_nodes(edges: DataFrame) -> DataFrame:
    return nodes(edges.where("fraud = 1"))


def both_ways(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst")
    return pairs.union(pairs.select("dst", "src")).where("src <> dst").distinct()


def distances(edges: DataFrame, seeds: DataFrame, *, most: int | None = None, by_seed: bool = False) -> DataFrame:
    """(id, distance) of what seeds reach over undirected edges, or (seed, id, distance) for each seed.

    Breadth first: each round joins the frontier with the edges and drops what has been seen. It
    ends with an empty frontier, or after ``most`` rounds.
    """
    keys = ["seed", "id"] if by_seed else ["id"]
    start = seeds.select("id").distinct()
    frontier = cut(start.select(F.col("id").alias("seed"), "id") if by_seed else start)
    around = cut(both_ways(edges))
    seen, k = frontier.withColumn("distance", F.lit(0)), 0
    while (most is None or k < most) and not frontier.isEmpty():
        k += 1
        step = frontier.join(around, frontier["id"] == around["src"]).select(*[c for c in keys if c != "id"], F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select(*keys), keys, "left_anti"))
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(k)))
    return seen


def local_features(edges: DataFrame, seeds: DataFrame | None, hops: int) -> DataFrame:
    """(seed, n, m, density, out_mean, out_std) of the subgraph that each seed's neighbourhood induces; all nodes are seeds if none are given.

    ``out_mean`` and ``out_std`` are over the whole graph's out-degrees of the seed's successors. For two hops neighbourhoods are only
    counted (``hops.two_hop_features``); for other numbers they are listed.
    """
    pairs = cut(edges.select("src", "dst").distinct())
    every = seeds is None
    seeds = nodes(pairs) if every else seeds
    if hops == 2:
        from ledgerloom.operators.hops import two_hop_features

        sizes = two_hop_features(pairs, seeds)
    else:
        around = cut(distances(pairs, seeds, most=hops, by_seed=True).select("seed", "id"))
        inside = around.join(pairs, around["id"] == pairs["src"]).select("seed", "src", "dst").join(around.select("seed", F.col("id").alias("dst")), ["seed", "dst"])
        m = inside.groupBy("seed").agg(F.count("*").alias("m"))
        sizes = around.groupBy("seed").agg(F.count("*").alias("n")).join(m, "seed", "left")
    # Only successors that have successors add to a sum; they are written, so that pairs are not shuffled where these are few.
    onward = cut(degrees(pairs, distinct=False).where("in_degree > 0 AND out_degree > 0").select(F.col("id").alias("dst"), "out_degree"))
    theirs = pairs if every else seeds.select(F.col("id").alias("src")).distinct().join(pairs, "src")
    number = theirs.where("dst IS NOT NULL").groupBy(F.col("src").alias("seed")).agg(F.count("*").alias("k"))
    sums = theirs.join(onward, "dst").groupBy(F.col("src").alias("seed")).agg(F.sum("out_degree").alias("s"), F.sum(F.col("out_degree") * F.col("out_degree")).alias("q"))
    spread = F.sqrt(F.col("k") * F.col("q") - F.col("s") * F.col("s")) / F.col("k")
    successors = number.join(sums, "seed", "left").select("seed", (F.col("s") / F.col("k")).alias("out_mean"), spread.alias("out_std"))
    rows = sizes.join(successors, "seed", "left").fillna(0)
    return rows.select("seed", "n", "m", F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"), "out_mean", "out_std")


def weakly_connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id that undirected edges reach. Alternating large and small stars over edges only, which are made once and written."""
    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.union(e.select("v", "u"))
        if small:
            least = e.groupBy("u").agg(F.min("v").alias("m"))
            moved = e.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        else:
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    edges = cut(edges.select("src", "dst").distinct())
    now = cut(undirected(edges).select(F.col("b").alias("u"), F.col("a").alias("v")))
    before = mark(now)
    for _ in range(most_rounds):
        now = cut(star(star(now, False), True))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components were not stable after {most_rounds} rounds")
    return nodes(edges).join(now, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def _fans(arcs: DataFrame, what: Column, most: int = 1000) -> DataFrame:
    """(src, d, to): lists ``to`` of about ``most`` targets at most, of arcs (src, dst, d) with the source's number of arcs ``d``; written once."""
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("d") / most))
    return cut(arcs.groupBy("src", "d", part.alias("part")).agg(F.collect_list(what).alias("to")).drop("part"))


def pagerank(edges: DataFrame, *, rounds: int = 10, alpha: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds: weights by edge multiplicity 1, dangling mass spread evenly.

    A round is one join of ranks with edges (both partitioned by id) and one aggregate with map-side sums. Edges are held
    as lists of a source's targets (``_fans``), so a round shuffles and sorts a row for each list.
    """
    edges = cut(edges.select("src", "dst").distinct())
    pairs = edges
    out = cut(pairs.groupBy("src").agg(F.count("*").alias("d")))
    arcs = _fans(pairs.join(out, "src"), F.col("dst"))
    ids = cut(nodes(edges).join(out.select(F.col("src").alias("id"), "d"), "id", "left"))
    n = ids.count()
    ranks = ids.select("id", "d", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        dangling = ranks.where("d IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = arcs.join(ranks.select(F.col("id").alias("src"), "rank"), "src").select(F.explode("to").alias("id"), (F.col("rank") / F.col("d")).alias("part"))
        sent = given.groupBy("id").agg(F.sum("part").alias("got"))
        ranks = cut(ids.join(sent, "id", "left").join(F.broadcast(dangling)).select("id", "d", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
    return ranks.select("id", "rank")


def temporal_neighbors(edges: DataFrame, frontier: DataFrame, k: int) -> DataFrame:
    """(id, dst, step, r): of each (id, at) in the frontier, the first k edges that are not before it, by step then target."""
    ahead = frontier.join(edges, (F.col("id") == F.col("src")) & (F.col("step") >= F.col("at")))
    ranked = ahead.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("step", "dst")))
    return ranked.where(F.col("r") <= k).select("id", "dst", "step", "r")


def temporal_paths(edges: DataFrame, second: DataFrame) -> DataFrame:
    """Two-hop paths a -> b -> c whose second step is not before the first."""
    a = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("step").alias("s1"))
    b = second.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("step").alias("s2"))
    return a.join(b, "b").where("s2 >= s1").select("a", "b", "c", "s1", "s2")


def entity_split(ids: DataFrame, h, test: float = 0.2, validation: float = 0.1) -> DataFrame:
    """(id, split) by hash: a number in [0, 1) from the digest against the cut points, so no global rank is needed."""
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return ids.select("id", F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train").alias("split"))


def entity_disjoint_edges(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Edges whose two ends are in one split; the others are dropped."""
    s, d = splits.select(F.col("id").alias("src"), "split"), splits.select(F.col("id").alias("dst"), F.col("split").alias("split_d"))
    return edges.join(s, "src").join(d, "dst").where("split = split_d").drop("split_d")


def leakage(train: DataFrame, test: DataFrame) -> DataFrame:
    """(train_nodes, test_nodes, shared, shared_ratio, inside): accounts of both, and test edges whose ends train has both."""
    a, b = nodes(train), nodes(test)
    shared = a.intersect(b).agg(F.count("*").alias("shared"))
    known = a.select(F.col("id").alias("src")), a.select(F.col("id").alias("dst"))
    inside = test.join(known[0], "src", "left_semi").join(known[1], "dst", "left_semi").agg(F.count("*").alias("inside"))
    one = a.agg(F.count("*").alias("train_nodes")).join(b.agg(F.count("*").alias("test_nodes"))).join(shared).join(inside)
    return one.withColumn("shared_ratio", F.when(F.col("test_nodes") == 0, 0.0).otherwise(F.col("shared") / F.col("test_nodes")))


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, weight): distinct edges of both, weight 2 where both have it."""
    each = a.select("src", "dst").distinct().union(b.select("src", "dst").distinct())
    return each.groupBy("src", "dst").agg(F.when(F.count("*") > 1, 2).otherwise(1).alias("weight"))


def edge_index(edges: DataFrame) -> DataFrame:
    """(src_index, dst_index, src, dst) with contiguous node numbers in order of id, without a global sort in one task.

    Ids are range-partitioned; a short table of partition sizes gives each partition its first number.
    """
    ids = cut(nodes(edges).repartitionByRange("id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id()))
    sizes = ids.groupBy("p").agg(F.count("*").alias("n"))
    starts = sizes.select("p", (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias("start"))
    numbered = ids.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("id"))).join(F.broadcast(starts), "p").select("id", (F.col("start") + F.col("r") - 1).alias("i"))
    s, d = numbered.select(F.col("id").alias("src"), F.col("i").alias("src_index")), numbered.select(F.col("id").alias("dst"), F.col("i").alias("dst_index"))
    return edges.select("src", "dst").distinct().join(s, "src").join(d, "dst").select("src_index", "dst_index", "src", "dst")


def neighbourhoods(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, distance) of what the start nodes (seed, id) of each seed reach over undirected edges in ``hops`` steps."""
    frontier = cut(seeds.select("seed", "id").distinct())
    around = cut(both_ways(edges))
    seen = frontier.withColumn("distance", F.lit(0))
    for k in range(1, hops + 1):
        step = frontier.join(around, frontier["id"] == around["src"]).select("seed", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(k)))
    return seen


def capped_subgraphs(edges: DataFrame, seeds: DataFrame, hops: int, most: int) -> DataFrame:
    """(seed, src, dst): edges among the ``most`` nodes nearest to a seed, ties by id; a map task keeps no more than that of a seed."""
    ranked = neighbourhoods(edges, seeds, hops).withColumn("r", F.row_number().over(W.partitionBy("seed").orderBy("distance", "id")))
    kept = cut(ranked.where(F.col("r") <= most).select("seed", "id"))
    pairs = edges.select("src", "dst").distinct()
    inside = kept.join(pairs, kept["id"] == pairs["src"]).select("seed", "src", "dst")
    return inside.join(kept.select("seed", F.col("id").alias("dst")), ["seed", "dst"]).select("seed", "src", "dst")


def fraud_subgraphs(edges: DataFrame, hops: int = 1, least: int = 3, most: int = 500) -> DataFrame:
    """(src, dst, nodes, edges) of the neighbourhood of each fraud edge, if it has ``least`` to ``most`` nodes.

    An end with ``most`` neighbours or more makes a neighbourhood too large, so such edges go before any neighbourhood is listed; sizes
    are counted before edges are joined.
    """
    fraud = edges.where("fraud = 1").select("src", "dst").distinct().withColumn("seed", F.xxhash64("src", "dst"))
    if hops > 0:
        full = cut(both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= most).select("id"))
        for end in ("src", "dst"):
            fraud = fraud.join(full.withColumnRenamed("id", end), end, "left_anti")
    fraud = cut(fraud.select("src", "dst", "seed"))
    ends = fraud.select("seed", F.explode(F.array("src", "dst")).alias("id"))
    around = cut(neighbourhoods(edges, ends, hops).select("seed", "id"))
    sized = around.groupBy("seed").agg(F.count("*").alias("nodes")).where(F.col("nodes").between(least, most))
    kept = cut(around.join(sized.select("seed"), "seed", "left_semi"))
    pairs = edges.select("src", "dst").distinct()
    inside = kept.join(pairs, kept["id"] == pairs["src"]).select("seed", "dst").join(kept.select("seed", F.col("id").alias("dst")), ["seed", "dst"])
    counted = inside.groupBy("seed").agg(F.count("*").alias("edges"))
    return fraud.join(sized, "seed").join(counted, "seed").select("src", "dst", "nodes", "edges")


def weighted_pagerank(edges: DataFrame, *, weight: str, alpha: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """(id, rank, score): ranks by weighted edges until they change by less than nodes * tolerance in all, dangling mass spread evenly.

    ``score`` is the rank times 1 + ln(1 + out-degree / max(in-degree, 1)). A RuntimeError if the ranks don't settle.
    """
    pairs = cut(edges.groupBy("src", "dst").agg(F.sum(weight).alias("w")))
    out = cut(pairs.groupBy("src").agg(F.sum("w").alias("total"), F.count("*").alias("d")))
    shares = pairs.join(out, "src").select("src", "dst", "d", F.when(F.col("total") > 0, F.col("w") / F.col("total")).alias("share"))
    arcs = _fans(shares, F.struct("dst", "share"))
    ids = cut(nodes(pairs).join(out.where("total > 0").select(F.col("src").alias("id"), "total"), "id", "left"))
    n = ids.count()
    ranks = ids.select("id", "total", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(most_rounds):
        lost = ranks.where("total IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = arcs.join(ranks.select(F.col("id").alias("src"), "rank"), "src").select("rank", F.explode("to").alias("to"))
        sent = given.groupBy(F.col("to.dst").alias("id")).agg(F.sum(F.col("rank") * F.col("to.share")).alias("got"))
        joined = ranks.withColumnRenamed("rank", "before").join(sent, "id", "left").join(F.broadcast(lost))
        ranks = cut(joined.select("id", "total", "before", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
        if ranks.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("before"))), F.lit(0.0))).first()[0] < n * tolerance:
            break
        ranks = ranks.drop("before")
    else:
        raise RuntimeError(f"ranks did not settle in {most_rounds} rounds")
    d = degrees(pairs)
    return ranks.join(d, "id").select("id", "rank", (F.col("rank") * (1 + F.log1p(F.col("out_degree") / F.greatest("in_degree", F.lit(1))))).alias("score"))


def flagged_above(scores: DataFrame, share: float) -> DataFrame:
    """``scores`` with ``flagged``: 1 from the percentile ``share`` on (interpolated)."""
    limit = scores.agg(F.percentile("score", share).alias("__limit"))  # one row
    return scores.join(F.broadcast(limit)).withColumn("flagged", (F.col("score") >= F.col("__limit")).cast("int")).drop("__limit")


def component_sizes(edges: DataFrame) -> DataFrame:
    """One row: weakly connected components and the size of the largest."""
    each = weakly_connected(edges).groupBy("component").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("components"), F.max("n").alias("largest"))


def valid_observation(n: Column, ends: Column) -> Column:
    """Whether all node numbers of an observation's edges are below its number of nodes, and none is negative."""
    return F.forall(ends, lambda i: (i >= 0) & (i < n))


def unbatched(batch: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph, node, first) of batched rows (at): each row's graph and its number there, from each graph's first number and size.

    Graphs are ranges laid end to end; a row finds its graph by equality of numbers, as each range lists its own.
    """
    ranges = starts.select("graph", "first", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
    return batch.join(ranges, "at").select("graph", (F.col("at") - F.col("first")).alias("node"), (F.col("at") == F.col("first")).alias("is_first"))


def candidate_proposals(edges: DataFrame, visited: DataFrame, proposed: DataFrame, *, by: str | None = None) -> DataFrame:
    """(id): targets of edges from visited nodes (id) that are neither visited nor proposed (id) yet; with ``by``, of each of its values on its own."""
    keys = [by, "id"] if by else ["id"]
    ahead = edges.select(F.col("src").alias("id"), "dst").distinct().join(visited.select(*keys).distinct(), "id").select(*([by] if by else []), F.col("dst").alias("id")).distinct()
    return ahead.join(visited.select(*keys).distinct(), keys, "left_anti").join(proposed.select(*keys).distinct(), keys, "left_anti")

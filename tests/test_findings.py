"""What a review found: queries against their SQL on small tables of awkward rows, and steps that grew faster than their input."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import registry


@pytest.fixture
def beside(spark, same, tmp_path):
    """Writes tables and holds a query against its SQL on them; gives the query's rows."""

    def check(name: str, **tables: pd.DataFrame) -> pd.DataFrame:
        con = duckdb.connect()
        for table, rows in tables.items():
            at = f"{tmp_path}/{table}.parquet"
            rows.to_parquet(at, coerce_timestamps="us")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}'")
        ours = registry.QUERIES[name](spark, os.fspath(tmp_path)).toPandas()
        same(ours, con.execute(registry.ORACLES[name]).df())
        return ours

    return check


def test_json_nulls_where_others_have_arrays(beside):
    whole = '{"k": 1, "device": {"os": "tv", "ver": "1.2"}, "tags": ["a"], "items": [{"sku": 1, "qty": 2}]}'
    props = [whole, '{"k": "7", "tags": null}', '{"k": null, "items": null}', '{"tags": ["é", null], "items": []}', "{broken", None, "[]"]
    got = beside("json_flatten", clicks=pd.DataFrame({"click_id": range(len(props)), "props": props}))
    assert got.set_index("click_id").meta_tags[1] == "null"


def test_observations_without_an_edge_have_no_row(beside):
    # The nineteen least of those near 50 are customers whom only 60 meets, and 60 is not among them.
    meets = [(50, 60), *[(60, i) for i in range(1, 25)]]
    lines = pd.DataFrame([(2 * k + j, k) for k in range(len(meets)) for j in range(2)], columns=["l_orderkey", "l_suppkey"]).assign(l_linenumber=1, l_partkey=1, l_quantity=1.0, l_extendedprice=1.0, l_returnflag="N")
    orders = pd.DataFrame([(2 * k + j, m[j]) for k, m in enumerate(meets) for j in range(2)], columns=["o_orderkey", "o_custkey"]).assign(o_orderdate=pd.Timestamp("1995-02-01"))
    customers = pd.DataFrame({"c_custkey": sorted({i for m in meets for i in m})}).assign(c_acctbal=1.0, c_mktsegment="x")
    got = beside("graph_obs_edges", lineitem=lines, orders=orders, customer=customers)
    assert 50 not in set(got.center) and 60 in set(got.center)


def test_pages_share_a_table_and_files_are_bounded(spark, tmp_path):
    from ledgerloom.sources import pdf

    texts = [f"page {k}\nhalf 𝔸 é" for k in range(7)]
    file = pdf.Pdf(b"".join(pdf.pdf_parts(iter(texts))))
    assert [file.text(p) for p in file.pages()] == texts and len(file.tables) == 1
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    listed = pdf.write_pdf(rows, "t", f"file://{tmp_path}/out", most_pages=3).collect()
    assert sorted(r.pages for r in listed) == [1, 3, 3]
    assert sorted(r.text for r in pdf.read_pdf(spark, f"{tmp_path}/out").collect()) == texts


def test_no_pairs_of_edges_between_two_kinds_of_nodes(spark, monkeypatch):
    from ledgerloom.operators import graph

    written = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(cut(df)) or written[-1])
    both = [(f"C{c}", f"M{m}") for c in range(30) for m in range(3)]
    edges = spark.createDataFrame([*both, ("M0", "M1"), ("M1", "M2"), ("M2", "M0")], "src string, dst string")
    got = {r.id: (r.triangles, round(r.clustering, 6)) for r in graph.clustering(edges).collect()}
    assert got["C7"] == (3, 1.0) and got["M1"] == (61, round(2 * 61 / (32 * 31), 6))
    written.clear()
    assert graph.triangles(edges.where("src LIKE 'C%'")).count() == 0 and written[-1].isEmpty()


def test_fraud_edges_of_full_nodes_go_before_neighbourhoods(spark, monkeypatch):
    from ledgerloom.operators import graph

    seeds = []
    listed = graph.neighbourhoods
    monkeypatch.setattr(graph, "neighbourhoods", lambda e, s, h: seeds.append(s.select("seed").distinct().count()) or listed(e, s, h))
    edges = spark.createDataFrame([*[(f"C{k}", "M0", 1) for k in range(9)], ("C0", "M1", 1), ("C20", "M2", 1), ("C21", "M2", 0)], "src string, dst string, fraud int")
    got = sorted(tuple(r) for r in graph.fraud_subgraphs(edges, most=9).collect())
    assert got == [("C0", "M1", 3, 2), ("C20", "M2", 3, 2)] and seeds == [2]


def test_texts_pass_in_short_batches(spark):
    from ledgerloom.operators import scrub, tokens

    rows = spark.createDataFrame([(k, "a@b.cd", [7, 8, 9]) for k in range(3)], "id bigint, t string, ids array<int>")
    for made in (lambda: scrub.scrub(rows, "id", "t"), lambda: tokens.span_batches(rows.select("id", "ids"), "ids", "id", 100, sentinels=True)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert made().count() == 3 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_lists_of_targets_are_bounded_and_whole(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators import graph

    arcs = spark.createDataFrame([*[(0, k, 500) for k in range(500)], (1, 0, 1)], "src int, dst int, d bigint")
    lists = [(r.src, sorted(r.to)) for r in graph._fans(arcs, F.col("dst"), most=50).collect()]
    assert sorted((s, x) for s, to in lists for x in to) == sorted((r.src, r.dst) for r in arcs.collect()) and max(len(to) for _, to in lists) < 100


def test_signatures_are_the_minima_of_each_permutation(spark):
    """Rows that are cut anywhere, empty and null ones, and values at the modulus; no shingle is shuffled."""
    import hashlib

    import numpy as np
    from pyspark.sql import functions as F

    from ledgerloom.operators import minhash

    rows = [(i, [f"s{i * j % 97}" for j in range(n)]) for i, n in enumerate([3, 0, 1, 40, 7, 200, 2])] + [(7, None)]
    signed = minhash.signatures(spark.createDataFrame(rows, "id bigint, s array<string>"), "id", F.col("s"), 16, most=50)
    assert "Exchange" not in signed._jdf.queryExecution().executedPlan().toString()
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % minhash.PRIME
    want = {i: [min((a * number(x) + b) % minhash.PRIME for x in s) for a, b in minhash.coefficients(16)] for i, s in rows if s}
    assert {r.id: r.signature for r in signed.collect()} == want
    edge = np.array([0, 1, minhash.PRIME - 1, minhash.PRIME - 2])
    assert minhash._minima(edge, np.arange(4), 8).tolist() == [[(a * int(x) + b) % minhash.PRIME for a, b in minhash.coefficients(8)] for x in edge]


def test_components_make_their_edges_once(spark, tmp_path):
    """The edges' own source is in no plan of what is returned; a loop alone is a component."""
    from ledgerloom.operators import graph

    spark.createDataFrame([(1, 2), (3, 2), (8, 9), (5, 5), (9, 8)], "src int, dst int").write.parquet(f"{tmp_path}/edges")
    out = graph.weakly_connected(spark.read.parquet(f"{tmp_path}/edges"))
    assert not any(str(tmp_path) in f for f in out.inputFiles())
    assert {r.id: r.component for r in out.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}


def test_episodes_of_one_bucket_are_told_apart(spark, tmp_path):
    """Episodes over three micro-batches in one bucket: one ends in the second and begins anew, one never ends, keys and values may be null."""
    from ledgerloom.streaming import dedup as stream

    schema = "k string, v double, h int, d boolean"
    batches = [[("a", 1.0, 1, False), ("b", 2.0, 0, False), (None, 3.0, 1, None)], [("a", None, 1, True), ("c", 5.0, 1, False)], [("a", 7.0, 0, True), (None, 0.5, None, True), ("b", 1.5, 1, True)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for b in (1, 1024):
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = stream.run_once(stream.finished_episodes(source, "k", "v", "h", "d", buckets=b), f"{tmp_path}/out{b}", "append", f"{tmp_path}/state{b}")
        got = [tuple(r) for r in out.collect()]
        assert sorted(got, key=str) == sorted([("a", 2, 1.0, 2), ("a", 1, 7.0, 0), ("b", 2, 3.5, 1), (None, 2, 3.5, 1)], key=str)


def test_words_and_draws_are_made_once(spark, sf_dir):
    """Texts are split once for shingles and once for token ids; whole words are masked as a loop masks them, null ids and one word among them."""
    import hashlib

    from pyspark.sql import functions as F

    from ledgerloom.functions import text as T
    from ledgerloom.operators import tokens

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select(T.word_shingles(T.dedup_key_text(F.col("text"))).alias("s"))).count("split(") == 1
    assert plan(registry.QUERIES["whole_word_collator"](spark, sf_dir)).count("split(") == 1
    rows = [(0, list(range(9)), [None, 0, 0, 1, 5, 5, 7, 8, None]), (1, [6], [0]), (2, [6, 7], [None, None]), (3, list(range(60)), [i // 3 for i in range(60)])]
    df = spark.createDataFrame(rows, "k int, ids array<int>, words array<int>").withColumn("k", F.col("k").cast("string"))
    got = {r.k: (r.input_ids, r.labels) for r in tokens.whole_words(df, "ids", "words", "k").collect()}
    for k, ids, words in rows:
        draws = sorted((int(hashlib.md5(f"w:{k}:{w}".encode()).hexdigest()[:8], 16), w) for w in {*words} - {None})
        chosen = {w for _, w in draws[: max(1, int(len(draws) * 0.15))]}
        assert got[str(k)] == ([4 if w in chosen else x for x, w in zip(ids, words)], [x if w in chosen else -100 for x, w in zip(ids, words)])


def test_sets_are_joined_only_in_buckets_of_several_classes(spark, monkeypatch):
    from ledgerloom.operators import corpus

    written, cut = [], corpus.cut
    monkeypatch.setattr(corpus, "cut", lambda df: written.append(cut(df)) or written[-1])
    same = " ".join(f"a{i:02}" for i in range(60))
    rows = [(1, same), (2, f"{same} z"), (3, same.upper()), (4, "one two three four"), (5, "one two three four"), (6, None), (7, ""), (8, "")]
    got = {(r.a, r.b): r.similarity for r in corpus.bucket_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text", 0.85).collect()}
    assert got == {(1, 2): 58 / 59, (1, 3): 1.0, (2, 3): 58 / 59, (4, 5): 1.0, (7, 8): 1.0}
    assert [len(f.collect()) for f in written if f.columns == ["bucket", "k", "s"]] == [2]


def test_shingles_of_one_class_are_not_gathered(spark, monkeypatch):
    """They go before the others of a set are listed, not after."""
    from ledgerloom.operators import corpus

    plans, cut = [], corpus.cut
    monkeypatch.setattr(corpus, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    corpus.near_dedup(spark.createDataFrame([(1, "a b c d"), (2, "a b c d e")], "id int, text string"), "id", "text", 0.85)
    plan = next(p for c, p in plans if c == ["id", "n", "h"])
    assert plan.index("collect_list") < plan.rindex("> 1)")


def test_roles_make_their_transactions_once(spark):
    from ledgerloom.operators import features

    tx = spark.createDataFrame([("C1", "M1", 2.0, 5, 0), ("C1", "C1", None, 7, 1)], "nameOrig string, nameDest string, amount double, step bigint, isMoneyLaundering int")
    out = features.roles(tx)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("C1", True, 2.0, 5, 0), ("M1", False, 2.0, 5, 0), ("C1", True, None, 7, 1), ("C1", False, None, 7, 1)], key=str)

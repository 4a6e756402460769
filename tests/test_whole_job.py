"""Queries that must read the whole of their input: answers worked out by brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import features
from ledgerloom.plans import registry  # first, as it imports the others
from ledgerloom.plans import graph as graph_plans, texts

#: More than 400 characters, none of them ASCII only, before anything is found.
LONG = "Grüße über größere Beträge. " * 40
LATE = 'Structuring through a shell company.\nAll rights reserved.\nSent from my iPhone\nBakker LLC paid "Späte Müller" for a casino night; the fraud was material weakness.'


@pytest.fixture
def long_documents(spark, tmp_path):
    rows = [(8 * k, LONG + "\n" + LATE if k else LONG, "de", "src0", len(LONG)) for k in range(2)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), {i: f"{t}\n{texts.PHRASES[0]}" for i, t, *_ in rows}


def test_narratives_are_whole(spark, long_documents):
    at, expected = long_documents
    assert {r.doc_id: r.text for r in texts.narratives(spark, at).collect()} == expected


@pytest.mark.parametrize(("name", "column"), [("typology_tags", "typologies"), ("indicators", "indicators"), ("keyword_typologies", "typologies"), ("red_flags", "flags"), ("fraud_language", "patterns"), ("payment_categories", "sensitive"), ("extract_entities", "entities")])
def test_hits_far_into_a_document(spark, long_documents, name, column):
    at, whole = long_documents
    got = {r.doc_id: r[column] for r in registry.QUERIES[name](spark, at).collect()}
    low = {i: t.lower() for i, t in whole.items()}
    brute = {
        "typology_tags": lambda i: [n for n, p in T.TYPOLOGIES.items() if re.search(p, low[i])],
        "indicators": lambda i: [p for p in T.INDICATORS if p in low[i]],
        "keyword_typologies": lambda i: [n for n, ks in T.KEYWORDS.items() if any(k in low[i] for k in ks)],
        "red_flags": lambda i: sorted({m[0] for p in T.RED_FLAGS for m in re.finditer(p, low[i])}),
        "fraud_language": lambda i: [p for p in T.FRAUD_LANGUAGE if re.search(p, low[i])],
        "payment_categories": lambda i: [n for n, ps in T.SENSITIVE.items() if any(re.search(p, low[i]) for p in ps)],
    }
    if name == "extract_entities":
        assert "Bakker LLC" in got[8].split("|") and "Späte Müller" in got[8].split("|")
    else:
        assert {i: got[i].split("|") if got[i] else [] for i in whole} == {i: brute[name](i) for i in whole}


def test_counts_and_lines_far_into_a_document(spark, long_documents):
    at, whole = long_documents
    risks = {(r.doc_id, r.risk): r.n for r in registry.QUERIES["risk_pattern_counts"](spark, at).collect()}
    brute = {(i, n): len(re.findall(p, t.lower())) for i, t in whole.items() for n, p in T.RISKS.items()}
    assert risks == {k: n for k, n in brute.items() if n}
    themes = {r.theme: r.n for r in registry.QUERIES["theme_distribution"](spark, at).collect()}
    found = [n for t in whole.values() for n, p in T.TYPOLOGIES.items() if re.search(p, t.lower())]
    assert themes == {n: found.count(n) for n in found}
    for name in ("strip_lines_matching", "clean_email", "clean_general"):
        h = {r.doc_id: r.h for r in registry.QUERIES[name](spark, at).collect()}
        assert h[0] != h[8]


@pytest.fixture
def events(spark, tmp_path):
    rows = [(k, k, k % 2, ["view", "click", "buy"][k % 3], float(k)) for k in range(1, 200)]
    spark.createDataFrame(rows, "event_id bigint, ts bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), rows


def test_sequences_have_all_events(spark, events):
    at, rows = events
    known = list(texts.corpus.ACTIONS)
    acts = {u: [known[k % len(known)] for k, _, user, *_ in rows if user == u] for u in (0, 1)}
    assert {r.user_id: r.actions for r in texts.actions(spark, at).collect()} == acts
    got = {r.user_id: r.text for r in registry.QUERIES["action_sequence_text"](spark, at).collect()}
    assert got == {u: " → ".join(f"{a} ({texts.corpus.ACTIONS[a]})" for a in x) for u, x in acts.items()}
    flags = {r.user_id: set(r.patterns.split("|")) - {""} for r in registry.QUERIES["suspicious_patterns"](spark, at).collect()}
    for u, x in acts.items():
        assert {"_".join(p[:2]) for p in texts.corpus.SUSPICIOUS if " ".join(p) in " ".join(x)} <= flags[u]


def test_multi_hot_has_all_kinds(spark, tmp_path):
    rows = [(1, 1, 5, "buy", 1.0), (7, 2, 5, "view", 1.0), (8, 3, 6, "click", 1.0)]
    spark.createDataFrame(rows, "event_id bigint, ts bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.hot for r in registry.QUERIES["multi_hot_encode"](spark, str(tmp_path)).collect()}
    assert got == {5: "101", 6: "010"}


@pytest.fixture
def payments(spark, monkeypatch):
    """Edges in place of the star schema's: customers C2 to C9, suppliers M1 to M4."""
    rows = [(f"C{c}", f"M{s}", float(c), 10 * c + s, int(c == 2)) for c in range(2, 10) for s in range(1, 5) if (c * s) % 3 == 1 or c == s]
    frame = spark.createDataFrame(rows, "src string, dst string, amount double, step bigint, fraud int")
    monkeypatch.setattr(graph_plans, "edges", lambda *_: frame)
    return rows


def test_neighbourhoods_of_all_nodes(spark, sf_dir, payments):
    around = {}
    for s, d, *_ in payments:
        around.setdefault(s, set()).add(d)
        around.setdefault(d, set()).add(s)
    one = {(x, y) for x in around for y in around[x]}
    two = {(x, z) for x, y in one for z in around[y]} - one - {(x, x) for x in around}
    expected = {(x, x, 0) for x in around} | {(*p, 1) for p in one} | {(*p, 2) for p in two}
    assert {tuple(r) for r in registry.QUERIES["k_hop_neighbors"](spark, sf_dir).select("seed", "id", "distance").collect()} == expected
    inside = {x: {y for s, y, _ in expected if s == x} for x in around}
    got = {r.seed: (r.n, r.m) for r in registry.QUERIES["local_network_features"](spark, sf_dir).collect()}
    assert got == {x: (len(i), sum(s in i and d in i for s, d, *_ in payments)) for x, i in inside.items()}


def test_near_dedup_misses_no_pair(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(20):
        words = [f"w{x}" for x in rng.integers(0, 400, 120)]
        rows.append((4 * k, " ".join(words)))
        rows.append((4 * k + 1, " ".join(["aa", *words])))  # a new least shingle: another bucket
        rows.append((4 * k + 2, " ".join(words[: int(rng.integers(60, 120))])))
        rows.append((4 * k + 3, " ".join(words)))
    spark.createDataFrame([*rows, (900, "one two"), (901, "one two")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, t in [*rows, (900, "one two"), (901, "one two")]:
        w = t.split()
        s = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or {t}
        if all(len(s & o) / len(s | o) < 0.85 for _, o in kept):
            kept.append((i, s))
    got = sorted(r.doc_id for r in registry.QUERIES["near_dedup"](spark, str(tmp_path)).collect())
    assert got == [i for i, _ in kept]


def test_peers_share_a_supplier_and_day_at_any_priority(spark, sf_dir, duck):
    rows = duck.execute("SELECT DISTINCT o_custkey, l_suppkey, CAST(o_orderdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()
    groups = {}
    for c, s, d in rows:
        groups.setdefault((s, d), set()).add(c)
    pairs = {(x, y) for g in groups.values() for x in g for y in g if x < y}
    assert {tuple(r) for r in graph_plans.peers(spark, sf_dir).collect()} == pairs
    around = {}
    for x, y in pairs:
        around.setdefault(x, set()).add(y)
        around.setdefault(y, set()).add(x)
    got = {r.id: r.triangles for r in registry.QUERIES["clustering_coefficient"](spark, sf_dir).collect()}
    assert got == {i: sum(y in around[x] for x in n for y in n if x < y) for i, n in around.items()}


def test_paths_of_any_gap_and_ten_rounds(spark, sf_dir, payments):
    got = {tuple(r) for r in registry.QUERIES["temporal_path_expand"](spark, sf_dir).select("a", "b", "c", "s1", "s2").collect()}
    assert got == {(s, d, x, t, u) for s, d, _, t, fraud in payments if fraud for x, y, _, u, _ in payments if y == d and u >= t}
    assert any(u > t + 1 for *_, t, u in got)
    ids, out = {x for s, d, *_ in payments for x in (s, d)}, {}
    for s, *_ in payments:
        out[s] = out.get(s, 0) + 1
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(10):
        lost = sum(r for i, r in rank.items() if i not in out)
        rank = {i: 0.15 / len(ids) + 0.85 * (lost / len(ids) + sum(rank[s] / out[s] for s, d, *_ in payments if d == i)) for i in ids}
    assert {r.id: r["rank"] for r in registry.QUERIES["pagerank"](spark, sf_dir).collect()} == pytest.approx(rank, abs=1e-7)


def test_char_shingles_of_any_text(spark, tmp_path):
    rng = random.Random(3)
    known = ["ab", "abc déf😀", "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))]
    rows = [(k, "".join(rng.choice(known[k % 3]) for _ in range(n))) for k, n in enumerate([0, 1, 4, 5, 6, 50, 700, 800, 900, 3000, 3001, 3002])]
    spark.createDataFrame([*rows, (99, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in rows:
        runs = sorted({t[j : j + 5] for j in range(len(t) - 4)}) if len(t) >= 5 else [t]
        want[i] = len(runs), hashlib.md5("\0".join(runs).encode()).hexdigest()
    assert {r.doc_id: (r.n, r.h) for r in registry.QUERIES["char_shingles"](spark, str(tmp_path)).collect()} == want


def test_words_of_categories_are_sought_as_literals(spark):
    """Each word, with and without a last letter that may be missing, and within a longer one."""
    kinds = T.PAYMENTS | T.SENSITIVE
    assert all(T.HINTS["|".join(p)] for p in kinds.values())
    words = sorted({w for p in kinds.values() for x in p for w in (re.sub(r"(.)\?", r"\1", x), re.sub(r".\?", "", x))})
    words = [w.replace(r"\b", "").replace(r"\+", "+") for w in words]
    rows = [f"{a}{w}{b}" for w in words for a, b in (("", ""), ("Of ", " x"), ("x", ""), ("", "x"))]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.any_tags(F.col("t"), kinds).alias("k")).collect()
    assert {r.t: r.k for r in got} == {t: [n for n, p in kinds.items() if re.search("|".join(p), t.lower())] for t in rows}


def test_group_transform_makes_its_rows_once(spark, tmp_path):
    """The rows' own source is in no plan of what is returned; a null key has no statistics."""
    rows = [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0), (None, "y", 7.0)]
    spark.createDataFrame(rows, "o string, d string, v double").write.parquet(f"{tmp_path}/rows")
    out = features.group_transform(spark.read.parquet(f"{tmp_path}/rows"), {"o": "orig", "d": "dest"}, "v")
    assert not any(str(tmp_path) in f for f in out.inputFiles())
    got = {(r.o, r.d): (r.orig_count, r.orig_ratio, r.dest_count, r.dest_ratio) for r in out.collect()}
    assert got == {("a", "x"): (2, 1 / 3, 2, 1 / 4), ("a", "y"): (2, 1.0, 2, 1 / 2), ("b", "x"): (1, 5 / 6, 2, 5 / 4), (None, "y"): (None, None, 2, 7 / 6)}

"""Operators that SQL can't express, against plain loops on the same rows; and edge cases of the loaders and sinks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
from collections import OrderedDict, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import entities as E
from ledgerloom.functions import text as T
from ledgerloom.operators import corpus, episodes, features, graph, isotonic, metrics, paths, reports, rewards, sampling, scrub, sections, tokens
from ledgerloom.plans import registry, texts
from ledgerloom.sources import loaders, readers, writers


def test_flag_step_rewards(spark):
    rng, rows, want = random.Random(1), [], {}
    for e in range(12):
        since, flags, flagged = 0, 0, set()
        for s in range(40):
            node, is_flag, hit = f"n{rng.randrange(6)}", rng.random() < 0.5, rng.choice([True, False, None])
            rows.append((e, s, node, is_flag, hit))
            since += 1
            if not is_flag:
                continue
            if since < 3:
                found = "cooldown_violation", -0.5
            elif flags >= 5:
                found = "max_flags_exceeded", -0.3
            elif node in flagged:
                found = "duplicate_flag", -0.2
            else:
                flags += 1
                flagged.add(node)
                found = {True: ("true_positive", 1.0), False: ("false_positive", -0.5), None: ("unknown", 0.1)}[hit]
            since = 0
            want[e, s] = found
    got = rewards.flag_step_rewards(spark.createDataFrame(rows, "e int, step int, node string, is_flag boolean, hit boolean"), "e", "step").collect()
    assert {(r.e, r.step): (r.reason, r.reward) for r in got} == want
    assert {x for x, _ in want.values()} == {"cooldown_violation", "max_flags_exceeded", "duplicate_flag", "true_positive", "false_positive", "unknown"}


def test_lru_cache(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, f"x{rng.randrange(9)}") for k in range(400)]
    want = {}
    for shard in range(3):
        cache, hits, misses = OrderedDict(), 0, 0
        for s, _, x in rows:
            if s == shard:
                hits, misses = (hits + 1, misses) if x in cache else (hits, misses + 1)
                cache[x] = None
                cache.move_to_end(x)
                if len(cache) > 4:
                    cache.popitem(last=False)
        want[shard] = (len(cache), hits, misses, hits / (hits + misses))
    got = reports.lru_stats(spark.createDataFrame(rows, "shard int, at int, item string").repartition(4), "shard", "at", "item", 4).collect()
    assert {r.shard: (r["size"], r.hits, r.misses, r.hit_rate) for r in got} == want


@pytest.mark.parametrize("parts, shape", [(1, 0.3), (7, 0.3), (16, "rising"), (16, "falling")])
def test_isotonic(spark, parts, shape):
    rng = random.Random(3)
    at = {"rising": lambda k: k / 60, "falling": lambda k: 1 - k / 60}.get(shape, lambda k: shape)
    rows = [(k / 60, int(rng.random() < at(k))) for k in (rng.randrange(60) for _ in range(500))]
    by = defaultdict(list)
    for s, y in rows:
        by[s].append(y)
    blocks = []
    for s in sorted(by):
        blocks.append([sum(by[s]), len(by[s]), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y, n, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + at]
    want = {s: y / n for y, n, at in blocks for s in at}
    got = {r.score: r.calibrated for r in isotonic.isotonic(spark.createDataFrame(rows, "score double, label int"), parts=parts).collect()}
    assert got == pytest.approx(want)


def random_arcs(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def test_betweenness(spark):
    arcs = random_arcs(4, 14, 30)
    follow = defaultdict(set)
    for a, b in arcs:
        if a != b:
            follow[a].add(b)
    ids = sorted({x for a in arcs for x in a})

    def routes(s):
        """All shortest paths from s, by length."""
        found, frontier, seen = defaultdict(list), [(s,)], {s}
        while frontier:
            ahead = [(*p, w) for p in frontier for w in follow[p[-1]] if w not in seen]
            for p in ahead:
                found[p[-1]].append(p)
            seen |= {p[-1] for p in ahead}
            frontier = ahead
        return found

    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        for some in routes(s).values():
            for v in ids:
                want[v] += sum(v in p[1:-1] for p in some) / len(some)
    n = len(ids)
    want = {v: x / ((n - 1) * (n - 2)) for v, x in want.items()}
    frame = spark.createDataFrame(arcs, "src int, dst int")
    assert {r.id: r.betweenness for r in paths.betweenness(frame).collect()} == pytest.approx(want)
    # In several batches; all nodes as samples of a graph that counts as large.
    assert {r.id: r.betweenness for r in paths.betweenness(frame, most_nodes=5, samples=n, batch_rows=60).collect()} == pytest.approx(want)
    some = {r.id: r.betweenness for r in paths.betweenness(frame, most_nodes=5, samples=9).collect()}
    assert any(some.values()) and max(abs(some[v] - want[v]) for v in want) < paths.sampling_error(n, 9)


def test_betweenness_levels_cost_their_own_pairs(spark, monkeypatch):
    """A level's plan reads the level before it and the edges, however many levels there were."""
    reads = []

    def cut(df):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return graph.cut(df)

    monkeypatch.setattr(paths, "cut", cut)
    chain = spark.createDataFrame([(k, k + 1) for k in range(9)], "src int, dst int")
    got = {r.id: r.betweenness for r in paths.betweenness(chain).collect()}
    assert got == pytest.approx({k: k * (9 - k) / (9 * 8) for k in range(10)})
    assert max(reads[:-1]) <= 4  # the last sums up the shares of all levels


def test_weighted_pagerank(spark):
    rng = random.Random(5)
    arcs = [(a, b, float(rng.randrange(1, 9))) for a, b in random_arcs(5, 12, 25)]
    ids = sorted({x for a, b, _ in arcs for x in (a, b)})
    total, n = defaultdict(float), len(ids)
    for a, _, w in arcs:
        total[a] += w
    rank = dict.fromkeys(ids, 1 / n)
    for _ in range(200):
        lost = sum(rank[i] for i in ids if not total[i])
        rank = {i: 0.15 / n + 0.85 * (lost / n + sum(rank[a] * w / total[a] for a, b, w in arcs if b == i)) for i in ids}
    out, into = defaultdict(int), defaultdict(int)
    for a, b, _ in arcs:
        out[a] += 1
        into[b] += 1
    got = {r.id: r for r in graph.weighted_pagerank(spark.createDataFrame(arcs, "src int, dst int, w double"), weight="w", tolerance=1e-10).collect()}
    assert {i: r["rank"] for i, r in got.items()} == pytest.approx(rank, abs=1e-8)
    assert {i: r.score for i, r in got.items()} == pytest.approx({i: rank[i] * (1 + math.log1p(out[i] / max(into[i], 1))) for i in ids}, abs=1e-7)


def test_components_of_many(spark):
    arcs = random_arcs(6, 60, 35)
    group = {}
    for a, b in arcs:
        whole = group.get(a, {a}) | group.get(b, {b})
        for x in whole:
            group[x] = whole
    got = {r.id: r.component for r in graph.weakly_connected(spark.createDataFrame(arcs, "src int, dst int")).collect()}
    assert got == {x: min(g) for x, g in group.items()}


def test_distances_of_any_length(spark):
    chain = [(i, i + 1) for i in range(20)]
    got = {r.id: r.distance for r in graph.distances(spark.createDataFrame(chain, "src int, dst int"), spark.createDataFrame([(0,)], "id int")).collect()}
    assert got == {i: i for i in range(21)}


def test_normalized_text(spark):
    given = ["Café naïve ﬁne", "itâ€™s â€œsoâ€ Â fine\x00", " a \n\n\n\n b\t\tc ", "", None, "ＡＢＣ ½"]

    def one(t):
        for old, new in T.MOJIBAKE:
            t = t.replace(old, new)
        t = unicodedata.normalize("NFKC", t)
        t = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
        for p, by in T.WHITESPACE:
            t = re.sub(p, by, t, flags=re.M)
        return t.strip()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id int, text string").select("id", T.normalize_full(F.col("text")).alias("n")).collect()
    assert {r.id: r.n for r in rows} == {i: None if t is None else one(t) for i, t in enumerate(given)}


def test_sections(spark):
    body = "words of this section " * 6
    text = f"{body}\nSECTION 1: First part\n{body}\n\nsection 12. \n1.2. Second\n  {body}  \nALL CAPITALS HERE\nshort\nCase Study 3: Bank\n{body}\nCASE EXAMPLE\n{body}\nAnnex B: Last\n{body}"
    want, title, lines = [], "Introduction", []

    def flush():
        content = "\n".join(lines).strip()
        if len(content) > 100:
            want.append((title, content))

    for line in text.split("\n"):
        line = line.strip()
        m = next((m for p in sections.HEADERS if (m := re.match(p, line, re.I))), None)
        if m or (line.isupper() and 10 < len(line) < 100):
            flush()
            title, lines = (m[1] if m else line) or line, []
        else:
            lines.append(line)
    flush()
    got = sections.titled_sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text").orderBy("section").collect()
    assert [(r.title, r.content) for r in got] == want and len(want) >= 5


def test_clean_by_source(spark, sf_dir, duck):
    """Against the same patterns applied by another engine, in the order of the operator."""
    rows = duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id LIMIT 60").fetchall()
    pages = duck.execute("SELECT page_id, html FROM pages ORDER BY page_id LIMIT 20").fetchall()
    given = [(i, f"{t}\n{texts.PHRASES[i % len(texts.PHRASES)]}\nSee Exhibit 4\nBest regards\n", corpus.ALL_SOURCES[i % 11]) for i, t, _ in rows] + [(10_000 + i, h, corpus.ALL_SOURCES[i % 11]) for i, h in pages]

    def lines(t, patterns):
        return "\n".join(x for x in t.split("\n") if not any(re.search(p, x, re.I | re.A) for p in patterns))

    def space(t):
        for p, by in T.WHITESPACE:
            t = re.sub(p, by, t, flags=re.M | re.A)
        return re.sub(r"^\s+|\s+$", "", t, flags=re.A)

    def html(t):
        for p in T.HTML:
            t = re.sub(p, " ", t, flags=re.I | re.S | re.A)
        return t

    def one(t, source):
        if source == "sec_edgar":
            t = html(t)
            for p in T.SEC_HEADER:
                t = re.sub(p, "", t, flags=re.I | re.M | re.A)
            return space(lines(lines(t, T.SEC_EXHIBIT), T.SEC_CONTENTS))
        if source == "gdelt":
            t = lines(html(t), T.NEWS_CALLS)
            for p in [*T.NEWS_COOKIES, *T.NEWS_SOCIAL]:
                t = re.sub(p, "", t, flags=re.I | re.A)
            return space(t)
        return space(lines(t if source == "venmo_notes" else html(t), T.LEGAL))

    got = spark.createDataFrame(given, "id bigint, text string, source string").select("id", T.clean_by_source(F.col("text"), F.col("source")).alias("t")).collect()
    assert {r.id: r.t for r in got} == {i: one(t, s) for i, t, s in given}


def test_clean_once(spark, sf_dir, capsys):
    registry.QUERIES["clean_by_source"](spark, sf_dir).explain()
    assert capsys.readouterr().out.count("CONFORMED") <= 2


def test_scrub_types_masks_and_merges(spark):
    rows = [(1, "call 555-123-4567 or a@b.co"), (2, "account 12345678 is 123456789"), (3, None), (4, "plain"), (5, "ssn 123-45-6789"), (6, "10.0.0.1 10.0.0.2")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r.id: r for r in scrub.scrub(df, "id", "text", masks={"EMAIL": "<mail>"}).collect()}
    assert got[1].text == "call [PHONE] or <mail>" and got[3].text is None and got[4].pii_count == 0
    assert got[2].text == "account 12345678 is [SSN]" and got[5].pii_types == ["SSN"] and got[6].pii_count == 2
    more = {r.id: r for r in scrub.scrub(df, "id", "text", types=["BANK_ACCOUNT", "ROUTING_NUMBER"], skip=F.col("id") == 1).collect()}
    assert more[1].text == rows[0][1] and more[2].text == "account [BANK_ACCOUNT] is [ROUTING_NUMBER]"
    assert scrub.merged([(0, 3, 0.8, "A"), (3, 6, 0.8, "B"), (6, 7, 0.9, "C"), (9, 10, 0.8, "D")]) == [(6, 7, 0.9, "C"), (9, 10, 0.8, "D")]


def test_token_cap_in_rounds(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(1, 40)) for i in range(300)]
    used, want = 0, []
    for i, n in rows:
        if used + n <= 700:
            used += n
            want.append(i)
    df = spark.createDataFrame(rows, "id bigint, n bigint").repartition(5)
    for in_one_task in (10, 1_000_000):
        assert sorted(r.id for r in corpus.token_cap(df, "id", "n", 700, in_one_task=in_one_task).collect()) == want


def test_running_sums_of_skewed_orders(spark):
    rows = [(float(10 ** -k), k) for k in range(200)] + [(0.0, 7), (-5.0, 1)]
    total, want = 0, {}
    for x, v in sorted(rows):
        total += v
        want[x] = total
    got = metrics.running_sums(spark.createDataFrame(rows, "x double, v int"), "x", "v", descending=False, slices=8).collect()
    assert {r.x: r.cum_v for r in got} == want


def test_bucket_pairs_of_copies(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "A  b c d e f"), (4, "a b c d e g"), (5, ""), (6, "")]
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in rows for w in [t.lower().split()]}
    got = {(r.a, r.b): r.similarity for r in corpus.bucket_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text", 0.5).collect()}
    assert {p for p in got if max(p) < 4} == {(1, 2), (1, 3), (2, 3)} and all(got[p] == 1.0 for p in got if max(p) < 4)
    assert all(s == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for (a, b), s in got.items() if b < 5)


def test_label_codes(spark):
    rows = [(x,) for x in ["b", None, "a", "z", "nan", "b", ""]]
    got = features.label_encode(spark.createDataFrame(rows, "x string"), "x", "code").collect()
    order = sorted({"nan" if x is None else x for x, in rows})
    assert sorted((str(r.x), r.code) for r in got) == sorted((str(x), order.index("nan" if x is None else x)) for x, in rows)


def test_collators(spark):
    rng = random.Random(8)
    rows = [(k, [rng.randrange(5, 900) for _ in range(rng.choice([0, 1, 5, 80]))] + [0] * 3) for k in range(40)]
    df = spark.createDataFrame(rows, "k bigint, ids array<int>")
    given = dict(rows)
    for r in tokens.span_batches(df, "ids", "k", 1000).collect():
        ids, real = given[r.k], sum(x >= 5 for x in given[r.k])
        masked = [i for i, y in enumerate(r.labels) if y != -100]
        assert len(masked) == (max(1, int(real * 0.15)) if real else 0) and all(r.labels[i] == ids[i] >= 5 for i in masked)
        assert all(x == y for i, (x, y) in enumerate(zip(r.input_ids, ids)) if i not in masked) and len(r.input_ids) == len(ids)
    assert tokens.span_batches(df, "ids", "k", 1000).collect() == tokens.span_batches(df.repartition(3), "ids", "k", 1000).orderBy("k").collect()
    for r in tokens.span_batches(df, "ids", "k", 1000, sentinels=True).collect():
        marks = [x for x in r.labels if x >= 950]
        assert marks == list(range(999, 999 - len(marks), -1))
        spans = {m: r.labels[r.labels.index(m) + 1 : r.labels.index(n)] for m, n in zip(marks, marks[1:])}
        assert [y for x in r.input_ids for y in spans.get(x, [x])] == given[r.k]
    assert tokens.span_batches(df.limit(0), "ids", "k", 1000).count() == 0


def test_episode_text(spark):
    rows = [(1, 0, "a", "MOVE", False, False, 0.5, 0.125), (1, 1, "b", "FLAG", True, True, 0.755, 1.0), (2, 0, "a", "MOVE", False, True, 0.5, -0.1)]
    got = {r.e: r.text for r in episodes.episode_text(spark.createDataFrame(rows, "e int, step int, node string, action string, is_flag boolean, fraud boolean, confidence double, reward double"), "e", most_words=60).collect()}
    assert got[1] == "[EPISODE id=1]\n\n[FLAGGED_TRANSACTIONS count=1]\n- TXN node=b, confidence=0.76, is_fraud=True\n\n[AGENT_ACTIONS count=2]\n- STEP 0: MOVE node=a reward=0.125\n- STEP 1: FLAG node=b reward=1.000\n\n[METRICS]\nprecision=1.000\nrecall=1.000\nf1=1.000\ntrue_positives=1\nfalse_positives=0"
    assert "FLAGGED" not in got[2] and "recall=0.000" in got[2]
    short = episodes.episode_text(spark.createDataFrame(rows, "e int, step int, node string, action string, is_flag boolean, fraud boolean, confidence double, reward double"), "e", most_words=5).collect()
    assert all(r.text.endswith("\n[TRUNCATED]") and len(r.text.split()) == 6 for r in short)


def test_loaders_of_absent_columns_and_nulls(spark):
    raw = spark.createDataFrame([(1, None, True), (2, "risk factors " * 9, None), (3, "  ", False)], "id int, text string, fraud boolean")
    got = {r.sample_id: (r.label, r.category) for r in loaders.sec_fraud(raw, "id").collect()}
    assert got == {"sec_fraud_2": ("unknown", "risk_disclosure")}
    words = spark.createDataFrame([(1, "this text is long enough", "non-fraud"), (2, "this text is long enough", "Legitimate"), (3, "this text is long enough", "?")], "id int, mda string, Label string")
    assert [r.label for r in loaders.sec_fraud(words, "id").orderBy("sample_id").collect()] == ["fraud", "non_fraud", "unknown"]
    acts = spark.createDataFrame([(1, '["Login", " Logout "]'), (2, "[login, logout"), (3, "login→balance_check, logout"), (4, "login"), (5, None)], "id int, actions string")
    assert {r.sample_id: r.metadata["actions"] for r in loaders.fraud_actions(acts, "id").collect()} == {"fraudnlp_1": "login logout", "fraudnlp_2": "login logout", "fraudnlp_3": "login balance_check logout"}
    bare = spark.createDataFrame([(1, "Some One")], "id int, name string")
    (one,) = loaders.watch_list(bare, "id", "enriched").collect()
    assert one.text == "Some One is a of interest entity." and one.label == "unknown" and one.entities == ["Some One"]
    assert loaders.payment_notes(spark.createDataFrame([(1, None), (2, "x"), (3, "420 now"), (4, "y" * 501), (5, "ok")], "id int, note string"), "id").count() == 1
    assert loaders.narratives(spark.createDataFrame([], "id int, narrative string"), "id").count() == 0
    assert {"sec_fraud", "opensanctions", "venmo", "csv"} <= set(readers.READERS)


def test_required_files_and_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    assert loaders.sniffed_separator(spark, f"{tmp_path}/a.csv") == "," and loaders.sniffed_separator(spark, f"{tmp_path}/b.tsv") == "\t"
    loaders.require_files(spark, [f"{tmp_path}/a.csv"])
    with pytest.raises(FileNotFoundError, match="c.csv.*d.csv"):
        loaders.require_files(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/c.csv", f"{tmp_path}/d.csv"])


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "long.txt").write_text("a narrative " * 9)
    (tmp_path / "n" / "short.txt").write_text("no")
    assert [r.text for r in readers.text_files(spark, f"{tmp_path}/n").collect()] == ["a narrative " * 9]
    (tmp_path / "e.json").write_text('{"records": [{"id": "1", "narrative": " first "}, {"id": "2", "text": "second"}]}')
    assert [r.text for r in readers.json_export(spark, f"{tmp_path}/e.json", multi_line=True).collect()] == ["first", "second"]
    (tmp_path / "h.csv").write_text("9,1,0.5,0.25\n8,2,1.5,\n")
    assert [(r.txId, r.time_step, r.feature_2) for r in readers.csv_headerless(spark, f"{tmp_path}/h.csv", 2).collect()] == [("9", 1, 0.25), ("8", 2, None)]
    writers.to_report(spark, {"b": 1, "a": [2]}, f"{tmp_path}/r")
    assert writers.read_report(spark, f"{tmp_path}/r") == {"a": [2], "b": 1}
    samples = loaders.watch_list(spark.createDataFrame([(1, "Some One")], "id int, name string"), "id")
    (v2,) = loaders.v2_format(samples).collect()
    assert v2.labels.risk_level == "unknown" and v2.metadata["word_count"] == "3" and v2.entities == ["Some One"]
    writers.to_training_text(spark.createDataFrame([("a\n b",)], "text string"), f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["a b"]
    assert writers.to_markdown(spark.createDataFrame([(1, "x")], "a int, b string")).splitlines() == ["| a | b |", "|---|---|", "| 1 | x |"]


def test_prioritized_batch_weights(spark):
    rows = [(k, 1.0 + k % 5, k % 10 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, p double, pos boolean")
    got = sampling.prioritized_batch(df, F.col("p"), F.col("pos"), sampling.uniform("id") + 1e-9, 40, "id", share=0.25).collect()
    assert len(got) == len({r.id for r in got}) == 40 and sum(r.pos for r in got) >= 10
    total = sum(p**0.6 for _, p, _ in rows)
    raw = {r.id: (200 * r.p**0.6 / total) ** -0.4 for r in got}
    assert {r.id: r.weight for r in got} == pytest.approx({i: x / max(raw.values()) for i, x in raw.items()})


def test_entity_functions(spark):
    assert spark.createDataFrame([("😀",), ("☃",), (None,)], "t string").select(E.has_emoji(F.col("t")).alias("e")).collect() == [(True,), (False,), (False,)]
    assert hashlib.sha256(b"7").hexdigest()[:8] == spark.range(7, 8).select(episodes.anonymous(F.col("id")).alias("h")).first().h

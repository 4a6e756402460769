"""Folders as they are downloaded, records of experiments and evaluations, against plain Python."""

from __future__ import annotations

import json
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import episodes, experiments, metrics, reports
from ledgerloom.sources import folders, readers, writers


def test_narrative_folder(spark, tmp_path):
    (tmp_path / "case.7.txt").write_text("\n\t wired in small parts \r\n" * 4)
    (tmp_path / "short.txt").write_text(" " * 80 + "no")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "other.md").write_text("not a narrative " * 9)
    got = folders.narrative_folder(spark, str(tmp_path)).collect()
    assert [(r.sample_id, r.text, r.source, r.label) for r in got] == [("fincen_narrative_case.7", ("\n\t wired in small parts \r\n" * 4).strip(), "fincen_files", "suspicious")]
    assert folders.narrative_folder(spark, str(tmp_path), least=0).count() == 2  # Spark reads no row from a file of no bytes
    (tmp_path / "none").mkdir()
    assert folders.narrative_folder(spark, f"{tmp_path}/none").count() == 0


def expected(path, least):
    """What the loader must give of one file."""
    try:
        d = json.loads(path.read_text())
    except ValueError:
        return []
    records = d if isinstance(d, list) else d.get("records", d.get("data", [d])) if isinstance(d, dict) else []
    out = []
    for k, r in enumerate(records):
        text = isinstance(r, dict) and (r.get("narrative") or r.get("text") or r.get("description"))
        if text and len(text) >= least:
            out.append((f"fincen_json_{path.stem}_{k}", text, {a: b for a, b in r.items() if isinstance(b, str)}))
    return out


def test_json_folder(spark, tmp_path):
    files = {
        "listed": [{"narrative": "", "text": "second field"}, 7, "a string", {"narrative": "first field", "text": "never"}, {"description": "short"}, {"other": "no text in here"}],
        "records": {"records": [{"text": 'with "quotes"\nand a line'}], "data": [{"text": "not looked at"}]},
        "data": {"data": [{"description": "Grüße ☃ 😀 "}, {"text": "   spaces stay   "}]},
        "one": {"narrative": None, "text": "a record of its own", "nested": {"a": [1, {"b": 2}]}},
        "nothing": [],
        "number": 5,
    }
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=2 if name == "one" else None))
    (tmp_path / "broken.json").write_text('[{"text": "it ends too soon"')
    (tmp_path / "empty.json").write_text("")
    want = sorted((i, t) for p in tmp_path.glob("*.json") for i, t, _ in expected(p, 8))
    got = folders.json_folder(spark, str(tmp_path), 8).collect()
    assert sorted((r.sample_id, r.text) for r in got) == want
    about = {r.sample_id: r.metadata for r in got}
    for p in tmp_path.glob("*.json"):
        for i, _, strings in expected(p, 8):
            assert strings.items() <= about[i].items()
    assert json.loads(about["fincen_json_one_0"]["nested"]) == {"a": [1, {"b": 2}]}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "all.jsonl").write_text("\n".join(json.dumps(v) for v in files.values()) + "\n{broken\n")
    lines = folders.json_folder(spark, f"{tmp_path}/l", 8, lines=True).collect()
    assert sorted(r.text for r in lines) == sorted(t for _, t in want) and len({r.sample_id for r in lines}) == len(want)


def test_elliptic_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="features.*classes.*edgelist"):
        folders.elliptic_folder(spark, str(tmp_path))
    for name, text in zip(folders.ELLIPTIC_FILES, ("11,1,0.5,-2\n12,2,,4\n13,3,1,1\n", "txId,class\n11,1\n12,unknown\n99,2\n", "txId1,txId2\n11,12\n12,77\n")):
        (tmp_path / name).write_text(text)
    rows, edges = folders.elliptic_folder(spark, f"{tmp_path}/")
    assert [tuple(r) for r in rows.orderBy("txId").collect()] == [("11", 1, 0.5, -2.0, "1", 1, 0, 1), ("12", 2, None, 4.0, "unknown", 0, 0, 0), ("13", 3, 1.0, 1.0, "unknown", 0, 0, 0)]
    assert sorted(map(tuple, edges.collect())) == [("11", "12"), ("12", "77"), ("txId1", "txId2")]
    for name in folders.ELLIPTIC_FILES:
        (tmp_path / name).write_text("")
    assert [df.count() for df in folders.elliptic_folder(spark, str(tmp_path))] == [0, 0]
    assert {"narrative_folder", "json_folder", "elliptic_folder"} <= set(readers.READERS)


def test_mlm_and_dataset(spark, tmp_path):
    texts = ["a\r b\rc", "one\n\ntwo", " ".join(map(str, range(600))), "", None]
    df = spark.createDataFrame([(k, t, "l", "c", "s") for k, t in enumerate(texts)], "id int, text string, label string, category string, source string")
    chunks = [" ".join(map(str, range(512))), " ".join(map(str, range(448, 600)))]
    writers.to_mlm(df, f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == sorted(["a b c", "one two", *chunks, ""])
    writers.to_mlm(df, f"{tmp_path}/j", text_only=False)
    assert sorted(r.text for r in spark.read.schema("text string").json(f"{tmp_path}/j").collect()) == sorted([texts[0], texts[1], *chunks, ""])
    split = F.when(F.col("id") < 2, "test").otherwise("train")
    writers.to_dataset(df, f"{tmp_path}/d", split, keep=["id"])
    got = spark.read.parquet(f"{tmp_path}/d")
    assert got.columns == ["text", "label", "category", "source", "id", "chunk_index", "total_chunks", "split"]
    assert sorted((r.split, r.id, r.chunk_index, r.total_chunks) for r in got.collect()) == [("test", 0, 0, 1), ("test", 1, 0, 1), ("train", 2, 0, 2), ("train", 2, 1, 2), ("train", 3, 0, 1)]
    writers.to_dataset(df, f"{tmp_path}/w", split, chunked=False)
    assert spark.read.parquet(f"{tmp_path}/w").where("split = 'train'").count() == 3


def test_experiment_of_any_length(spark, tmp_path):
    rows = [("a", k, float(k % 37), k + 1, k / 300 if k % 2 else None, k / 400 if k % 50 == 0 else None) for k in range(250)] + [("b", 0, 2.5, None, None, None), (None, 3, -1.0, 4, 0.5, None)]
    names = ["episode_rewards", "episode_lengths", "detection_rates", "f1_score"]
    df = spark.createDataFrame(rows, "run string, k int, " + ", ".join(f"{n} double" if n != "episode_lengths" else f"{n} int" for n in names))
    experiments.save(experiments.metric_log(df, "run", "k", names), f"{tmp_path}/e", {"lr": F.lit(0.1)})
    log, meta = experiments.load(spark, f"{tmp_path}/e")
    assert log.count() == sum(x is not None for r in rows for x in r[2:])
    got = {r.experiment_name: r for r in meta.collect()}
    a = [r for r in rows if r[0] == "a"]
    s = got["a"].summary
    assert (got["a"].total_episodes, got["a"].config) == (250, {"lr": "0.1"})
    assert s.avg_reward == pytest.approx(statistics.mean(r[2] for r in a)) and s.final_avg_reward == pytest.approx(statistics.mean(r[2] for r in a[-100:]))
    assert (s.max_reward, s.avg_episode_length, s.final_detection_rate, s.best_f1_score, s.final_f1_score, s.final_recall) == (36.0, 125.5, 249 / 300, 0.5, 0.5, None)
    assert got["b"].summary.final_avg_reward == 2.5 and got["b"].summary.avg_episode_length is None
    assert got[None].summary.final_avg_reward == -1.0 and got[None].summary.final_detection_rate == 0.5
    (text,) = meta.where("experiment_name = 'a'").select("experiment_name", "total_episodes", "summary.*").select(experiments.report(F.col("experiment_name")).alias("t")).collect()
    lines = text.t.split("\n")
    assert len(lines) == 18 and lines[0] == lines[2] == lines[-1] == "=" * 80 and lines[1] == "Experiment Report: a"
    assert lines[5] == "  Total Episodes: 250" and "  Final Detection Rate: 83.00%" in lines and "  Best F1 Score: 50.00%" in lines and "  Final Recall: 0.00%" in lines
    assert experiments.summary(experiments.metric_log(df.where("false"), "run", "k", names)).count() == 0


def test_evaluation_of_awkward_scores(spark, tmp_path):
    form = "id int, label int, score double"
    mixed = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.7), (4, 0, 0.1), (5, 0, 0.1)], form)
    one_class = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.2)], form)
    none = spark.createDataFrame([], form)
    methods = {"Mixed": reports.evaluation(mixed), "All good": reports.evaluation(one_class), "Nothing": reports.evaluation(none)}
    reports.save_evaluations(methods, f"{tmp_path}/r")
    loaded = reports.load_evaluations(spark, f"{tmp_path}/r")
    got = {r.method: r for r in loaded.collect()}
    m = got["Mixed"]
    assert (m.true_positives, m.false_positives, m.true_negatives, m.false_negatives) == (2, 1, 2, 0)
    assert (m.precision, m.recall, m.accuracy, m.false_positive_rate, m.roc_auc) == pytest.approx((2 / 3, 1.0, 0.8, 1 / 3, 5 / 6))
    # points (recall, precision) by falling score: (0, 1), (1/2, 1), (1/2, 1/2), (1, 2/3), (1, 2/5)
    assert m.pr_auc == pytest.approx(0.5 * 1 + 0.5 * (1 / 2 + 2 / 3) / 2)
    assert got["All good"].roc_auc is None and got["All good"].pr_auc is None and got["All good"].accuracy == 0.5
    assert got["Nothing"].true_negatives == 0 and got["Nothing"].precision == 0.0 and got["Nothing"].roc_auc is None
    assert metrics.roc_auc(one_class).first().roc_auc is None
    lines = {r.method: r.line for r in loaded.select("method", reports.comparison_line().alias("line")).collect()}
    assert lines["Mixed"] == f"{'Mixed':<20} | {66.67:>9.2f}% | {100:>9.2f}% | {80:>9.2f}% | {100:>9.2f}% | {33.33:>9.2f}% | {5 / 6:>10.4f}"
    assert lines["Nothing"] == f"{'Nothing':<20} | " + f"{0:>9.2f}% | " * 5 + f"{0:>10.4f}"


def test_traversal_against_a_loop(spark):
    rows = [("a", t, k) for t, k in [(5, "x"), (5, "y"), (9, "x"), (None, "z"), (20, None)]] + [("b", 7, "x"), ("c", 3, "x"), ("c", 3, "x"), ("d", None, "y"), (None, 4, "x")]
    got = {r.episode: r for r in episodes.traversal(spark.createDataFrame(rows, "episode string, at long, kind string"), "episode", "at", "kind").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    gaps = [0, 4, 11]
    assert got["a"].edges == 4 and got["a"].traversal_velocity == pytest.approx(4 / 15) and got["a"].temporal_diversity == pytest.approx(statistics.pstdev(gaps))
    assert (got["b"].edges, got["b"].traversal_velocity, got["b"].temporal_diversity) == (1, None, None)
    assert (got["c"].edges, got["c"].traversal_velocity, got["c"].temporal_diversity) == (2, None, 0.0)
    assert got["d"].edges is None and got["d"].patterns == {"y": 1}
    assert got["a"].patterns == {"x": 2, "y": 1, "z": 1}

"""Student and teacher, models on disk, and what surrounds them."""

import numpy as np
import pytest

from shutterlake.operators import scheduler, store, vectors
from shutterlake.sources.registry import json_settings, load_source, yaml_overrides

ROWS = "hash string, dinov3 array<double>, score double, score_source string"


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(0)
    w, x = rng.standard_normal(6) * 6, rng.standard_normal((200, 6))
    far = rng.standard_normal((30, 6)) + np.where(np.arange(30) % 2, 8, 0)[:, None]
    return x, far, {f"h{i}": 50 + v @ w for i, v in enumerate(x)} | {f"n{i}": 50 + v @ w for i, v in enumerate(far)}


def test_cascade(spark, world, tmp_path):
    x, far, truth = world
    asked = []

    def teacher(df):
        asked.append(sorted(r.hash for r in df.select("hash").collect()))
        return spark.createDataFrame([(h, float(truth[h])) for h in asked[-1]] or [("", 0.0)], "hash string, score double").where("hash <> ''")

    path = str(tmp_path / "model")
    df = spark.createDataFrame([(f"h{i}", v.tolist(), None, None) for i, v in enumerate(x)] + [("none", None, None, None)], ROWS)
    first = {r.hash: r for r in vectors.cascade(df, teacher, path).collect()}
    assert set(first) == {f"h{i}" for i in range(200)} and 2 <= len(asked[0]) <= vectors.seed_count(200)
    assert np.mean([abs(first[h].score - np.clip(truth[h], 0, 100)) for h in first]) < 0.5
    assert {r.hash for r in first.values() if r.score_source == "siglip"} == set(asked[0])
    model = vectors.load_model(spark, path)
    assert model["seeds"].shape == (len(asked[0]), 6) and model["threshold"] > 0
    # new rows: those within reach go to the student, of the others some are taught, and the student's old scores are redone
    asked.clear()
    stored = [(r.hash, x[int(r.hash[1:])].tolist(), r.score, r.score_source) for r in first.values()]
    later = {r.hash: r.score_source for r in vectors.cascade(spark.createDataFrame([(f"n{i}", v.tolist(), None, None) for i, v in enumerate(far)] + stored, ROWS), teacher, path).collect()}
    assert {h for h in later if h[0] == "n"} == {f"n{i}" for i in range(30)} and all(h[0] == "n" for a in asked for h in a)
    assert {h for h in later if h[0] == "h"} == {r[0] for r in stored if r[3] == "regressor"}
    assert vectors.auto_train(spark.createDataFrame(stored, ROWS), "hash", "dinov3", path)
    assert not vectors.auto_train(df.limit(0), "hash", "dinov3", path)
    assert {r.score_source for r in vectors.cascade(df, teacher, path, forced=True).collect()} == {"siglip"}
    assert vectors.cascade(df.limit(0), teacher, path).count() == 0
    assert vectors.load_model(spark, str(tmp_path / "nowhere")) is None


def test_ridge_is_the_closed_form(world):
    x, _, truth = world
    y = np.array([truth[f"h{i}"] for i in range(200)]) + np.random.default_rng(1).standard_normal(200)
    z = np.hstack([np.ones((200, 1)), x, y[:, None]])
    model = vectors.solve(z.T @ z, 10.0)
    s = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(s.T @ s + 10 * np.eye(6), s.T @ (y - y.mean()))
    assert np.allclose(vectors.predicted(model, x), y.mean() + s @ w)


def test_batch_sizes():
    profile = {"best_batch": 8, "max_batch": 8, "arms": [1, 2, 4, 8], "p95": 100.0, "rate": 10.0}
    state = [{"model": "m", "arm": a, "n": n, "total": t} for a, n, t in ((1, 5, 5.0), (2, 5, 10.0), (4, 5, 60.0), (8, 5, 20.0))]
    assert scheduler.pick("m", profile, state) == 4 and scheduler.pick("m", profile, state[:2]) == 4 and scheduler.pick("m", profile, state, deterministic=True) == 8
    assert scheduler.pick("m", profile, state, p95=250.0, rate=8.0) == 2 and scheduler.pick("m", profile, state, p95=250.0, rate=9.5) == 4
    assert scheduler.pick("dinov3-b", None, []) == 8 and scheduler.pick("m", {"best_batch": 6}, []) == 6 and scheduler.fallback("m", 8, 1000.0) == 4
    assert [scheduler.auto_batch(8, g) for g in (None, 13, 7, 3)] == [8, 16, 8, 4] and scheduler.auto_batch(32, 20) == 32
    got = scheduler.outcome("m", 4, 100, 10.0, 25, 4000.0, 200.0, 10)
    assert got["reward"] == pytest.approx(10 - 0.3 * 0.5 - 0.2 * 1.0 - 0.5 * 0.1)


def test_settings_files(spark, tmp_path):
    assert yaml_overrides("a: 1 # x\nb: two\n c : 3\n# d: 4\n", {"a", "b", "c"}) == {"a": 1.0, "c": 3.0}
    (tmp_path / "p.json").write_text('{"best": 4,\n "arms": [1, 2]}')
    (tmp_path / "bad.json").write_text("{")
    schema = "best int, arms array<int>"
    assert json_settings(spark, str(tmp_path / "p.json"), schema).collect()[0].arms == [1, 2]
    assert json_settings(spark, str(tmp_path / "bad.json"), schema).count() == json_settings(spark, str(tmp_path / "none.json"), schema).count() == 0
    with pytest.raises(ValueError, match="unknown source"):
        load_source(spark, "ftp", str(tmp_path))


def test_report_and_tables_are_swapped(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "report.json")
    for _ in range(2):
        store.write_json(store.report_document(base, {"t": base}), path)
    assert '"schema_version":"1"' in open(path).read() and not (tmp_path / "report.json.tmp").exists()
    table = str(tmp_path / "t")
    store.replace_table(base, table)
    store.replace_table(store.upsert(spark.read.parquet(table), spark.createDataFrame([(2, "c")], "k int, v string"), "k"), table)
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [(1, "a"), (2, "c")]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "k string, v array<double>")
    same, other = a.orderBy("k", ascending=False), spark.createDataFrame([("x", [1.0]), ("y", [2.5])], "k string, v array<double>")
    f = lambda df: vectors.fingerprint(df, "k", "v").first()[0]
    assert f(a) == f(same) != f(other)

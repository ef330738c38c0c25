"""Boundaries of the scalar rules, stores, sources, the scheduler and streaming."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import portable as p
from shutterlake.functions.digests import digest
from shutterlake.operators import rules, scheduler, store, vectors
from shutterlake.operators.aggregates import closed, histogram, summary
from shutterlake.operators.temporal import change_from_baseline, deltas, zscores
from shutterlake.sources.replay import catalogue, image_files
from shutterlake.streaming import windows

BOUNDARIES = [
    (p.time_of_day, [(4, "night"), (5, "golden_hour"), (7, "golden_hour"), (8, "morning_evening"), (10, "midday"), (15, "midday"), (16, "morning_evening"), (17, "golden_hour"), (19, "golden_hour"), (20, "night"), (None, None)]),
    (p.caption_time, [(4, "night"), (5, "morning"), (9, "morning"), (10, "afternoon"), (16, "evening"), (20, "night"), (None, "afternoon")]),
    (p.season, [(2, "winter"), (3, "spring"), (6, "summer"), (9, "autumn"), (12, "winter"), (None, "summer")]),
    (p.score_bucket, [(32.9, "low"), (33, "mid"), (66, "mid"), (66.1, "high"), (0, "low"), (None, None)]),
    (p.horizon_bucket, [(0.329, "high"), (0.33, "mid"), (0.66, "mid"), (0.661, "low"), (None, "none")]),
    (p.focal_category, [(34.9, "wide"), (35, "normal"), (70, "normal"), (70.1, "telephoto"), (None, None)]),
    (p.depth_category, [(2.79, "shallow"), (2.8, "mid"), (7.99, "mid"), (8, "deep")]),
    (p.light_category, [(400, "bright"), (401, "indoor"), (1600, "indoor"), (1601, "low_light")]),
    (p.framing_tier, [(0.24, "tight"), (0.25, "medium"), (0.55, "medium"), (0.56, "wide")]),
    (p.hue_band, [(19.9, "red"), (20, "orange"), (339.9, "magenta"), (340, "red")]),
]


def test_boundaries(spark):
    con = duckdb.connect()
    for rule, cases in BOUNDARIES:
        for x, want in cases:
            sql = rule("NULL" if x is None else str(x))
            assert spark.sql(f"select {sql}").first()[0] == want, (rule.__name__, x)
            assert con.execute(f"select {sql}").fetchone()[0] == want, (rule.__name__, x)


def test_digest_spellings(spark):
    h = "ab" * 32
    rows = [(h,), (h.upper(),), (f" {h} ",), (f"SHA256:{h.upper()}",), ("sha-256=" + h,), (h[:-1],), ("",), (None,), ("g" * 64,)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(digest("h")).collect()]
    assert got == [h] * 5 + [None] * 4


def test_aggregates_of_nothing_are_null_or_zero(spark):
    empty = spark.createDataFrame([(None,)], "x double").limit(0)
    assert summary(empty, {"n": "count(x)", "m": "avg(x)"}).first().asDict() == {"n": 0, "m": None}
    assert [r.n for r in histogram(empty, "x", 10, 3).collect()] == [0, 0, 0]
    full = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (100.0,), (None,)], "x double")
    assert {r.bucket: r.n for r in histogram(full, "x", 10, 10).collect()} == {**dict.fromkeys(range(10), 0), 0: 2, 1: 1, 9: 1}
    counted = spark.createDataFrame([("a", 2), ("z", 1)], "k string, n bigint")
    assert {r.k: r.n for r in closed(counted, "k", ["a", "b"], ["n"]).collect()} == {"a": 2, "b": 0}


def test_series(spark):
    s = spark.createDataFrame([("1", None), ("2", 0.0), ("3", 10.0), ("4", 15.0)], "k string, v double")
    assert [r.change_pct for r in change_from_baseline(s, "k", "v").orderBy("k").collect()] == [None, None, 0.0, 50.0]
    assert [r.v_delta for r in deltas(s, "k", ["v"]).orderBy("k").collect()] == [None, None, 10.0, 5.0]
    assert [r.z for r in zscores(s.where("k = '3'"), "k", "v").collect()] == [None]


def test_thresholds_prefer_overrides(spark):
    rows = spark.createDataFrame([(float(i), None, 0.5, 0.5, 0.5, 0.5, 0.5) for i in range(101)], "score double, iq double, isolation double, thirds double, space double, clutter double, off double")
    t = rules.thresholds(rows, {"clutter_max": 0.9, "nonsense": 1}).first()
    assert (t.score_floor, t.score_high, t.iq_floor, t.clutter_max, t.tilt_max) == (15.0, 65.0, 40.0, 0.9, 1.5)


def test_store(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "hash string, v int, path string")
    delta = spark.createDataFrame([("b", 3, "y"), ("c", 4, "z")], "hash string, v int, path string")
    once = store.upsert(base, delta, "hash")
    assert sorted(tuple(r) for r in once.collect()) == sorted(tuple(r) for r in store.upsert(once, delta, "hash").collect()) == [("a", 1, "x"), ("b", 3, "y"), ("c", 4, "z")]
    kept, removed = store.prune(base, delta, "hash")
    assert (kept.count(), removed.count()) == (1, 1)
    assert [r.v for r in store.clear(base, ["v", "nothing"]).collect()] == [None, None]
    assert [(r.hash, r.change) for r in store.changed(delta, base, "hash", "v").orderBy("hash").collect()] == [("b", "updated"), ("c", "new")]
    path = str(tmp_path / "t")
    base.write.parquet(path)
    store.replace_table(store.upsert(spark.read.parquet(path), delta, "hash"), path)
    assert spark.read.parquet(path).count() == 3
    rows = spark.createDataFrame([("h", "local", "/a/b/x.jpg", None), ("h", "lightroom", None, "L1"), (None, "local", "q", None)], "hash string, source string, path string, lightroom_id string")
    assert [tuple(r) for r in store.merge_sources(rows).collect()] == [("h", "both", "/a/b/x.jpg", "L1")]
    local = spark.createDataFrame([("1", "/a/IMG_1.jpg"), ("2", "/a/IMG_2.jpg")], "hash string, path string")
    remote = spark.createDataFrame([("9", "IMG_1.dng"), ("2", "other.dng")], "hash string, path string")
    assert sorted((r.hash, r.source) for r in store.merge_by_stem(local, remote).collect()) == [("2", "both"), ("9", "both")]
    assert store.merge_by_stem(local, remote, strict=True).count() == 3
    albums = spark.createDataFrame([("A", "1", "2"), ("B", "1", None)], "album string, id string, nested_id string")
    assert {r.asset_id: r.albums for r in store.album_index(albums).collect()} == {"1": ["A", "B"], "2": ["A"]}


def test_planted_near_duplicates(spark):
    rng = np.random.default_rng(0)
    rows, truth, i = [], set(), 0
    for size in (3, 2, 2, 3, 2):
        base = rng.standard_normal(768)
        ids = list(range(i, i + size))
        rows += [(j, (base + 0.01 * rng.standard_normal(768)).tolist()) for j in ids]
        truth |= {(a, b) for a in ids for b in ids if a < b}
        i += size
        rows.append((i, (base + 0.6 * rng.standard_normal(768)).tolist()))
        i += 1
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    pairs = vectors.similar_pairs(df, "id", "v", 0.05, block=6)
    assert {(r.a, r.b) for r in pairs.collect()} == truth
    assert vectors.components(pairs).count() == 12


def test_seeds_come_from_the_whole_table(spark):
    rng = np.random.default_rng(4)
    spots = rng.standard_normal((20, 8)) * 50
    # the first half of the ids lies in a single spot, so a prefix of ids would know no other
    at = [0] * 100 + [i % 20 for i in range(100)]
    points = spots[at] + rng.standard_normal((200, 8)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)] + [(999, None)], "id bigint, v array<double>")
    rows = vectors.select_seeds(df, "id", "v").collect()
    assert 20 <= len(rows) == len({r.id for r in rows}) <= vectors.seed_count(200) == 71
    assert {at[r.id] for r in rows} == set(range(20))
    far = vectors.seed_distance(df, points[[r.id for r in rows]], "id", "v").agg(F.max("dist")).first()[0]
    assert far < 2
    assert [r.id for r in vectors.select_seeds(df.where("id = 7"), "id", "v").collect()] == [7]
    assert vectors.select_seeds(df.limit(0), "id", "v").count() == 0


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x, a = rng.standard_normal((120, 4)), 10.0
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.standard_normal(120) * 0.1
    df = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id bigint, f array<double>, y double")
    model = vectors.train(df, "id", "f", "y", alphas=(a,))
    # standardised with the population's deviation, as the model is defined
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + a * np.eye(4), z.T @ (y - y.mean()))
    assert np.allclose(model["weights"], want) and model["r2"] > 0.9


def test_scheduler():
    assert scheduler.adapt(16, 300, 100, 5, 10, [1, 2, 4, 8, 16], 16) == 8
    assert scheduler.adapt(16, 300, 100, 9.5, 10, [1, 2, 4, 8, 16], 16) == 16
    assert scheduler.adapt(32, None, None, None, None, [1, 2], 16) == 16


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.JPG").write_bytes(b"1")
    (tmp_path / "sub" / "b.png").write_bytes(b"22")
    (tmp_path / "c.txt").write_bytes(b"333")
    assert [r.bytes for r in image_files(spark, str(tmp_path)).collect()] == [1, 2]
    assert image_files(spark, str(tmp_path), sample=1).count() == 1
    pages = tmp_path / "pages"
    pages.mkdir()
    one = {"resources": [{"id": "1", "subtype": "image", "updated": "u", "payload": {"captureDate": "2020-01-01"}}, {"id": "2", "payload": {"captureDate": "2021-01-01"}}]}
    (pages / "1.json").write_text("while (1) {}\n" + json.dumps(one))
    (pages / "2.json").write_text(json.dumps({"resources": [{"id": "3", "subtype": "collection_set"}]}))
    assert sorted(r.id for r in catalogue(spark, str(pages)).collect()) == ["1", "2", "3"]
    assert [r.id for r in catalogue(spark, str(pages), "2020-06").collect()] == ["2"]


@pytest.mark.parametrize("kind", ["windows", "dedup"])
def test_streams_give_the_batch_result(spark, tmp_path, kind):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i // 20} {i % 20:02d}:00:00", i % 3, "abc"[i % 2], float(i)) for i in range(40)], "event_id bigint, t string, user_id bigint, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    path = str(tmp_path / "in")
    events.unionAll(events.limit(5) if kind == "dedup" else events.limit(0)).repartition(1).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    op = (lambda d: windows.windowed_counts(d, "2 hours")) if kind == "windows" else (lambda d: windows.deduplicated(d, "event_id", "30 days"))
    q = op(stream).writeStream.outputMode("complete" if kind == "windows" else "append").format("memory").queryName(f"s_{kind}").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.table(f"s_{kind}").collect())
    want = sorted(tuple(r) for r in (op(events) if kind == "windows" else events).collect())
    assert got == want and len(got) > 10


def test_pairs_over_several_pivots(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    v = np.repeat(centres, 6, axis=0) + 0.12 * rng.standard_normal((180, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id bigint, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for eps in (0.02, 0.05, 0.6):
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(1 - u @ u.T <= eps, 1)))}
        got = vectors.similar_pairs(df, "id", "v", eps, block=20).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert vectors.similar_pairs(df.limit(0), "id", "v", 0.1).count() == 0


def test_jpeg_headers(spark):
    import struct

    from shutterlake.sources.jpeg import ZIGZAG, headers

    assert ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(ZIGZAG) == list(range(64))
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    entries = [(271, 2, 7, 200), (34665, 4, 1, 100)]
    ifd = struct.pack("<H", 2) + b"".join(struct.pack("<HHII", *x) for x in entries)
    sub = struct.pack("<H", 2) + struct.pack("<HHII", 33437, 5, 1, 220) + struct.pack("<HHIHH", 34855, 3, 1, 800, 0)
    tiff = (b"II*\0" + struct.pack("<I", 8) + ifd).ljust(100, b"\0") + sub
    tiff = tiff.ljust(200, b"\0") + b"Velora\0".ljust(20, b"\0") + struct.pack("<II", 28, 10)
    table = [0] * 64
    for place, value in zip(ZIGZAG, range(64)):
        table[place] = value
    good = b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff) + segment(0xDB, b"\0" + bytes(range(64))) + segment(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\x03") + b"\xff\xda\0\0"
    rows = {r.hash: r for r in headers(spark.createDataFrame([("good", good), ("cut", good[:50]), ("none", None), ("text", b"hello")], "hash string, content binary")).collect()}
    g = rows["good"]
    assert (g.width, g.height, g.luminance, g.exif) == (40, 30, table, {"Make": "Velora", "FNumber": "[28, 10]", "ISOSpeedRatings": "800"})
    assert all(rows[k].luminance is None and not rows[k].exif for k in ("cut", "none", "text"))


def test_streamed_upserts_and_sessions(spark, tmp_path):
    from shutterlake.operators import store
    from shutterlake.streaming import windows

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 01:00:00", 2.0), (2, "2024-01-01 09:00:00", 3.0)], "user_id bigint, ts string, value double").selectExpr("user_id", "CAST(ts AS timestamp) AS ts", "value").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    sink = windows.upsert_sink(out, "user_id", store.upsert, store.replace_table)
    for _ in range(2):
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r.user_id for r in spark.read.parquet(out).collect()) == [1, 2]
    got = sorted((r.user_id, r.n) for r in windows.sessions(spark.read.parquet(src)).collect())
    assert got == [(1, 2), (2, 1)]

import random

import numpy as np
from pyspark.sql import functions as F

from shutterlake.operators.sessions import GapTree, climb, photo_times, reduce_chunk

H = 3_600_000_000


def plain(events, gap):
    out, per = set(), {}
    for e, t in events:
        per.setdefault(e, []).append(t)
    for e, times in per.items():
        times.sort()
        s = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > gap:
                out.add((e, times[s], times[i - 1], i - s))
                s = i
    return out


def test_one_tree_serves_every_threshold(spark):
    random.seed(3)
    # an entity with most of all events, ties, repeated times and gaps across chunks
    events = [(random.choice([1, 1, 1, 2, 3]), random.choice([0, 5, 9, 300]) * H + random.randrange(0, 40) * H // 4) for _ in range(800)] + [(4, 7)]
    df = spark.createDataFrame(events, "entity bigint, t_us bigint")
    tree = GapTree(df, chunk_us=3 * H)
    for gap in (0, H // 4, H, 4 * H, 300 * H):
        got = [tuple(r) for r in tree.sessions(gap).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(events, gap)
    nodes = tree.nodes().collect()
    assert len(nodes) == sum(2 * n - 1 for n in __import__("collections").Counter(e for e, _ in events).values())


def test_exactly_the_threshold_does_not_split(spark):
    df = spark.createDataFrame([(1, 0), (1, 4 * H), (1, 8 * H + 1)], "entity bigint, t_us bigint")
    assert {tuple(r) for r in GapTree(df).sessions(4 * H).collect()} == {(1, 0, 4 * H, 2), (1, 8 * H + 1, 8 * H + 1, 1)}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "entity bigint, t_us bigint")
    assert GapTree(df).sessions(H).count() == 0
    assert GapTree(df.limit(0)).sessions(H).count() == 0


def test_long_rising_gaps_stay_exact():
    t = np.cumsum(np.arange(2000))
    nodes: list = []
    blocks = reduce_chunk(t, nodes)
    assert sum(b[2] for b in blocks) == 2000
    root = climb([b[0] for b in blocks], [b[1] for b in blocks], [b[2] for b in blocks], [b[3] for b in blocks], nodes)
    assert root[2] == 2000 and len(nodes) == 2 * 2000 - 2


def test_photo_counts_once(spark):
    stamps = spark.createDataFrame([("a", 1, 5, None), ("a", 1, 3, None), ("a", 1, None, 1), ("b", 1, None, 7), ("c", None, 4, None), (None, 1, 4, None), ("d", 1, None, None)], "lightroom_id string, camera_id bigint, capture_us bigint, exif_us bigint")
    assert sorted(tuple(r) for r in photo_times(stamps).collect()) == [(1, 3), (1, 7)]
    assert photo_times(stamps.where(F.lit(False))).count() == 0


def test_several_gaps_from_one_tree(spark):
    from shutterlake.operators.sessions import GapTree

    df = spark.createDataFrame([(1, t) for t in (0, 10, 25, 100, 101)] + [(2, 5)], "entity bigint, t_us bigint")
    tree = GapTree(df, 30)
    nodes = tree.built()
    for gap in (5, 10, 20, 80):
        got = sorted(tuple(r)[1:] for r in GapTree.runs(nodes, [5, 10, 20, 80]).where(f"gap_setting_us = {gap}").collect())
        assert got == sorted(tuple(r) for r in tree.sessions(gap).collect())

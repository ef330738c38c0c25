"""Filling containers of fixed capacity with items of varying length, by non-negative least squares.

The lengths' histogram is all the planner sees. It lists shallow combinations - up to three lengths that together fill
the capacity up to a small window, one of them perhaps many times - and solves for how often to repeat each so that the histogram is used up as nearly
as possible, without negative counts. The counts are rounded to whole containers, as far as there are items left; whatever lengths are left over
are packed greedily, longest first with the longest that still fit, whole containers of the same make-up at a time.
A plan is then a short list of make-ups with repeat counts, and every item finds its container from its place among the
items of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import materialise

#: Least number of groups among which the items of a length are counted, and items for each of which there is one more.
SALTS, PER_SALT = 64, 50_000
#: Most combinations that take part in the solution; more only slow it down, as the rest is packed greedily anyway.
COMBINATIONS = 60_000


def combinations(present: np.ndarray, capacity: int, window: int, most: int = COMBINATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``present``, how many of each) of up to three lengths that together come to ``capacity - window`` up to ``capacity``.

    Of a length that goes many times into a container, as many as fit or one less come with a filler; then come pairs and
    triples of single items, of which there may be very many, up to ``most``. Position -1: none.
    """
    n = len(present)
    room = capacity // np.maximum(present, 1)
    rows, times = [], []
    for less in (0, 1):
        m = room - less
        ok = np.flatnonzero((present > 0) & (m > 0))
        rest = capacity - m[ok] * present[ok]
        full = rest <= window
        rows.append(np.stack([ok[full], np.full(full.sum(), -1), np.full(full.sum(), -1)], axis=1))
        times.append(np.stack([m[ok[full]], np.zeros(full.sum(), int), np.zeros(full.sum(), int)], axis=1))
        top = np.searchsorted(present, rest, "right") - 1
        for step in range(4):
            filler = top - step
            good = (filler >= 0) & (rest - present[np.maximum(filler, 0)] <= window) & (present[np.maximum(filler, 0)] > 0) & (filler != ok)
            rows.append(np.stack([ok[good], filler[good], np.full(good.sum(), -1)], axis=1))
            times.append(np.stack([m[ok[good]], np.ones(good.sum(), int), np.zeros(good.sum(), int)], axis=1))
    out = []
    hi = np.searchsorted(present, capacity - present, "right")
    lo = np.searchsorted(present, capacity - window - present, "left")
    out += [np.stack([np.full(e - s, i), np.arange(s, e), np.full(e - s, -1)], axis=1) for i, (s, e) in enumerate(zip(lo, np.minimum(hi, np.arange(n) + 1))) if e > s]
    count = sum(map(len, rows)) + sum(map(len, out))
    for i in range(n - 1, -1, -1):  # the longest of three is at least a third
        if present[i] * 3 < capacity - window or count >= most:
            break
        rest = capacity - present[i]
        j = np.arange(min(i + 1, np.searchsorted(present, rest, "right")))
        j = j[present[j] * 2 >= rest - window]
        third = np.searchsorted(present, rest - present[j], "right") - 1
        ok = (third >= 0) & (third <= j)
        j, third = j[ok], third[ok]
        ok = present[j] + present[third] >= rest - window
        out.append(np.stack([np.full(ok.sum(), i), j[ok], third[ok]], axis=1))
        count += int(ok.sum())
    single = np.concatenate(out) if out else np.empty((0, 3), int)
    return np.concatenate([*rows, single])[:most], np.concatenate([*times, (single >= 0).astype(int)])[:most]


def repeats(combos: np.ndarray, times: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Counts x >= 0 with least squares of (histogram - what x containers use), by accelerated projected gradients."""
    n = len(histogram)
    at, many = np.where(combos >= 0, combos, n), times.astype(float)

    def forward(x):
        return sum(np.bincount(at[:, c], x * many[:, c], n + 1) for c in range(3))[:n]

    def back(r):
        padded = np.r_[r, 0.0]
        return (padded[at] * many).sum(axis=1)

    # columns of equal length, so that combinations of many items don't hold the step down
    norm = np.sqrt((many * many).sum(axis=1))
    step = 1 / max(1e-9, float((back(forward(1 / norm)) / norm).max()))
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y / norm) - histogram) / norm)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x / norm


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, window: int | None = None) -> list[tuple[list[tuple[int, int]], int]]:
    """Make-ups ([(length, how many)], repeats) that together hold exactly ``counts`` items of each of ``lengths``.

    Lengths must lie between 0 and the capacity.
    """
    order = np.argsort(lengths)
    lengths, left = np.asarray(lengths)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64).copy()
    window = max(1, capacity // 128) if window is None else window
    out: list[tuple[list[tuple[int, int]], int]] = []
    solid = np.flatnonzero((lengths > 0) & (left > 0))
    if len(solid):
        combos, many = combinations(lengths[solid], capacity, window)
        if len(combos):
            x = repeats(combos, many, left[solid].astype(float))
            for c in np.argsort(-x, kind="stable"):
                want = int(np.floor(x[c] + 0.5))
                if want <= 0:
                    if x[c] < 0.5:
                        break
                    continue
                own = combos[c] >= 0
                at, back = np.unique(solid[combos[c][own]], return_inverse=True)
                times = np.bincount(back, many[c][own]).astype(np.int64)
                k = int(min(want, (left[at] // times).min()))
                if k > 0:
                    left[at] -= k * times
                    out.append(([(int(lengths[a]), int(m)) for a, m in zip(at, times)], k))
    while True:
        room, made = capacity, []
        live = np.flatnonzero(left > 0)
        if not len(live):
            return out
        while len(live):
            at = np.searchsorted(lengths[live], room, "right") - 1
            if at < 0:
                break
            a = int(live[at])
            m = int(left[a]) if lengths[a] == 0 else int(min(left[a], room // lengths[a]))
            made.append((a, m))
            room -= m * int(lengths[a])
            live = live[:at]
        k = int(min(left[a] // m for a, m in made))
        for a, m in made:
            left[a] -= k * m
        out.append(([(int(lengths[a]), m) for a, m in made], k))


def intervals(made: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """(tokens, start, first container, per container): from which place on the items of a length go where."""
    rows, used, container = [], {}, 0
    for parts, k in made:
        for length, m in parts:
            start = used.get(length, 0)
            rows.append((length, start, container, m))
            used[length] = start + k * m
        container += k
    return pd.DataFrame(rows, columns=["tokens", "start", "container", "per"]).sort_values(["tokens", "start"], kind="stable")


def pack(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_id, doc_id, piece, tokens, container): every item in one container of each capacity.

    ``sized``: (doc_id, tokens). An item longer than the capacity is split into full pieces and a rest; no other is.
    Nulls: rows without an id or a size are left out; items of no tokens get a container like others; repeated rows are
    items of their own; limits without a positive capacity are ignored; an empty table gives an empty result.
    """
    spark = sized.sparkSession
    caps = limits.where("pack_id is not null and capacity_tokens > 0").groupBy("pack_id").agg(F.max("capacity_tokens").cast("bigint").alias("cap"))
    items = sized.where("doc_id is not null and tokens is not null").select("doc_id", F.col("tokens").cast("bigint").alias("size"))
    # the limits are the handful of capacities asked for
    pieces = items.crossJoin(caps).select("pack_id", "doc_id", "cap", F.posexplode(F.expr("transform(sequence(0, greatest(0, int((size - 1) div cap))), i -> least(cap, size - i * cap))")).alias("piece", "tokens"))
    salts = max(SALTS, sized.count() // PER_SALT)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counted = pieces.groupBy("pack_id", "cap", "tokens", "salt").agg(F.count("*").alias("n"))
    ahead, _ = materialise(counted.withColumn("ahead", F.expr("coalesce(sum(n) over (partition by pack_id, tokens order by salt rows between unbounded preceding and 1 preceding), 0)")), "lengths")
    # bounded by the capacities: at most one row for each length up to them
    histogram = ahead.groupBy("pack_id", "cap", "tokens").agg(F.sum("n").alias("n")).toPandas()
    plans: dict = {}
    for (pack_id, cap), h in histogram.groupby(["pack_id", "cap"]):
        t = intervals(plan(h["tokens"].to_numpy(), h["n"].to_numpy(), int(cap)))
        plans[pack_id] = {k: tuple(g[c].to_numpy() for c in ("start", "container", "per")) for k, g in t.groupby("tokens")}
    held = spark.sparkContext.broadcast(plans)
    placed = pieces.join(ahead.select("pack_id", "tokens", "salt", "ahead"), ["pack_id", "tokens", "salt"])
    placed = placed.withColumn("place", F.expr("ahead + row_number() over (partition by pack_id, tokens, salt order by doc_id, piece) - 1"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["container"] = 0
            for (pack_id, length), at in b.groupby(["pack_id", "tokens"]).indices.items():
                start, first, per = held.value[pack_id][length]
                place = b["place"].to_numpy()[at]
                i = np.searchsorted(start, place, "right") - 1
                b.iloc[at, b.columns.get_loc("container")] = first[i] + (place - start[i]) // per[i]
            yield b[["pack_id", "doc_id", "piece", "tokens", "container"]]

    return placed.select("pack_id", "doc_id", "piece", "tokens", "place").mapInPandas(assign, "pack_id string, doc_id bigint, piece int, tokens bigint, container bigint")


def usage(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_id, capacity, containers, tokens, fill): how full the containers are."""
    got = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    caps = limits.groupBy("pack_id").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    return got.join(caps, "pack_id").select("pack_id", "capacity", "containers", "tokens", "fullest", F.round(F.expr("tokens / (containers * capacity)"), 4).alias("fill"))

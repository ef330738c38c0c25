"""Grouping activity into sessions by a Cartesian tree over the gaps between neighbouring events.

Each entity's events in time order are the leaves and each gap between neighbours is an inner node; a larger gap lies
above the smaller ones beside it. A node therefore spans the longest run of events in which no gap exceeds its own,
and the sessions for any threshold are the nodes that a cut just above the threshold leaves on top: gap <= threshold
and parent's gap > threshold. The tree is built once and serves every threshold by a plain filter.

It is built in two steps so that no entity has to fit into one task. Chunks (an entity's stretch of fixed length in
time) are reduced on their own: every subtree bounded by greater gaps on both sides is final, and what remains is a
short sequence of finished blocks between the running maxima from either end. Those blocks take the place of events in
a second pass that merges the chunks of an entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import cut

NODE = "entity bigint, gap_us bigint, parent_gap_us bigint, start_us bigint, end_us bigint, n bigint"
LEAF_GAP = -1
WEEK_US = 7 * 86_400 * 1_000_000


def climb(start: list, end: list, n: list, gap: list, nodes: list) -> tuple:
    """Append the nodes below the root of one sequence of blocks as (gap, parent's gap, start, end, n); return the root.

    Of equal gaps the later one counts as larger.
    """
    stack: list = []
    now = (start[0], end[0], n[0], gap[0])
    for i in range(1, len(start)):
        g = start[i] - end[i - 1]
        while stack and stack[-1][1] <= g:
            left, h = stack.pop()
            nodes.append((left[3], h, left[0], left[1], left[2]))
            nodes.append((now[3], h, now[0], now[1], now[2]))
            now = (left[0], now[1], left[2] + now[2], h)
        stack.append((now, g))
        now = (start[i], end[i], n[i], gap[i])
    while stack:
        left, h = stack.pop()
        nodes.append((left[3], h, left[0], left[1], left[2]))
        nodes.append((now[3], h, now[0], now[1], now[2]))
        now = (left[0], now[1], left[2] + now[2], h)
    return now


def reduce_chunk(t: np.ndarray, nodes: list) -> list:
    """Blocks between the open gaps of a stretch of event times in order; everything below them goes to ``nodes``.

    A gap is open if no gap before it, or none after it, is larger: how far it spans is known only with its neighbours.
    """
    g = np.diff(t)
    if len(g) == 0:
        return [(int(t[0]), int(t[0]), 1, LEAF_GAP)]
    before = np.r_[True, g[1:] >= np.maximum.accumulate(g)[:-1]]
    after = np.r_[g[:-1] > np.maximum.accumulate(g[::-1])[::-1][1:], True]
    cuts = np.r_[0, np.flatnonzero(before | after) + 1, len(t)]
    blocks = []
    times = t.tolist()
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo == 1:
            blocks.append((times[lo], times[lo], 1, LEAF_GAP))
        else:
            part = times[lo:hi]
            blocks.append(climb(part, part, [1] * (hi - lo), [LEAF_GAP] * (hi - lo), nodes))
    return blocks


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Any contiguous stretch may be a chunk, so each batch is reduced by itself and nothing is carried over."""
    for b in batches:
        if not len(b):
            continue
        e, c, t = b["entity"].to_numpy(), b["chunk"].to_numpy(), b["t_us"].to_numpy()
        edge = np.r_[0, np.flatnonzero((e[1:] != e[:-1]) | (c[1:] != c[:-1])) + 1, len(e)]
        rows: list = []
        for lo, hi in zip(edge[:-1], edge[1:]):
            nodes: list = []
            blocks = reduce_chunk(t[lo:hi], nodes)
            who = int(e[lo])
            rows += [(who, *x, True) for x in nodes]
            rows += [(who, x[3], None, x[0], x[1], x[2], False) for x in blocks]
        out = pd.DataFrame(rows, columns=["entity", "gap_us", "parent_gap_us", "start_us", "end_us", "n", "final"])
        out["parent_gap_us"] = out["parent_gap_us"].astype("Int64")
        yield out


def _merge(blocks: pd.DataFrame) -> pd.DataFrame:
    b = blocks.sort_values(["start_us", "end_us"], kind="stable")
    nodes: list = []
    root = climb(b["start_us"].tolist(), b["end_us"].tolist(), b["n"].tolist(), b["gap_us"].tolist(), nodes)
    nodes.append((root[3], None, *root[:3]))
    out = pd.DataFrame(nodes, columns=["gap_us", "parent_gap_us", "start_us", "end_us", "n"])
    out["parent_gap_us"] = out["parent_gap_us"].astype("Int64")
    out.insert(0, "entity", int(blocks["entity"].iloc[0]))
    return out


class GapTree:
    """The Cartesian trees of all entities, from rows (entity bigint, t_us bigint).

    Rows with a null in either are left out; equal times are events of their own, at a gap of 0; an empty input gives no
    nodes. A hot entity is spread over its chunks, and what is merged per entity is the few blocks that each chunk
    leaves, not its events.
    """

    def __init__(self, events: DataFrame, chunk_us: int = WEEK_US):
        chunked = events.select("entity", "t_us").where("entity is not null and t_us is not null").withColumn("chunk", F.floor(F.col("t_us") / chunk_us).cast("bigint"))
        ordered = chunked.repartition("entity", "chunk").sortWithinPartitions("entity", "t_us")
        self._reduced = ordered.mapInPandas(_chunks, NODE + ", final boolean")

    def nodes(self, wanted: str = "true") -> DataFrame:
        """All nodes of the trees for which the SQL condition ``wanted`` holds."""
        reduced = cut(self._reduced.where(f"not final or ({wanted})"))
        merged = reduced.where("not final").drop("final").groupBy("entity").applyInPandas(_merge, NODE)
        return reduced.where("final").drop("final").unionByName(merged.where(wanted))

    def built(self) -> DataFrame:
        """All nodes, written once: any number of gap settings are then filters on them."""
        return cut(self.nodes())

    @staticmethod
    def runs(nodes: DataFrame, gaps_us: list[int]) -> DataFrame:
        """(gap_setting_us, entity, start_us, end_us, n) for several settings in one pass over ``nodes``."""
        settings = ", ".join(f"{int(g)}L" for g in gaps_us)
        each = nodes.selectExpr("*", f"explode(filter(array({settings}), g -> gap_us <= g and (parent_gap_us is null or parent_gap_us > g))) AS gap_setting_us")
        return each.select("gap_setting_us", "entity", "start_us", "end_us", "n")

    def sessions(self, gap_us: int) -> DataFrame:
        """(entity, start_us, end_us, n): the runs of events with no pause longer than ``gap_us``."""
        top = f"gap_us <= {int(gap_us)} and (parent_gap_us is null or parent_gap_us > {int(gap_us)})"
        return self.nodes(top).select("entity", "start_us", "end_us", "n")


def photo_times(stamps: DataFrame) -> DataFrame:
    """(entity, t_us) of each photo of ``instants.read_stamps``: its earliest capture instant, else its earliest exif instant.

    Rows without camera or photo don't count. A photo that several cameras claim goes to the one with the earliest row.
    """
    rows = stamps.where("camera_id is not null and lightroom_id is not null")
    first = rows.groupBy("lightroom_id").agg(F.min("capture_us").alias("a"), F.min("exif_us").alias("b"), F.min(F.struct(F.coalesce("capture_us", "exif_us").isNull(), F.coalesce("capture_us", "exif_us"), "camera_id")).alias("c"))
    return first.select(F.col("c.camera_id").alias("entity"), F.coalesce("a", "b").alias("t_us")).where("t_us is not null")

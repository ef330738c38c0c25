"""Consolidating pairwise matches into groups.

The giant component, if there is one, is peeled off: breadth-first joins from the vertex of highest degree reach all of
it, a few hops to a job, and an anti-join takes it away. What remains are small components, which minimum propagation
labels; each round also replaces a vertex's label by its label's label, so that chains take logarithmically many rounds.

Matches form long chains, so that the giant component can be more than a hundred links deep. One contraction therefore
comes first: every vertex moves on to the end of a short walk along smallest neighbours, and links move with their ends.
That keeps what hangs together, as well as its smallest vertex, and shortens every way to a fraction. Where frontiers
still have not come to an end after a number of jobs, the links are contracted again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.digests import digest
from shutterlake.session import cut, drop, materialise


def link_rows(matches: DataFrame, most: float | None = 0.05, a: str = "hash_a", b: str = "hash_b", distance: str = "cos_dist") -> DataFrame:
    """(a binary, b binary), a < b, once each: pairs of different digests that some row links.

    A null or unreadable side, a null or NaN distance or one beyond ``most``, and a digest with itself do not link.
    ``most`` None takes every row.
    """
    rows = matches if most is None else matches.where((F.col(distance) <= most) & ~F.isnan(distance))
    x, y = F.unhex(digest(a)), F.unhex(digest(b))
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (x.isNotNull() & y.isNotNull()).alias("ok")).where("ok and a <> b").select("a", "b").distinct()


#: Hops of the frontier in one job, and jobs after which the links are contracted again.
HOPS, JOBS = 4, 12


def _peel(both: DataFrame, jobs: int) -> tuple[DataFrame | None, bool]:
    """(vertices v of the component of the vertex with the most links, whether that is all of it); None without links."""
    top = both.groupBy("a").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "a")).alias("t")).first()["t"]
    if top is None:
        return None, True
    layers = [cut(both.where(F.col("a") == F.lit(bytes(top["a"]))).select(F.col("a").alias("v")).limit(1))]
    for _ in range(jobs):
        near, hops = layers[-1], []
        for _ in range(HOPS):
            # a semi-join first, so that a hub in the frontier costs its links once and nothing is multiplied
            near = both.join(near.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).distinct()
            hops.append(near)
        step = reduce(DataFrame.unionByName, hops).distinct()
        # what a few hops lead to lies in the layer before, in itself or in the next one
        for seen in layers[-2:]:
            step = step.join(seen, "v", "left_anti")
        step = cut(step)
        if step.isEmpty():
            return reduce(DataFrame.unionByName, layers), True
        layers.append(step)
    return None, False


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves (v, to), links (a, b) between where their ends moved to): four steps along smallest neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("to")))
    for _ in range(2):
        hook = hook.join(hook.select(F.col("v").alias("to"), F.col("to").alias("up")), "to").select("v", F.col("up").alias("to"))
    moves = cut(hook)
    for end in "ab":
        edges = edges.join(moves.select(F.col("v").alias(end), F.col("to").alias(f"__{end}")), end)
    moved = edges.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).where("a <> b").distinct()
    return moves, cut(moved)


def _labels(links: DataFrame, jobs: int) -> DataFrame | None:
    """(v, root): the giant component by breadth-first joins, the rest by minimum propagation; None if the first takes more than ``jobs`` jobs."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    giant, whole = _peel(both, jobs)
    if not whole:
        return None
    if giant is None:
        return links.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)
    giant = cut(giant)
    root = giant.agg(F.min("v").alias("root"))
    done = giant.crossJoin(F.broadcast(root))  # one row
    rest = cut(both.join(giant.withColumnRenamed("v", "a"), "a", "left_anti"))
    label, at = materialise(rest.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "v"), "label")
    while True:
        seen = rest.join(label.select(F.col("v").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        lower = label.join(seen, label.v == seen.a, "left").select("v", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        # the label's own label: halves the way that is left
        up = lower.select(F.col("v").alias("root"), F.col("root").alias("up"))
        before = at
        new, at = materialise(lower.join(up, "root", "left").select("v", "old", F.least("root", "up").alias("root")), "label")
        drop(links.sparkSession, before)
        changed = not new.where("old <> root").isEmpty()
        label = new.select("v", "root")
        if not changed:
            return done.unionByName(label)


def groups(links: DataFrame, jobs: int = JOBS) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b): ``root`` is the smallest vertex linked directly or indirectly.

    Repeated and reversed links are allowed; without links the result is empty.
    """
    edges = cut(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    walks, label = [], None
    while label is None:
        moves, edges = _contract(edges)
        walks.append(moves)
        label = _labels(edges, jobs)
    for moves in reversed(walks):
        # a vertex without a label of its own is all that is left of its group
        found = moves.join(label.select(F.col("v").alias("to"), "root"), "to", "left")
        label = cut(found.select("v", F.coalesce("root", "to").alias("root")))
    return label


def group_rows(found: DataFrame) -> DataFrame:
    """(root_hash, hash): one row for each member but the root."""
    return found.where("v <> root").select(F.lower(F.hex("root")).alias("root_hash"), F.lower(F.hex("v")).alias("hash"))

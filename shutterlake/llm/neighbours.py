"""Most similar vectors for every vector, by randomly rotated one-bit codes.

The vectors of a cell are divided once more into fine cells. Within one each vector, centred on the fine cell's mean and
rotated at random, is kept as one bit per dimension, packed into words, with two correction scalars: its distance from
the mean and how much of it its own code explains. Inner products are estimated from the bits in two steps. For all
pairs, the first words of a vector are compared with those of the query, coded alike: an exclusive or and a count of bits.
Where the error bound leaves some pair of a fine cell in the running, the whole code is held against the query itself.
Only pairs whose upper bound then reaches the k-th best similarity among those of the best lower bounds are computed
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.vectors import Block, by_cell, fit_cells, nearest_centre, per_cell, reorder, spherical_kmeans
from shutterlake.session import materialise

SCHEMA = "digest binary, neighbours array<binary>, cosines array<float>"
QUERY_BLOCK, BASE_BLOCK, PAIR_BLOCK = 512, 2048, 2048
#: Pairs that are held at once, in a handful of matrices; a large block takes fewer queries at a time.
HELD = 1 << 22
#: Vectors of a fine cell, and queries whose words are compared at once, so that they stay in the processor's cache.
FINE, TILE = 96, 64
#: Standard errors that a bound is wide.
EPSILON = 1.0
#: Words that the first step compares.
FIRST = 3


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0].astype(np.float32)


def words(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    bits = np.packbits(signs, axis=1)
    out = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view(np.uint64)


def scalars(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of centred rows: their lengths, and the share of it that lies along their own signs."""
    away = np.sqrt(np.einsum("ij,ij->i", r, r))
    return away, np.maximum(np.abs(r).sum(axis=1) / np.sqrt(r.shape[1]) / np.maximum(away, 1e-12), 1e-3)


def differing(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of bits in which each row of words of ``q`` differs from each of ``b``."""
    out = np.empty((len(q), len(b)), np.uint16)
    columns = np.ascontiguousarray(b.T)
    x, c = np.empty((TILE, len(b)), np.uint64), np.empty((TILE, len(b)), np.uint8)
    for s in range(0, len(q), TILE):
        m = min(TILE, len(q) - s)
        o = out[s : s + m]
        o[:] = 0
        for w in range(q.shape[1]):
            np.bitwise_xor(q[s : s + m, w, None], columns[None, w], out=x[:m])
            np.bitwise_count(x[:m], out=c[:m])
            o += c[:m]
    return out


class Codes:
    """One-bit codes of ``units`` by fine cell: packed bits and correction scalars, in the order ``at`` of the fine cells."""

    def __init__(self, units: np.ndarray, turn: np.ndarray, epsilon: float):
        """``units`` are put into that order."""
        n, dim = units.shape
        fine = nearest_centre(units, spherical_kmeans(units, max(1, n // FINE), rounds=2))
        self.at = np.argsort(fine, kind="stable")
        reorder(units, self.at)
        self.edges = np.r_[0, np.flatnonzero(np.diff(fine[self.at])) + 1, n]
        self.dim, self.turn, self.epsilon, self.means = dim, turn, epsilon, []
        self.first = min(dim, 64 * FIRST)
        self.bits = np.empty((n, -(-dim // 64)), np.uint64)
        self.away, self.explained, self.shift, self.along = (np.empty(n, np.float32) for _ in range(4))
        self.fine = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        for lo, hi in zip(self.edges[:-1], self.edges[1:]):
            own = units[lo:hi]
            mean = own.mean(axis=0, dtype=np.float64).astype(np.float32)
            r = (own - mean) @ turn.T
            self.means.append(mean)
            self.bits[lo:hi] = words(r > 0)
            self.away[lo:hi], self.explained[lo:hi] = scalars(r)
            # an inner product is that of the two residuals, and the query's with the mean, and this
            self.shift[lo:hi] = own @ mean - mean @ mean
            self.along[lo:hi] = np.where(r > 0, 1, -1) @ (turn @ mean)
        self.means = np.array(self.means)
        # the angle's cosine by how many of the first bits differ, and half the width of its error bound
        self.cosine = np.sin(np.pi * (0.5 - np.arange(self.first + 1) / self.first)).astype(np.float32)
        self.slack = np.float32(epsilon * np.pi / 2 / np.sqrt(self.first))

    def query(self, units: np.ndarray) -> None:
        """Take up a block of queries."""
        self.turned = units @ self.turn.T
        self.to_mean = units @ self.means.T
        self.far = np.sqrt(np.maximum(0, 1 - 2 * self.to_mean + np.einsum("ij,ij->i", self.means, self.means)))

    def upper(self) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and upper bounds of all pairs from the first words."""
        middle = np.empty((len(self.turned), len(self.bits)), np.float32)
        high = np.empty_like(middle)
        start = self.turned[:, : self.first]
        for f, (lo, hi) in enumerate(zip(self.edges[:-1], self.edges[1:])):
            signs = words(start > (self.turn[: self.first] @ self.means[f]))
            scale = self.far[:, f, None] * self.away[None, lo:hi]
            m = self.cosine[differing(signs, self.bits[lo:hi, : signs.shape[1]])]
            m *= scale
            m += self.to_mean[:, f, None] + self.shift[None, lo:hi]
            middle[:, lo:hi] = m
            scale *= self.slack
            scale += 1e-6
            np.add(m, scale, out=high[:, lo:hi])
        return middle, high

    def closer(self, high: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds from all words, of the fine cells where some pair's ``high`` comes up to ``reach``; -inf elsewhere."""
        low = np.full_like(high, -np.inf)
        stretch = self.away / self.explained / np.float32(np.sqrt(self.dim))
        across = self.away * np.sqrt(np.maximum(0, 1 - self.explained**2)) / self.explained * np.float32(self.epsilon / np.sqrt(max(1, self.dim - 1)))
        for f, (lo, hi) in enumerate(zip(self.edges[:-1], self.edges[1:])):
            rows = np.flatnonzero(high[:, lo:hi].max(axis=1) >= reach)
            high[:, lo:hi] = -np.inf
            if not len(rows):
                continue
            signs = np.unpackbits(self.bits[lo:hi].view(np.uint8), axis=1, count=self.dim).astype(np.float32)
            signs *= 2
            signs -= 1
            found = self.turned[rows] @ signs.T
            found -= self.along[None, lo:hi]
            found *= stretch[None, lo:hi]
            found += self.to_mean[rows, f, None] + self.shift[None, lo:hi]
            half = self.far[rows, f, None] * across[None, lo:hi] + np.float32(1e-6)
            low[rows, lo:hi] = found - half
            high[rows, lo:hi] = found + half
        return low, high


def kth_largest(values: np.ndarray, k: int, width: int = 16) -> np.ndarray:
    """A value per row that at least k entries reach and hardly more: the k-th largest of the maxima of strided chunks; -inf where there are fewer."""
    m, n = values.shape
    if n < k:
        return np.full(m, -np.inf, np.float32)
    if (chunks := n // width) >= 4 * k:  # neighbours in order are often alike, so that they are spread over the chunks
        values = values[:, : chunks * width].reshape(m, width, chunks).max(axis=1)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def dots(units: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.float32)
    for s in range(0, len(i), PAIR_BLOCK):
        out[s : s + PAIR_BLOCK] = np.einsum("ij,ij->i", units[i[s : s + PAIR_BLOCK]], units[j[s : s + PAIR_BLOCK]])
    return out


def best_of(i: np.ndarray, j: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each i: by cosine, then by the smaller j."""
    order = np.lexsort((j, -cosine, i))
    i, j, cosine = i[order], j[order], cosine[order]
    first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.empty(0, int)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    keep = rank < k
    return i[keep], j[keep], cosine[keep]


def search_block(block: Block, k: int, turn: np.ndarray, epsilon: float, counted: list | None = None) -> Iterator[tuple]:
    """(i, j, cosine) of the k most similar of each home vector within the block, found by codes and reranked exactly.

    ``counted`` gets (pairs reranked, pairs in all) of each step.
    """
    units = block.units
    for home, base in block.sides():
        if not len(home) or not len(base):
            continue
        # a block compared with itself is put into the order of its fine cells and back again, as it may be large
        same = len(base) == len(units)
        ordered = units if same else units[base]
        codes = Codes(ordered, turn, epsilon)
        base = base[codes.at]  # positions in the block, in the order of the fine cells
        where = np.full(len(units), -1)
        where[base] = np.arange(len(base))
        at = where if same else np.arange(len(units))
        step = max(16, min(QUERY_BLOCK, HELD // len(base)))
        for s in range(0, len(home), step):
            q = home[s : s + step]
            own = np.flatnonzero(where[q] >= 0)

            def threshold(value: np.ndarray) -> tuple[np.ndarray, int]:
                """The k-th best similarity of each query among the pairs of highest ``value``, and how many that took."""
                i, j = np.nonzero(value >= np.maximum(kth_largest(value, k), -2)[:, None])
                first, _, sure = best_of(i, base[j], dots(units, at[q[i]], at[base[j]]), k)  # noqa: B023
                worst = np.full(len(q), np.inf, np.float32)  # noqa: B023
                np.minimum.at(worst, first, sure)
                return np.where(np.bincount(first, minlength=len(q)) == k, worst - 1e-5, -2), len(i)  # noqa: B023

            codes.query(units[at[q]])
            middle, high = codes.upper()
            middle[own, where[q][own]] = high[own, where[q][own]] = -np.inf
            reach, n1 = threshold(middle)
            low, high = codes.closer(high, reach)
            low[own, where[q][own]] = high[own, where[q][own]] = -np.inf
            # the best lower bounds, computed exactly, give a threshold that lies far above any lower bound
            closer, n2 = threshold(low)
            chosen = high >= np.maximum(reach, closer)[:, None]
            if counted is not None:
                counted.append((int(np.count_nonzero(chosen)), high.size, n1 + n2))
            i, j, cosine = reranked(units[at[q]], ordered, codes.edges, chosen, k)
            yield best_of(q[i], base[j], cosine, k)
        if same:
            reorder(units, where)


def reranked(queries: np.ndarray, base: np.ndarray, edges: np.ndarray, chosen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, inner product) of the chosen pairs that may be among the k best: computed exactly, in the chosen rows of each fine cell."""
    exact = np.full(chosen.shape, -np.inf, np.float32)
    for lo, hi in zip(edges[:-1], edges[1:]):
        rows = np.flatnonzero(chosen[:, lo:hi].any(axis=1))
        if len(rows):
            exact[rows, lo:hi] = np.where(chosen[rows, lo:hi], queries[rows] @ base[lo:hi].T, -np.inf)
    i, j = np.nonzero(exact >= np.maximum(kth_largest(exact, k), -2)[:, None])
    return i, j, exact[i, j]


def expanded(block: Block, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, digest, cosine) from the k most similar vectors of each home vector: the k most similar digests of each home digest."""
    first, count = block.first, block.count
    home = np.flatnonzero(block.home)
    if block.lo == block.hi:  # digests of one vector are each other's most similar
        i, j, cosine = np.r_[i, home], np.r_[j, home], np.r_[cosine, np.ones(len(home), np.float32)]
    # of each vector the smallest digests are enough, one more than k as a digest is not its own neighbour
    times = np.minimum(count[j], k + 1)
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    v, digest, cosine = np.repeat(i, times), np.repeat(first[j], times) + at, np.repeat(cosine, times)
    rank = np.argsort(np.argsort(np.array(block.names, dtype=object))) if len(block.names) else np.empty(0, int)
    order = np.lexsort((rank[digest], -cosine, v))
    v, digest, cosine = v[order], digest[order], cosine[order]
    many = count[v]
    # each row for every digest of its vector
    own = np.repeat(first[v], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row = np.repeat(np.arange(len(v)), many)
    keep = own != digest[row]
    own, row = own[keep], row[keep]
    order = np.lexsort((row, own))
    own, row = own[order], row[order]
    start = np.searchsorted(own, own)
    near = np.arange(len(own)) - start < k
    return own[near], digest[row[near]], cosine[row[near]]


def lists(names: list[bytes], i: np.ndarray, j: np.ndarray, cosine: np.ndarray, owners: np.ndarray) -> pa.Table:
    """One row per owner with its neighbours in order, also where there are none."""
    count = np.bincount(np.searchsorted(owners, i), minlength=len(owners))
    offsets = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
    near = pa.ListArray.from_arrays(offsets, pa.array([names[x] for x in j], pa.binary()))
    return pa.table({"digest": pa.array([names[x] for x in owners], pa.binary()), "neighbours": near, "cosines": pa.ListArray.from_arrays(offsets, pa.array(cosine, pa.float32()))})


def nearest(photos: DataFrame, k: int = 10, hash_col: str = "hash", vector_col: str = "dinov3", dim: int = 768, cell_size: int = 2000, margin: float = 0.06, epsilon: float = EPSILON) -> DataFrame:
    """(digest binary, neighbours, cosines): for each digest with a usable vector its ``k`` most similar other digests.

    Nulls: rows without a digest or a usable vector take no part. Ties go to the smaller digest; repeated rows of a
    digest count once; fewer than k others give a shorter list; an empty table gives an empty result; other columns are
    ignored. Accuracy: a neighbour is missed only if it has no copy in the query's home cell, or if an error bound of
    ``epsilon`` standard errors fails.
    """
    cells = fit_cells(photos, hash_col, vector_col, dim, cell_size, margin)
    if cells is None:
        return photos.sparkSession.createDataFrame([], SCHEMA)
    turn: dict = {}

    def search(block: Block) -> Iterator[pa.Table]:
        if "t" not in turn:
            turn["t"] = rotation(dim)
        found = list(search_block(block, k, turn["t"], epsilon))
        i, j, c = (np.concatenate([f[x] for f in found]) if found else np.empty(0, int) for x in range(3))
        owners = np.flatnonzero(np.repeat(block.home, block.count))
        yield lists(block.names, *expanded(block, i, j, c, k), owners).append_column("whole", pa.array(np.full(len(owners), block.whole)))

    placed = by_cell(photos, hash_col, vector_col, cells)
    if not cells.divided:
        return per_cell(placed, search, SCHEMA + ", whole boolean", dim).drop("whole")
    found, _ = materialise(per_cell(placed, search, SCHEMA + ", whole boolean", dim), "nearest")
    # of a divided cell each block gave its k best: the k best of those
    each = found.where("not whole").select("digest", F.explode_outer(F.arrays_zip("neighbours", "cosines")).alias("x"))
    best = each.select("digest", "x", F.expr("row_number() over (partition by digest order by x.cosines desc, x.neighbours)").alias("place")).where(f"place <= {int(k)}")
    merged = best.groupBy("digest").agg(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("place", "x")))).alias("l"))
    merged = merged.select("digest", F.transform("l", lambda e: e.x.neighbours).alias("neighbours"), F.transform("l", lambda e: e.x.cosines).alias("cosines"))
    return found.where("whole").drop("whole").unionByName(merged)


def neighbour_rows(found: DataFrame) -> DataFrame:
    """(hash, rank, neighbour, cosine)."""
    hexed = lambda c: F.lower(F.hex(c))
    each = found.select("digest", F.posexplode(F.arrays_zip("neighbours", "cosines")).alias("pos", "x"))
    return each.select(hexed("digest").alias("hash"), (F.col("pos") + 1).alias("rank"), hexed(F.col("x.neighbours")).alias("neighbour"), F.round(F.col("x.cosines").cast("double"), 5).alias("cosine"))


def close_pairs(found: DataFrame, least: float) -> DataFrame:
    """(hash_a, hash_b): pairs with cosine similarity of at least ``least`` of which one is among the other's nearest."""
    close = F.filter(F.arrays_zip("neighbours", "cosines"), lambda x: x.cosines >= F.lit(least - 1e-6))
    each = found.select("digest", F.explode(close).alias("x")).select(F.least("digest", "x.neighbours").alias("a"), F.greatest("digest", "x.neighbours").alias("b")).distinct()
    return each.select(F.lower(F.hex("a")).alias("hash_a"), F.lower(F.hex("b")).alias("hash_b"))

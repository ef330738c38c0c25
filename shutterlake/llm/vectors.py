"""Shared handling of image vectors: usable ones, packing, and a partition of the space into cells.

A vector is usable if it has the expected number of values, all finite and not all zero. Cells are the leaves of a
spherical k-means fitted on a bounded sample; each vector has a home cell, and copies go to every cell whose centre is
nearly as similar as the home's, so that neighbours across a border still meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.digests import digest

#: Least and most vectors that the fit of the cells draws, in one executor task; in between it draws ``PER_CELL`` for each cell.
SAMPLE_LEAST, SAMPLE_BOUND, PER_CELL = 8_192, 65_536, 16
#: About how many vectors a task may hold at once: 100 MB of 768 values each.
BLOCK = 32_768
#: Rows that a task works on, or hands over, at once where rows carry vectors: what it holds besides its block is a few times that.
PIECE = 1_024


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, at most ``PIECE`` at a time."""
    for b in batches:
        for s in range(0, b.num_rows, PIECE):
            yield b.slice(s, PIECE)


def pack(v: np.ndarray) -> bytes:
    """A float32 vector without loss: its bytes by plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v, "<f4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blobs: list[bytes], dim: int) -> np.ndarray:
    d = zstandard.ZstdDecompressor()
    out = np.empty((len(blobs), dim), np.float32)
    for i, b in enumerate(blobs):
        planes = np.frombuffer(d.decompress(b), np.uint8).reshape(4, dim)
        out[i] = np.ascontiguousarray(planes.T).view("<f4").ravel()
    return out


def usable_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and the vectors as float32."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float32(), safe=False).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dim)
    at = np.flatnonzero(valid)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    # nulls inside a list come as NaN
    vectors = values[offsets[at][:, None] + np.arange(dim)]
    good = np.isfinite(vectors).all(axis=1) & vectors.any(axis=1)
    return at[good], np.ascontiguousarray(vectors[good], np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
    tiny = ~np.isfinite(norm) | (norm < 1e-18)
    if tiny.any():  # values whose squares leave float32's range
        v = v / np.abs(v).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
    return v / norm[:, None].astype(np.float32)


def reorder(rows: np.ndarray, order: np.ndarray) -> None:
    """``rows[:] = rows[order]`` without a second copy of them."""
    for c in range(0, rows.shape[1], 32):
        rows[:, c : c + 32] = rows[order, c : c + 32]


def sums_by(rows: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(groups that have rows, the sum of each one's rows), some rows at a time."""
    order = np.argsort(group, kind="stable")
    sums = np.zeros((groups, rows.shape[1]), rows.dtype)
    for s in range(0, len(order), 4096):
        at = order[s : s + 4096]
        present, first = np.unique(group[at], return_index=True)
        sums[present] += np.add.reduceat(rows[at], first, axis=0)
    present = np.unique(group)
    return present, sums[present]


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        home = nearest_centre(sample, centres)
        present, sums = sums_by(sample, home, k)
        length = np.linalg.norm(sums, axis=1)
        keep = length > 1e-12
        centres = centres.copy()
        centres[present[keep]] = sums[keep] / length[keep, None]
    return centres.astype(np.float32)


def nearest_centre(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(units[s : s + 4096] @ centres.T).argmax(axis=1) for s in range(0, len(units), 4096)]) if len(units) else np.empty(0, int)


def fit_centres(sample: np.ndarray, k: int, wide: int = 64) -> np.ndarray:
    """About ``k`` centres, in levels: where there are many, each of a few coarse clusters is divided on its own share of the sample."""
    if k <= wide:
        return spherical_kmeans(sample, k)
    coarse = spherical_kmeans(sample, round(k**0.5))
    home = nearest_centre(sample, coarse)
    out = []
    for c in range(len(coarse)):
        own = sample[home == c]
        if len(own):
            out.append(spherical_kmeans(own, max(1, min(len(own), round(k * len(own) / len(sample))))))
    return np.concatenate(out)


@dataclass
class Cells:
    """Centres of the cells and how far below the home's similarity a cell may lie to get a copy.

    ``parts``: into how many parts each cell is divided; a task then holds two of them, so its size doesn't grow with the cell.
    """

    centres: np.ndarray
    margin: float
    dim: int
    parts: np.ndarray

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is home) of all copies."""
        s = units @ self.centres.T
        home = s.argmax(axis=1)
        row, cell = np.nonzero(s >= s[np.arange(len(s)), home][:, None] - self.margin)
        return row, cell, cell == home[row]

    @property
    def divided(self) -> bool:
        return bool((self.parts > 1).any())


class Rows:
    """Unit vectors in one array, which rows are added to as they come; it starts with room for ``room`` of them."""

    def __init__(self, dim: int, room: int):
        self.units, self.n = np.empty((max(1, room), dim), np.float32), 0

    def add(self, packed: list[bytes]) -> None:
        while self.n + len(packed) > len(self.units):
            self.units.resize((len(self.units) * 5 // 4 + PIECE, self.units.shape[1]), refcheck=False)
        self.units[self.n : self.n + len(packed)] = unit(unpack(packed, self.units.shape[1]))
        self.n += len(packed)

    def filled(self, batches: Iterable[pa.RecordBatch], name: str, vector: str) -> tuple[list, np.ndarray]:
        names: list = []
        for b in pieces(batches):
            names += b.column(name).to_pylist()
            self.add(b.column(vector).to_pylist())
        return names, self.units[: self.n]


def fit_cells(photos: DataFrame, hash_col: str, vector_col: str, dim: int, cell_size: int, margin: float, sample: int | None = None) -> Cells | None:
    """Cells of about ``cell_size`` vectors each, fitted on a sample of digests with a usable vector, drawn by hash; None if nothing is usable.

    The sample grows with the number of cells from ``SAMPLE_LEAST`` to ``SAMPLE_BOUND``; ``sample`` sets it. Cells that the
    sample shows to hold, with copies, more than ``BLOCK`` are divided into parts of half as many.
    """
    keyed = photos.select(digest(hash_col).alias("d"), F.col(vector_col).alias("v")).where("d is not null and v is not null")

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at, _ = usable_rows(b.column("v"), dim)
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(at))], names=["d"])

    # the rate of the draw follows from the usable digests alone; the count is only near, but 0 just if there is none
    total = keyed.mapInArrow(usable, "d string").agg(F.approx_count_distinct("d", 0.02)).first()[0]
    if not total:
        return None
    wanted = -(-int(total) // cell_size)
    sample = sample or min(SAMPLE_BOUND, max(SAMPLE_LEAST, PER_CELL * wanted))
    part = min(1.0, sample / total)

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in pieces(batches):
            at, v = usable_rows(b.column("v"), dim)
            d = b.column("d").take(pa.array(at)).to_pylist()
            new = [i for i, x in enumerate(d) if not (x in seen or seen.add(x))]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for i in new]), pa.array([pack(v[i]) for i in new], pa.binary())], names=["d", "p"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the sample is bounded, so one task holds it, unpacked as it comes; the driver gets the centres alone
        most = sample + sample // 8
        digests, units = Rows(dim, most).filled(batches, "d", "p")
        order = np.argsort(np.array(digests))
        if len(order) > most:
            units = units[order[:most]]
        else:
            reorder(units, order)
        centres = fit_centres(units, max(1, min(len(units), wanted)))
        cells = Cells(centres, margin, dim, np.ones(len(centres), np.int32))
        held = np.zeros(len(centres))
        for s in range(0, len(units), 4096):
            np.add.at(held, cells.place(units[s : s + 4096])[1], int(total) / len(units))
        found = pa.table({"i": pa.array(range(len(centres)), pa.int32()), "centre": pa.array([c.astype("<f4").tobytes() for c in centres], pa.binary()), "held": pa.array(held, pa.float64())})
        yield from found.to_batches(PIECE)

    while True:
        drawn = keyed.where(F.pmod(F.xxhash64("d", F.lit(11)), F.lit(1 << 30)) < int(part * (1 << 30)))
        rows = drawn.mapInArrow(first_of_each, "d string, p binary").groupBy("d").agg(F.min("p").alias("p"))
        fitted = rows.groupBy(F.lit(0).alias("one")).applyInArrow(fit, "i int, centre binary, held double").toPandas().sort_values("i")
        if len(fitted) or part >= 1:
            break
        part = min(1.0, 8 * part)  # an empty draw is not an empty table
    centres = np.stack([np.frombuffer(c, "<f4") for c in fitted["centre"]])
    held = fitted["held"].to_numpy()
    return Cells(centres, margin, dim, np.where(held > BLOCK, np.ceil(2 * held / BLOCK), 1).astype(np.int32))


def by_cell(photos: DataFrame, hash_col: str, vector_col: str, cells: Cells) -> DataFrame:
    """(cell, lo, hi, part, whole, home, digest binary, packed) of all usable vectors, repeats of a digest already reduced within a task.

    A divided cell comes as the pairs (lo, hi) of its parts, so that every two of its vectors meet in just one of them and
    none holds more than two parts; a vector's part follows from the vector, so that equal ones share it. Rows without a
    digest or a usable vector are left out.
    """

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in pieces(batches):
            at, v = usable_rows(b.column("v"), cells.dim)
            d = b.column("d").take(pa.array(at)).to_pylist()
            new = [i for i, x in enumerate(d) if not (x in seen or seen.add(x))]
            if not new:
                continue
            v = v[new]
            row, cell, home = cells.place(unit(v))
            packed = [pack(x) for x in v]
            names = [bytes.fromhex(d[i]) for i in new]
            times = cells.parts[cell]
            own = np.array([zlib.crc32(p) for p in packed], np.int64)[row] % times
            other = np.concatenate([np.arange(t) for t in times])
            row, cell, home, own, whole = (np.repeat(x, times) for x in (row, cell, home, own, times == 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(np.minimum(own, other), pa.int32()), pa.array(np.maximum(own, other), pa.int32()), pa.array(own, pa.int32()), pa.array(whole), pa.array(home),
                 pa.array([names[i] for i in row], pa.binary()), pa.array([packed[i] for i in row], pa.binary())],
                names=["cell", "lo", "hi", "part", "whole", "home", "digest", "packed"],
            )

    keyed = photos.select(digest(hash_col).alias("d"), F.col(vector_col).alias("v")).where("d is not null and v is not null")
    return keyed.mapInArrow(copies, "cell int, lo int, hi int, part int, whole boolean, home boolean, digest binary, packed binary")


@dataclass
class Block:
    """The vectors of one task, each once however many digests have it, in order of their smallest digest.

    ``names`` are the digests, those of a vector together and in order; vector i has ``names[first[i]:first[i + 1]]``. Whether
    a vector is at home in the cell and which part it is of is the same for all its digests.
    """

    names: list[bytes]
    first: np.ndarray
    units: np.ndarray
    home: np.ndarray
    part: np.ndarray
    lo: int
    hi: int
    #: Whether the block is the cell.
    whole: bool

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def sides(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of home vectors, positions of all they are compared with) so that every two vectors meet once."""
        if self.lo == self.hi:
            yield np.flatnonzero(self.home), np.arange(len(self.units))
            return
        for a, b in ((self.lo, self.hi), (self.hi, self.lo)):
            yield np.flatnonzero(self.home & (self.part == a)), np.flatnonzero(self.part == b)


def block_of(batches: Iterable[pa.RecordBatch], dim: int) -> Block:
    """The block of a group's rows, which are unpacked as they come: no second copy of the vectors is held, packed or not."""
    rows, at = Rows(dim, PIECE), {}
    names, of, homes, parts, one = [], [], [], [], None
    for b in pieces(batches):
        one = one or b.slice(0, 1).to_pylist()[0]
        packed, new = b.column("packed").to_pylist(), []
        for p in packed:
            # equal vectors are packed alike; 16 bytes of a hash tell them apart
            key = hashlib.blake2b(p, digest_size=16).digest()
            if key not in at:
                at[key] = len(at)
                new.append(p)
            of.append(at[key])
        if new:
            rows.add(new)
        names += b.column("digest").to_pylist()
        homes.append(b.column("home").to_numpy(zero_copy_only=False))
        parts.append(b.column("part").to_numpy())
    units = rows.units[: rows.n]
    frame = pd.DataFrame({"digest": names, "of": of, "home": np.concatenate(homes), "part": np.concatenate(parts)})
    frame = frame.sort_values("digest", kind="stable").drop_duplicates("digest")
    of, vectors = pd.factorize(frame["of"])  # in order of their first, which is the smallest digest
    if len(vectors) == len(units):
        reorder(units, vectors)
    else:
        units = units[vectors]
    order = np.argsort(of, kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(of, minlength=len(vectors)))]
    one_of = order[first[:-1]]
    names = frame["digest"].to_numpy()[order].tolist()
    return Block(names, first, units, frame["home"].to_numpy()[one_of], frame["part"].to_numpy()[one_of], one["lo"], one["hi"], one["whole"])


def per_cell(placed: DataFrame, search: Callable[[Block], Iterable[pa.Table]], schema: str, dim: int) -> DataFrame:
    """``search(block)`` -> tables, once for each cell or pair of a divided cell's parts, grouped by one shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in search(block_of(batches, dim)):
            yield from table.to_batches(PIECE)

    return placed.groupBy("cell", "lo", "hi").applyInArrow(rows, schema)

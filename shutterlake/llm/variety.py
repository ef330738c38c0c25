"""Choosing a varied subset by a round robin over grids of several attributes; SQL only.

The attributes are sums of equal stretches of the normalised vector, less their means. In a block of them a record's bin
is the attribute of largest size, with its sign: an alike photo mostly shares it, as noise seldom changes which is largest.
The bins of the blocks together are a cell. There are two grids over different attributes, with about twice as many cells
each as records to choose. How many records share both cells says how dense the library is around a record. Within each
cell records are ranked by density, densest first, and a record's rank is the worse of its two: of a series that spreads
over several cells of one grid, most records stand behind another of the series in the other grid. The subset takes all
records of rank 1, then all of rank 2 and so on, the densest of the last rank first, until it is full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.digests import digest
from shutterlake.session import drop, materialise

#: Places of a cell that are looked at first; eight times as many where that gives too few records.
PLACES = 64


def shape(want: int, dim: int) -> tuple[int, int]:
    """(blocks, attributes of a block) of each of the two grids: about twice ``want`` cells, from stretches of at least two values where there are enough."""
    for blocks in range(1, 9):
        width = max(1, round((2 * want) ** (1 / blocks) / 2))
        if 2 * blocks * width <= max(4, dim // 2):
            return blocks, width
    return max(1, dim // 4), 1


def features(photos: DataFrame, parts: int, hash_col: str = "hash", vector_col: str = "dinov3", dim: int = 768) -> DataFrame:
    """(hash, f array<double>) of each digest with a usable vector: the sums of ``parts`` stretches."""
    # a null, NaN or infinite value makes the sum of squares null, NaN or infinite
    norm = "sqrt(aggregate(v, 0D, (a, x) -> a + cast(x as double) * x))"
    edge = f"int((i * {dim}) div {parts})"
    sums = f"transform(sequence(0, {parts - 1}), i -> aggregate(slice(v, {edge} + 1, {edge.replace('i *', '(i + 1) *')} - {edge}), 0D, (a, x) -> a + x))"
    rows = photos.select(digest(hash_col).alias("hash"), F.col(vector_col).alias("v")).where(f"hash is not null and size(v) = {dim}")
    rows = rows.selectExpr("hash", f"{sums} as s", f"{norm} as norm").where("norm > 0 and norm < double('infinity')")
    # all usable vectors of a digest are equal; the norm divides only here, as a projection before would compute it for each sum
    return rows.groupBy("hash").agg(F.min(F.struct("norm", "s")).alias("x")).selectExpr("hash", "transform(x.s, y -> y / x.norm) as f")


def _cell(grid: int, blocks: int, width: int) -> str:
    """SQL of the cell in a grid, from the attributes ``f`` and their ``means``."""
    parts = []
    for b in range(blocks):
        own = ", ".join([str((grid * blocks + b) * width + 1), str(width)])
        sized = f"transform(zip_with(slice(f, {own}), slice(means, {own}), (x, y) -> x - y), (x, i) -> struct(abs(x) as size, 2 * i + if(x > 0, 1, 0) as code))"
        parts.append(f"array_max({sized}).code * {(2 * width) ** b}L")
    return " + ".join(parts)


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of highest density, then lowest hash, without sorting them in one place."""
    if n <= 0:
        return rows.limit(0)
    upto = lambda by, name: f"sum(m) over (order by {by}) as {name}"
    # as many rows as there are densities, then as many as buckets of hashes
    last = rows.groupBy("density").agg(F.count("*").alias("m")).selectExpr("density", "m", upto("density desc", "upto")).where(f"upto >= {n}").agg(F.max(F.struct("density", (F.col("upto") - F.col("m")).alias("before"))).alias("x")).first()["x"]
    if last is None:
        return rows
    taken, tied = rows.where(F.col("density") > last["density"]), rows.where(F.col("density") == last["density"]).withColumn("bucket", F.shiftrightunsigned("h", 48))
    n -= last["before"]
    cut = tied.groupBy("bucket").agg(F.count("*").alias("m")).selectExpr("bucket", "m", upto("bucket", "upto")).where(f"upto >= {n}").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("m")).alias("before"))).alias("x")).first()["x"]
    rest = tied.where(F.col("bucket") == cut["bucket"]).orderBy("h", "hash").limit(n - cut["before"])
    return taken.unionByName(tied.where(F.col("bucket") < cut["bucket"]).drop("bucket")).unionByName(rest.drop("bucket"))


def varied_subset(photos: DataFrame, size: int | None = None, share: float = 0.01, hash_col: str = "hash", vector_col: str = "dinov3", dim: int = 768, places: int = PLACES) -> DataFrame:
    """(hash, cell, rank): ``size`` digests, or ``share`` of all with a usable vector, at least one. ``cell`` is that of the first grid.

    Nulls: rows without a digest or a usable vector take no part; repeated rows of a digest count once; ties are settled
    by a hash of the digest and then the digest; a size beyond the number of digests takes all; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = photos.sparkSession
    # the grids need the size only roughly, so that rows stand for digests here
    blocks, width = shape(max(1, round(photos.count() * share) if size is None else size), dim)
    parts = 2 * blocks * width
    made, made_at = materialise(features(photos, parts, hash_col, vector_col, dim), "features")
    # as many means as attributes, at most half of the vector's values
    means = made.agg(F.array(*[F.avg(F.get("f", F.lit(i))) for i in range(parts)]).alias("means"))
    cells = made.join(F.broadcast(means)).selectExpr("hash", f"{_cell(0, blocks, width)} as g0", f"{_cell(1, blocks, width)} as g1", "xxhash64(hash, 5) as h")
    placed, placed_at = materialise(cells, "cells")
    together = placed.groupBy("g0", "g1").agg(F.count("*").alias("density"))
    dense, dense_at = materialise(placed.join(together, ["g0", "g1"]), "dense")
    total = dense.count()
    want = min(max(1, round(total * share)) if size is None else size, total)
    while True:
        # the limit on the place reaches the map side, so that a cell with a third of all records sends a few from each task
        place = lambda g: dense.selectExpr("hash", "g0", "density", "h", f"row_number() over (partition by {g} order by density desc, h, hash) as place").where(f"place <= {places}")  # noqa: B023, E731
        second = place("g1").select("hash", F.col("place").alias("other"))
        ranked, ranked_at = materialise(place("g0").join(second, "hash").selectExpr("hash", "g0", "density", "h", "greatest(place, other) as rank"), "ranked")
        sizes = ranked.groupBy("rank").agg(F.count("*").alias("m")).selectExpr("rank", "m", "sum(m) over (order by rank) as upto")  # at most ``places`` rows
        last = sizes.where(f"upto >= {want}").agg(F.min(F.struct("rank", (F.col("upto") - F.col("m")).alias("before"))).alias("x")).first()["x"]
        if last is not None or places >= total:
            break
        drop(spark, ranked_at)
        places *= 8
    if last is None:  # an empty table
        chosen = ranked.limit(0)
    else:
        chosen = ranked.where(F.col("rank") < last["rank"]).unionByName(_first(ranked.where(F.col("rank") == last["rank"]), want - last["before"]))
    for path in (made_at, placed_at, dense_at):
        drop(spark, path)
    return chosen.select("hash", F.col("g0").cast("bigint").alias("cell"), F.col("rank").cast("bigint").alias("rank"))

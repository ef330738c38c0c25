"""Best representative of each duplicate group: a surviving value for each field.

Where a rule of trust decides (``survivors``), the most trusted row that has a value gives it: no vote is taken, as none
could change that. Where a majority decides (``voted``), it is by token-level consensus: the values of a group are cut
into tokens and aligned progressively, the heaviest first; each next value is aligned with the columns so far. Every
column then votes with the weights of its values, and the winners make up the consensus. The survivor is the existing
value closest to it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.digests import digest

_TOKENS = re.compile(r"\d|[^\W\d_]+|[^\w\s]|_")


def tokens(value: str) -> list[str]:
    return _TOKENS.findall(value)


def align(columns: list[dict], value: Sequence[str], weight: float, total: float) -> list[dict]:
    """``columns`` (token -> weight, None for a gap) with one more value aligned by least weighted disagreement."""
    n, m = len(columns), len(value)
    # a token new to a column costs a little more than a gap, so that of equal alignments the one with more agreement wins
    miss = [[total - c[t] if t in c else total * 1.01 for t in value] for c in columns]
    gap = [total - c.get(None, 0.0) for c in columns]
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        cost[0][j] = cost[0][j - 1] + total
    for i in range(1, n + 1):
        row, up, g, d = cost[i], cost[i - 1], gap[i - 1], miss[i - 1]
        row[0] = up[0] + g
        for j in range(1, m + 1):
            row[j] = min(up[j - 1] + d[j - 1], up[j] + g, row[j - 1] + total)
    out: list[dict] = []
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + miss[i - 1][j - 1]:
            i, j = i - 1, j - 1
            c, t = dict(columns[i]), value[j]
        elif i and cost[i][j] == cost[i - 1][j] + gap[i - 1]:
            i -= 1
            c, t = dict(columns[i]), None
        else:
            j -= 1
            c, t = {None: total}, value[j]
        c[t] = c.get(t, 0.0) + weight
        out.append(c)
    return out[::-1]


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def consensus(values: Sequence[str], weights: Sequence[float]) -> int:
    """Place of the value closest to the consensus of all; of equally close ones the first."""
    split = [tokens(v) for v in values]
    columns: list[dict] = []
    total = 0.0
    for value, weight in zip(split, weights):
        columns = align(columns, value, weight, total)
        total += weight
    agreed = []
    for c in columns:
        best = max(c.items(), key=lambda x: x[1])
        if best[0] is not None:
            agreed.append(best[0])
    away = [distance(v, agreed) for v in split]
    return away.index(min(away))


def survivors(rows: DataFrame, key: str, fields: dict[str, tuple[Column, Column]], order: list[Column], row_id: str) -> DataFrame:
    """(key, field, row_id): which row gives each field's surviving value, for keys with at least two rows.

    ``fields``: name -> (whether the row has a value that counts, its own trust, larger first). ``order``: what decides
    among equal trust, larger first, nulls last; then the larger ``row_id``. Keys without a value that counts have no row
    for that field. A null key is left out; other columns of ``rows`` are ignored. Each task sends one row per key.
    """
    # nulls are the smallest in structs
    ranked = {n: F.struct(trust.alias("trust"), *[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(row_id).alias("id")) for n, (_, trust) in fields.items()}
    best = [F.max(F.when(counts, ranked[n])).alias(f"__{n}") for n, (counts, _) in fields.items()]
    found = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), *best).where("__n >= 2")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"__{n}.id").alias("id")) for n in fields]))
    return found.select("__key", each.alias("f")).where("f.id is not null").select(F.col("__key").alias(key), F.col("f.field").alias("field"), F.col("f.id").alias(row_id))


def voted(rows: DataFrame, key: str, fields: dict[str, Column], weight: Column, order: list[Column], row_id: str) -> DataFrame:
    """(key, field, row_id, value): the existing value closest to the weighted consensus of the group, for keys with at least two rows.

    Here the vote decides: equal values add up their weights, so that a majority outvotes a single trusted row, and values
    that differ in places agree on the others. Equal values are one before groups are gathered, which is all that meets in
    a task. ``row_id`` is the row with that value that is first in ``order``, larger before smaller, nulls last. Nulls and
    empty texts don't vote; a key without a value has no row; a null key is left out; other columns are ignored.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields.items()]))
    ranked = [f"__o{i}" for i in range(len(order))]
    slim = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(row_id).alias("__id"), weight.cast("double").alias("__w"), each.alias("__f"), *[o.alias(n) for o, n in zip(order, ranked)])
    slim = slim.select("__key", "__id", "__w", "__f.*", *ranked)
    first = F.max(F.struct(*[x for n in ranked for x in (F.col(n).isNotNull().alias(f"{n}n"), F.col(n))], "__id"))
    values = slim.groupBy("__key", "field", "value").agg(F.count("*").alias("n"), F.sum("__w").alias("w"), first.alias("f"))
    heard = F.when((F.col("value") != "") & (F.col("w") > 0), F.struct((-F.col("w")).alias("w"), "value", F.col("f.__id").alias("id")))
    gathered = values.groupBy("__key", "field").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(heard)).alias("g"))

    @F.pandas_udf("int")
    def chosen(g: pd.Series) -> pd.Series:
        return pd.Series([0 if len(x) == 1 else consensus([r["value"] for r in x], [-r["w"] for r in x]) for x in g], dtype="int32")

    best = gathered.where("n >= 2 and size(g) > 0").select("__key", "field", "g", chosen("g").alias("at")).select("__key", "field", F.get("g", F.col("at")).alias("b"))
    return best.select(F.col("__key").alias(key), "field", F.col("b.id").alias(row_id), F.col("b.value").alias("value"))


def is_score(c: str) -> Column:
    """Whether there is a score from 0 to 100."""
    v = F.col(c)
    return v.between(0, 100) & ~F.isnan(v)


def photo_survivors(photos: DataFrame) -> DataFrame:
    """(hash, field, record_id) of the surviving scores of all photos with several rows."""
    source = F.lower(F.trim(F.col("aesthetic_score_source")))
    trust = F.when(source == "siglip", 2).when(source == "regressor", 1).otherwise(0)
    rows = photos.select(digest("hash").alias("hash"), "record_id", "aesthetic_score", "iq_score", "analysed_at", trust.alias("trust"))
    fields = {"aesthetic_score": (is_score("aesthetic_score"), F.col("trust")), "iq_score": (is_score("iq_score"), F.lit(0))}
    return survivors(rows, "hash", fields, [F.col("analysed_at"), F.col("record_id")], "record_id")


def photo_consensus(photos: DataFrame) -> DataFrame:
    """(hash, field, record_id, value): path, camera and lens of photos with several rows, by vote; a row that both sources know weighs double."""
    rows = photos.select(digest("hash").alias("hash"), "record_id", "path", "analysed_at", "source", F.concat_ws(" ", "exif.camera_make", "exif.camera_model").alias("camera"), F.col("exif.lens_model").alias("lens"))
    weight = F.when(F.col("source") == "both", 2.0).otherwise(1.0)
    return voted(rows, "hash", {"path": F.col("path"), "camera": F.col("camera"), "lens": F.col("lens")}, weight, [F.col("analysed_at"), F.col("record_id")], "record_id")

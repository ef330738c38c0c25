"""Aggregates over records: summaries, distributions over closed domains, groups, top lists and pivots.

All of them are lazy, declare what they compute, and leave partial aggregation, pruning and join strategy to Catalyst.
Several metrics of one grouping share a single pass. Nulls are left out of every metric; ties go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """One row of all ``metrics`` (name -> SQL aggregate) in a single pass."""
    return df.agg(*[F.expr(e).alias(n) for n, e in metrics.items()])


def grouped(df: DataFrame, keys: dict[str, str] | list[str], metrics: dict[str, str], having: str | None = None) -> DataFrame:
    """``metrics`` per group; groups with a null key are left out."""
    keys = keys if isinstance(keys, dict) else {k: k for k in keys}
    out = df.groupBy(*[F.expr(e).alias(n) for n, e in keys.items()]).agg(*[F.expr(e).alias(n) for n, e in metrics.items()])
    for n in keys:
        out = out.where(F.col(n).isNotNull())
    return out.where(having) if having else out


def closed(counted: DataFrame, key: str, domain: list, zero: list[str]) -> DataFrame:
    """``counted`` over the whole of ``domain``: missing keys come with 0 in the columns ``zero``; other keys are left out."""
    kind = counted.schema[key].dataType.simpleString()
    base = counted.sparkSession.createDataFrame([(d,) for d in domain], f"{key} {'string' if kind == 'string' else 'bigint'}")
    return F.broadcast(base).join(counted, key, "left").na.fill(0, zero)  # the domain is a literal list


def histogram(df: DataFrame, value: str, width: float, buckets: int) -> DataFrame:
    """(bucket, n): counts in equal buckets from 0, the last one taking all beyond; empty ones come with 0."""
    rows = df.where(f"{value} IS NOT NULL").groupBy(F.expr(f"CAST(least({buckets - 1}, floor({value} / {width})) AS bigint)").alias("bucket")).agg(F.count("*").alias("n"))
    return closed(rows, "bucket", list(range(buckets)), ["n"])


def top_per(df: DataFrame, by: list[str], order: str, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group in ``order``; without groups, of all rows."""
    if not by:
        return df.orderBy(*[F.expr(o.rsplit(" ", 1)[0]).desc() if o.strip().endswith(" desc") else F.expr(o) for o in order.split(",")]).limit(k)
    window = f"row_number() over (partition by {', '.join(by)} order by {order})"
    return df.selectExpr("*", f"CAST({window} AS bigint) AS {rank}").where(f"{rank} <= {k}")


def share(df: DataFrame, count: str, out: str = "pct", by: list[str] | None = None, digits: int = 1) -> DataFrame:
    """Per cent of the total of ``count``, within ``by``."""
    over = f"partition by {', '.join(by)}" if by else ""
    return df.selectExpr("*", f"round(100.0 * {count} / nullif(sum({count}) over ({over}), 0), {digits}) AS {out}")


def unpivot(df: DataFrame, keep: list[str], columns: dict[str, str], name: str = "field", value: str = "value") -> DataFrame:
    """A row per record and non-null column, in one pass over the records."""
    pairs = ", ".join(f"'{n}', {e}" for n, e in columns.items())
    return df.selectExpr(*keep, f"stack({len(columns)}, {pairs}) AS ({name}, {value})").where(f"{value} IS NOT NULL")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``values`` of ``column`` per ``row``."""
    return df.where(f"{row} IS NOT NULL").groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])

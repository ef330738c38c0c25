"""Series over months and sessions over gaps, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deltas(series: DataFrame, key: str, columns: list[str], digits: int = 4) -> DataFrame:
    """Differences to the previous present key; null where either is."""
    return series.selectExpr("*", *[f"round({c} - lag({c}) over (order by {key}), {digits}) + 0.0 AS {c}_delta" for c in columns])


def change_from_baseline(series: DataFrame, key: str, column: str, digits: int = 2) -> DataFrame:
    """Per cent change from the first value that is neither null nor 0; a 0 shows as null."""
    base = f"first_value(nullif({column}, 0)) ignore nulls over (order by {key} rows between unbounded preceding and unbounded following)"
    return series.selectExpr(key, column, f"round(100.0 * (nullif({column}, 0) - {base}) / {base}, {digits}) + 0.0 AS change_pct")


def zscores(series: DataFrame, key: str, column: str) -> DataFrame:
    """Population z-scores; null below two values, 0 where the spread is below 0.01."""
    n, mean, spread = (f"{f}({column}) over ()" for f in ("count", "avg", "stddev_pop"))
    return series.selectExpr(key, f"CASE WHEN {column} IS NULL OR {n} < 2 THEN NULL WHEN {spread} < 0.01 THEN 0.0 ELSE round(({column} - {mean}) / {spread}, 2) + 0.0 END AS z")


def gap_sessions(events: DataFrame, entity: str, ts: str, gap_s: int) -> DataFrame:
    """``events`` with ``session``, numbered per entity: a gap of more than ``gap_s`` seconds begins a new one."""
    new = f"CASE WHEN unix_micros(CAST({ts} AS timestamp)) - lag(unix_micros(CAST({ts} AS timestamp))) over (partition by {entity} order by {ts}) > {gap_s * 1_000_000} THEN 1 ELSE 0 END"
    flagged = events.selectExpr("*", f"{new} AS __new")
    return flagged.selectExpr("*", f"CAST(sum(__new) over (partition by {entity} order by {ts} rows between unbounded preceding and current row) AS bigint) AS session").drop("__new")

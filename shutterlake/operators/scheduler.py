"""Batch-size scheduling: profile, bandit and runtime clamp, as tables and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The batch sizes to choose from.
ARMS = [1, 2, 4, 8, 16, 32]


def profile(benchmarks: DataFrame) -> DataFrame:
    """(model, best_batch, safe_batch, max_batch, top_rate) from (model, batch_size, images_per_s): the smallest batch within 1 % of the best rate."""
    top = benchmarks.withColumn("top", F.expr("max(images_per_s) over (partition by model)"))
    best = top.groupBy("model").agg(F.min(F.when(F.col("images_per_s") >= 0.99 * F.col("top"), F.col("batch_size"))).alias("best_batch"), F.max("top").alias("top_rate"))
    safe = F.array_max(F.filter(F.array(*map(F.lit, ARMS)), lambda a: a <= F.greatest(F.floor(F.col("best_batch") / 2), F.lit(1))))
    return best.select("model", F.col("best_batch").cast("bigint").alias("best_batch"), safe.cast("bigint").alias("safe_batch"), F.col("best_batch").cast("bigint").alias("max_batch"), F.round("top_rate", 3).alias("top_rate"))


def reward(rate: Column, memory_mb: Column, p95: Column, profiled_p95: Column, failed: Column) -> Column:
    """Throughput less penalties for memory below 8000 MB, slow tails and failures."""
    slow = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(p95, profiled_p95) - 1, F.lit(0.0)))
    return rate - 0.3 * F.greatest(F.lit(0.0), 1 - memory_mb / 8000) - 0.2 * slow - 0.5 * failed.cast("int")


def bandit_state(outcomes: DataFrame) -> DataFrame:
    """(model, arm, n, total): what the appended outcomes (model, arm, reward) add up to."""
    return outcomes.groupBy("model", "arm").agg(F.count("*").alias("n"), F.sum("reward").alias("total"))


def upper_bounds(state: DataFrame) -> DataFrame:
    """(model, arm, ucb): mean reward plus exploration; null for an arm not pulled yet, which goes first."""
    pulls = F.expr("sum(n) over (partition by model)")
    bound = F.when(F.col("n") > 0, F.round(F.col("total") / F.col("n") + F.sqrt(2 * F.log(pulls + 1) / F.col("n")), 6))
    return state.select("model", F.col("arm").cast("bigint").alias("arm"), bound.alias("ucb"))


def choose(bounds: DataFrame, max_batch: int) -> DataFrame:
    """(model, arm): the arm of highest bound up to ``max_batch``; of equal ones the smallest."""
    return bounds.where(F.col("arm") <= max_batch).groupBy("model").agg(F.min(F.struct(F.col("ucb").isNotNull().alias("pulled"), (-F.col("ucb")).alias("u"), "arm")).alias("b")).select("model", F.col("b.arm").alias("arm"))


def adapt(batch: int, p95: float | None, profiled_p95: float | None, rate: float | None, profiled_rate: float | None, arms: list[int], max_batch: int) -> int:
    """Halve to the nearest arm where the tail doubles and the rate falls by a tenth; else clamp."""
    if p95 and profiled_p95 and rate is not None and profiled_rate and p95 > 2 * profiled_p95 and rate < 0.9 * profiled_rate:
        fit = [a for a in arms if a <= max(1, batch // 2)]
        return max(fit) if fit else min(arms)
    return min(batch, max_batch)


#: Synthetic pulls of the best arm, and how fast the others' reward falls off with their size.
PRESEED_PULLS, PRESEED_POWER = 5, 0.7
#: Batch sizes of last resort.
DEFAULTS = {"siglip2-base": 16, "aesthetic-predictor-v2-5": 4, "arniqa": 8, "dinov3-b": 8, "RMBG-2.0": 8, "yolo26n-pose": 16}


def preseeded(profiles: DataFrame) -> DataFrame:
    """(model, arm, n, total) to start with, from (model, best_batch, rate, p95, memory_mb): no arm is without a pull."""
    best = reward(F.col("rate"), F.coalesce("memory_mb", F.lit(8000.0)), F.col("p95"), F.col("p95"), F.lit(0))
    arms = F.explode(F.filter(F.array(*map(F.lit, ARMS)), lambda a: a <= F.col("best_batch")))
    rows = profiles.select("model", "best_batch", best.alias("best"), arms.alias("arm"))
    at_best = F.col("arm") == F.col("best_batch")
    return rows.select("model", "arm", F.when(at_best, PRESEED_PULLS).otherwise(1).cast("bigint").alias("n"), F.when(at_best, F.col("best") * PRESEED_PULLS).otherwise(F.col("best") * F.pow(F.col("arm") / F.col("best_batch"), F.lit(PRESEED_POWER))).alias("total"))


def updated(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The state after further outcomes (model, arm, reward)."""
    return state.select("model", "arm", "n", "total").unionByName(bandit_state(outcomes)).groupBy("model", "arm").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fallback(model: str, best_batch: int | None = None, available_mb: float | None = None, least_mb: float | None = None) -> int:
    """A safe batch size where the rest fails: the profile's, else a fixed one; half of it where memory is short."""
    base = best_batch if best_batch is not None else DEFAULTS.get(model, 4)
    return max(1, base // 2) if available_mb is not None and available_mb < (least_mb or 3000.0) else base


def pick(model: str, profile: dict | None, state: list[dict], p95: float | None = None, rate: float | None = None, deterministic: bool = False, available_mb: float | None = None) -> int:
    """The batch size to use now: the arm of highest bound (or the profile's best), adjusted to what was seen last; never fails."""
    import math

    try:
        if profile is None:
            return fallback(model, available_mb=available_mb)
        proposed = profile["best_batch"]
        if not deterministic:
            own = {r["arm"]: r for r in state if r["model"] == model}
            pulls, top = sum(r["n"] for r in own.values()), -math.inf
            for arm in profile["arms"]:
                r = own.get(arm)
                bound = math.inf if not r or not r["n"] else r["total"] / r["n"] + math.sqrt(2 * math.log(pulls + 1) / r["n"])
                if arm <= profile["max_batch"] and bound > top:
                    proposed, top = arm, bound
        return adapt(proposed, p95, profile["p95"], rate, profile["rate"], profile["arms"], profile["max_batch"])
    except Exception:
        return fallback(model, (profile or {}).get("best_batch"), available_mb, (profile or {}).get("least_mb"))


def outcome(model: str, arm: int, images: int, elapsed_s: float, batches: int, available_mb: float, profiled_p95: float, failed: int = 0) -> dict:
    """One outcome to append: the mean time of a batch stands for its 95th percentile."""
    rate, p95 = images / elapsed_s if elapsed_s > 0 else 0.0, 1000 * elapsed_s / max(1, batches)
    slow = max(0.0, p95 / profiled_p95 - 1) if profiled_p95 > 0 else 0.0
    return {"model": model, "arm": arm, "reward": rate - 0.3 * max(0.0, 1 - available_mb / 8000) - 0.2 * slow - 0.5 * (failed / max(1, images))}


def auto_batch(default: int, free_gb: float | None) -> int:
    """Double with 12 GB free, as it is from 6 GB, half below."""
    if free_gb is None:
        return default
    return min(default * 2, 32) if free_gb >= 12 else default if free_gb >= 6 else max(1, default // 2)


def latencies(timed: DataFrame, by: list[str], run: str, order: str, value: str, warmup: int) -> DataFrame:
    """(by, runs, p50, p95, cv_pct): per run the first ``warmup`` calls are left out and percentiles are picked by index; then medians over runs."""
    keys = ", ".join([*by, run])
    kept = timed.withColumn("__i", F.expr(f"row_number() over (partition by {keys} order by {order})")).where(f"__i > {warmup}")
    # the value at a place follows from a percentile over places, without interpolation
    placed = kept.selectExpr(*by, run, value, f"row_number() over (partition by {keys} order by {value}) - 1 AS at", f"count(*) over (partition by {keys}) AS n")
    runs = placed.groupBy(*by, run).agg(F.max(F.when(F.expr("at = CAST(floor(0.5D * n) AS bigint)"), F.col(value))).alias("p50"), F.max(F.when(F.expr("at = CAST(floor(0.95D * n) AS bigint)"), F.col(value))).alias("p95"))
    rate = F.expr("1000 / p50")
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.expr("round(percentile(p50, 0.5), 2)").alias("p50"), F.expr("round(percentile(p95, 0.5), 2)").alias("p95"), F.round(F.stddev_samp(rate) / F.avg(rate) * 100, 1).alias("cv_pct"))


def curves(benchmarks: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """(model, b1, b2, …): the rates of each model over all batch sizes, null where there is none."""
    return benchmarks.groupBy("model").pivot("batch_size", sizes or ARMS).agg(F.round(F.max("images_per_s"), 3)).withColumnsRenamed({str(a): f"b{a}" for a in sizes or ARMS})


def scaling(benchmarks: DataFrame) -> DataFrame:
    """(model, gain_pct, flat, bottleneck): gain from the smallest to the largest batch; flat below 15 per cent, a bottleneck below 4 images a second."""
    ends = benchmarks.groupBy("model").agg(F.min_by("images_per_s", "batch_size").alias("low"), F.max_by("images_per_s", "batch_size").alias("high"), F.count("*").alias("k")).where("k >= 2")
    return ends.selectExpr("model", "round(CASE WHEN low > 0 THEN (high - low) / low * 100 ELSE 0 END, 2) AS gain_pct", "CASE WHEN low > 0 THEN (high - low) / low * 100 ELSE 0 END < 15 AS flat", "high < 4 AS bottleneck")


def run_summary(passes: DataFrame, total: int, hits: int, extra_mb: float = 3174.0) -> DataFrame:
    """One row from (pass_name, photos, elapsed_s, memory_mb): kind of run, hit rate, peaks of memory all at once and one after the other, and the saving."""
    heavy = F.max(F.when(~F.col("pass_name").startswith("Pass 1"), F.col("photos")))
    one = passes.agg(heavy.alias("heavy"), F.sum(F.coalesce("memory_mb", F.lit(0.0))).alias("mb"), F.max("memory_mb").alias("peak"), F.sum("elapsed_s").alias("elapsed_s"))
    return one.select(
        F.when((F.coalesce("heavy", F.lit(0)) / max(1, total) >= 0.8) & F.lit(total > 0), "full").otherwise("incremental").alias("run_type"), F.round(F.lit(100.0 * hits / max(1, total)), 1).alias("hit_rate_pct"),
        F.round(F.col("mb") + extra_mb, 1).alias("naive_mb"), F.round("peak", 1).alias("peak_mb"), F.round(100 * (1 - F.col("peak") / (F.col("mb") + extra_mb)), 1).alias("saved_pct"), F.round("elapsed_s", 1).alias("elapsed_s"),
    )

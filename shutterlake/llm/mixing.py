"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in shuffled order, repeated pass after pass as often as allowed. Each gets a virtual
finish time, that of its middle: the source's tokens up to there, divided by the source's weight. All sources of a mix
are then served in the order of finish times until the total budget is used up. A document that straddles the end is in
just if more than half of it is within, so that a long one neither ends its source early nor carries it far beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import cut

#: Least number of ranges of an order, and documents for each of which there is a range more.
BUCKETS, PER_BUCKET = 256, 50_000


def _running(df: DataFrame, keys: list[str], order: str, bucket: str, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` up to and with each row, per ``keys``, along ``bucket`` and within it ``order``.

    Two levels, so that no key has to be summed in one task: totals of the buckets run first, then the rows of each.
    """
    by = ", ".join(keys)
    # the last row of a bucket's running sum is its total: one aggregation of a few rows per key, then a join by key and bucket
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__t"))
    ahead = totals.select(*keys, bucket, F.expr(f"coalesce(sum(__t) over (partition by {by} order by {bucket} rows between unbounded preceding and 1 preceding), 0)").alias("__ahead"))
    inner = df.withColumn("__in", F.expr(f"sum({value}) over (partition by {by}, {bucket} order by {order} rows between unbounded preceding and current row)"))
    return inner.join(ahead, [*keys, bucket]).withColumn(out, F.col("__ahead") + F.col("__in")).drop("__ahead", "__in")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17, budget_tokens: int | None = None) -> DataFrame:
    """(mix_id, source, doc_id, tokens, n_used): how often each document of each mix's sources is used; unused ones too.

    By default the scarcest source sets the budget of its mix, so that all shares are met; a larger ``budget_tokens`` lets the
    other sources go on, and the shares of those that have run out fall short, as ``shares`` reports.

    ``sized``: (doc_id, source, tokens); ``targets``: (mix_id, source, target_share, max_repeats). Without
    ``budget_tokens`` a mix gets the largest budget at which every source that has documents can reach its share within
    its repeats. Nulls: documents without source or size and targets without a share above 0 or a repeat take no part;
    empty documents are used once per pass like others; a source without documents leaves its share to the others;
    repeated target rows add up their shares; an empty table gives an empty result.
    """
    goal = targets.where("source is not null and target_share > 0 and max_repeats > 0 and mix_id is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"))
    buckets = 1 << (max(BUCKETS, sized.count() // PER_BUCKET) - 1).bit_length()
    docs = sized.where("source is not null and tokens is not null").select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("__h"))
    docs = docs.withColumn("__b", F.shiftrightunsigned("__h", 64 - (buckets.bit_length() - 1)))
    # tokens of a source up to and with each document, in shuffled order
    queued = cut(_running(docs, ["source"], "__h, doc_id", "__b", "tokens", "upto"))
    totals = queued.groupBy("source").agg(F.sum("tokens").alias("all_tokens"))
    plan = goal.join(totals, "source").where("all_tokens > 0")
    plan = plan.withColumn("weight", F.expr("share / sum(share) over (partition by mix_id)"))
    fit = F.expr("min(all_tokens * most / weight) over (partition by mix_id)")
    plan = plan.withColumn("budget", fit if budget_tokens is None else F.lit(float(budget_tokens)))
    # no pass that starts beyond the budget is reached, but every document is listed once
    passes = F.explode(F.expr("sequence(0L, greatest(0L, least(most - 1L, CAST(floor(budget * weight / all_tokens) AS bigint))))"))
    served = queued.join(plan, "source").select("mix_id", "source", "doc_id", "tokens", "upto", "weight", "budget", "all_tokens", passes.alias("pass"))
    served = served.withColumn("finish", (F.col("pass") * F.col("all_tokens") + F.col("upto") - F.col("tokens") / 2) / F.col("weight"))
    # the global order is by range of finish time, then finish time within the range
    served = served.withColumn("range", F.least(F.floor(F.col("finish") / F.col("budget") * (buckets - 2)), F.lit(4 * buckets)))
    served = _running(served, ["mix_id"], "finish, source, doc_id", "range", "tokens", "served")
    used = F.sum(F.when(F.col("served") - F.col("tokens") / 2 <= F.col("budget"), 1).otherwise(0))
    return served.groupBy("mix_id", "source", "doc_id", "tokens").agg(used.cast("bigint").alias("n_used"))


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, n_documents, most_used); a target source without documents too."""
    goal = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"))
    goal = goal.withColumn("target_share", F.expr("share / sum(share) over (partition by mix_id)")).drop("share")
    got = used.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("n_used")).alias("tokens"), F.count_if(F.col("n_used") > 0).alias("n_documents"), F.max("n_used").alias("most_used"))
    both = goal.join(got, ["mix_id", "source"], "left").na.fill(0, ["tokens", "n_documents", "most_used"])
    share = F.expr("coalesce(try_divide(tokens, sum(tokens) over (partition by mix_id)), 0d)")
    return both.select("mix_id", "source", F.round("target_share", 6).alias("target_share"), F.round(share, 6).alias("actual_share"), "tokens", "n_documents", "most_used")

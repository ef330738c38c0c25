"""Queries of the store, of series, vectors, develop settings and the scheduler, over the tables they suit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.digests import digest
from shutterlake.operators import scheduler, store, vectors
from shutterlake.operators.aggregates import grouped, summary, top_per, unpivot
from shutterlake.operators.temporal import gap_sessions
from shutterlake.plans.library_queries import over
from shutterlake.sources.tables import table

_HEX = "regexp_replace(lower(hash), '^\\s*sha-?256\\s*[:=]?|[^0-9a-f]', '', 'g')"
_DIGEST = f"CASE WHEN length({_HEX}) = 64 THEN {_HEX} END"


# store

@over("", "SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS keeper FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))


@over("", f"""WITH p AS (SELECT {_DIGEST} AS hash, source, path, lightroom_id, lightroom_rating FROM photos)
    SELECT hash, CASE WHEN bool_or(source = 'both') OR (bool_or(source IN ('lightroom', 'both')) AND bool_or(source = 'local')) THEN 'both' WHEN bool_or(source = 'lightroom') THEN 'lightroom' ELSE 'local' END AS source,
    coalesce(min(CASE WHEN source = 'local' THEN path END), min(path)) AS path, coalesce(min(CASE WHEN source <> 'local' THEN lightroom_id END), min(lightroom_id)) AS lightroom_id,
    coalesce(min(CASE WHEN source <> 'local' THEN lightroom_rating END), min(lightroom_rating)) AS lightroom_rating FROM p WHERE hash IS NOT NULL GROUP BY 1""")
def source_merge(spark, folder):
    rows = table(spark, folder, "photos").select(digest("hash").alias("hash"), "source", "path", "lightroom_id", "lightroom_rating")
    return store.merge_sources(rows)


def _sides(spark, folder):
    rows = table(spark, folder, "photos").select(digest("hash").alias("hash"), "source", "path")
    pick = lambda c: rows.where(c).where("hash IS NOT NULL").groupBy("hash").agg(F.min("path").alias("path"))
    return pick("source = 'local'"), pick("source <> 'local'")


@over("", f"""WITH p AS (SELECT {_DIGEST} AS hash, source, path FROM photos), l AS (SELECT hash, regexp_extract(min(path), '([^/]+?)(\\.[^./]*)?$', 1) AS s FROM p WHERE source = 'local' AND hash IS NOT NULL GROUP BY 1),
    r AS (SELECT hash, regexp_extract(min(path), '([^/]+?)(\\.[^./]*)?$', 1) AS s FROM p WHERE source <> 'local' AND hash IS NOT NULL GROUP BY 1),
    same AS (SELECT r.hash, l.hash AS local_key, r.s AS stem FROM r JOIN l USING (hash)),
    r2 AS (SELECT * FROM r WHERE hash NOT IN (SELECT hash FROM l)), l2 AS (SELECT * FROM l WHERE hash NOT IN (SELECT hash FROM r)),
    pair AS (SELECT a.hash, b.hash AS local_key, a.s AS stem FROM (SELECT s, min(hash) AS hash FROM r2 GROUP BY 1) a JOIN (SELECT s, min(hash) AS hash FROM l2 GROUP BY 1) b USING (s))
    SELECT *, 'both' AS source FROM same UNION ALL SELECT *, 'both' FROM pair UNION ALL SELECT hash, NULL, s, 'lightroom' FROM r2 WHERE hash NOT IN (SELECT hash FROM pair)
    UNION ALL SELECT hash, hash, s, 'local' FROM l2 WHERE hash NOT IN (SELECT local_key FROM pair)""")
def stem_merge(spark, folder):
    local, remote = _sides(spark, folder)
    return store.merge_by_stem(local, remote)


@over("", f"""WITH p AS (SELECT {_DIGEST} AS hash, source, iq_score FROM photos), f AS (SELECT DISTINCT hash FROM p WHERE source = 'local' AND hash IS NOT NULL), c AS (SELECT hash, max(CASE WHEN iq_score BETWEEN 0 AND 100 THEN iq_score END) AS iq FROM p WHERE source <> 'local' GROUP BY 1)
    SELECT count(*) AS n, count(c.hash) AS hits, count(c.iq) AS with_iq FROM f LEFT JOIN c ON f.hash = c.hash""")
def overlay_hit_rate(spark, folder):
    rows = table(spark, folder, "photos").selectExpr("hash AS h", "source", "CASE WHEN iq_score BETWEEN 0 AND 100 THEN iq_score END AS iq").withColumn("hash", digest("h"))
    fresh = rows.where("source = 'local' AND hash IS NOT NULL").select("hash").distinct()
    cached = rows.where("source <> 'local'").groupBy("hash").agg(F.max("iq").alias("iq"))
    return summary(store.overlay(fresh, cached, "hash", ["iq"]), {"n": "count(*)", "hits": "count_if(hit)", "with_iq": "count(iq)"})


_SNAPSHOTS = "WITH a AS (SELECT lightroom_id, min(row_id) AS f, max(row_id) AS t FROM asset_feed GROUP BY 1), c AS (SELECT a.lightroom_id, x.lightroom_updated AS u FROM a JOIN asset_feed x ON x.row_id = a.f), n AS (SELECT a.lightroom_id, x.lightroom_updated AS u FROM a JOIN asset_feed x ON x.row_id = a.t)"


@over("", _SNAPSHOTS + " SELECT n.lightroom_id, n.u AS lightroom_updated, 'updated' AS change FROM n JOIN c USING (lightroom_id) WHERE n.u IS DISTINCT FROM c.u")
def change_detection(spark, folder):
    rows = table(spark, folder, "asset_feed").select("lightroom_id", "lightroom_updated", "row_id")
    both = rows.groupBy("lightroom_id").agg(F.min_by("lightroom_updated", "row_id").alias("u0"), F.max_by("lightroom_updated", "row_id").alias("u1"))
    fresh, cached = both.select("lightroom_id", F.col("u1").alias("lightroom_updated")), both.select("lightroom_id", F.col("u0").alias("lightroom_updated"))
    return store.changed(fresh, cached, "lightroom_id", "lightroom_updated")


@over("", "SELECT count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS kept, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS removed FROM customer")
def prune_antijoin(spark, folder):
    kept, removed = store.prune(table(spark, folder, "customer"), table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    both = kept.select(F.lit(1).alias("k")).unionAll(removed.select(F.lit(0).alias("k")))
    return summary(both, {"kept": "count_if(k = 1)", "removed": "count_if(k = 0)"})


@over("", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def upsert_result(spark, folder):
    base = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    delta = base.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X"))
    return store.upsert(base, delta, "o_orderkey")


@over("", "SELECT source, count(*) FILTER (WHERE iq_score IS NULL AND (path IS NOT NULL OR lightroom_id IS NOT NULL)) AS queue FROM photos GROUP BY 1 HAVING queue > 0")
def work_queue(spark, folder):
    return store.pending(table(spark, folder, "photos"), "iq_score").groupBy("source").agg(F.count("*").alias("queue"))


# series and sessions

@over("", """WITH e AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 14400000000 THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT user_id, CAST(session AS bigint) AS session, count(*) AS n, min(ts) AS began, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 1) AS minutes, round(max(value), 2) AS hero FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def session_summary(spark, folder):
    s = gap_sessions(table(spark, folder, "events"), "user_id", "ts", 4 * 3600)
    us = lambda c: f"unix_micros(CAST({c} AS timestamp))"
    return grouped(s, ["user_id", "session"], {"n": "count(*)", "began": "min(ts)", "minutes": f"CAST(round(({us('max(ts)')} - {us('min(ts)')}) / 60000000.0D, 1) AS double)", "hero": "round(max(value), 2)"}, "n >= 2")


@over("", """WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 14400000000 THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e), g AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT count(*) AS sessions, round(avg(n), 2) AS mean_size, max(n) AS largest FROM g""")
def session_totals(spark, folder):
    s = gap_sessions(table(spark, folder, "events"), "user_id", "ts", 4 * 3600)
    return summary(grouped(s, ["user_id", "session"], {"n": "count(*)"}, "n >= 2"), {"sessions": "count(*)", "mean_size": "round(avg(n), 2)", "largest": "max(n)"})


@over("", "SELECT event_type, CAST(floor(CAST(json_extract_string(props, '$.k') AS int) / 10) AS bigint) AS bucket, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2 HAVING bucket IS NOT NULL")
def json_buckets(spark, folder):
    e = table(spark, folder, "events").selectExpr("event_type", "value", "CAST(floor(try_cast(get_json_object(props, '$.k') AS int) / 10) AS bigint) AS bucket")
    return grouped(e, ["event_type", "bucket"], {"n": "count(*)", "mean": "round(avg(value), 4)"})


@over("", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark, folder):
    from shutterlake.streaming.windows import windowed_counts

    return windowed_counts(table(spark, folder, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@over("", """SELECT CASE WHEN gap <= 0 THEN 'same_day' WHEN gap <= 7 THEN 'week' WHEN gap <= 30 THEN 'month' ELSE 'later' END AS bucket, count(*) AS n FROM
    (SELECT CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0) AS bigint) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def gap_recency(spark, folder):
    j = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    gap = "floor((unix_micros(CAST(l_shipdate AS timestamp)) - unix_micros(CAST(o_orderdate AS timestamp))) / 86400000000D)"
    return grouped(j.selectExpr(f"{gap} AS gap"), {"bucket": "CASE WHEN gap <= 0 THEN 'same_day' WHEN gap <= 7 THEN 'week' WHEN gap <= 30 THEN 'month' ELSE 'later' END"}, {"n": "count(*)"})


# develop settings: each order's lines by status stand for a record's sliders

SLIDERS = {"quantity": "avg(l_quantity) - 25", "discount": "100 * avg(l_discount) - 5", "tax": "100 * avg(l_tax) - 4", "price": "avg(l_extendedprice) / 1000 - 25"}
_S = "WITH s AS (SELECT l_orderkey AS id, l_returnflag AS flag, " + ", ".join(f"{e} AS {n}" for n, e in SLIDERS.items()) + " FROM lineitem GROUP BY 1, 2)"
_U = _S + ", u AS (" + " UNION ALL ".join(f"SELECT id, flag, '{n}' AS slider, {n} AS value FROM s" for n in SLIDERS) + ")"
_INTENSITY = " + ".join(f"abs({n})" for n in SLIDERS)


def _sliders(spark, folder):
    return grouped(table(spark, folder, "lineitem"), {"id": "l_orderkey", "flag": "l_returnflag"}, SLIDERS)


@over("", _U + " SELECT slider, round(avg(value), 4) AS mean, count(*) AS n FROM u GROUP BY 1")
def slider_means(spark, folder):
    return grouped(unpivot(_sliders(spark, folder), ["id"], {n: n for n in SLIDERS}, "slider"), ["slider"], {"mean": "round(avg(value), 4)", "n": "count(*)"})


@over("", _U + " SELECT flag, slider, round(quantile_cont(value, 0.5), 4) AS med, round(stddev_pop(value), 4) AS std, round(least(abs(quantile_cont(value, 0.5)) / 15, 1.0), 4) AS strength FROM u GROUP BY 1, 2")
def slider_signature(spark, folder):
    return grouped(unpivot(_sliders(spark, folder), ["flag"], {n: n for n in SLIDERS}, "slider"), ["flag", "slider"], {"med": "round(percentile(value, 0.5), 4)", "std": "round(stddev_pop(value), 4)", "strength": "round(least(abs(percentile(value, 0.5)) / 15, 1.0D), 4)"})


@over("", _S + f" SELECT CAST(least(9, floor(({_INTENSITY}) / 10)) AS bigint) AS bucket, count(*) AS n, round(avg({_INTENSITY}), 4) AS mean FROM s GROUP BY 1")
def intensity_histogram(spark, folder):
    return grouped(_sliders(spark, folder), {"bucket": f"CAST(least(9, floor(({_INTENSITY}) / 10)) AS bigint)"}, {"n": "count(*)", "mean": f"round(avg({_INTENSITY}), 4)"})


@over("", _S + f""", x AS (SELECT {_INTENSITY} AS i, least(100, o_totalprice / 5000) AS score FROM s JOIN orders ON id = o_orderkey), b AS (SELECT min(i) AS lo, max(i) AS hi FROM x)
    SELECT CAST(least(4, floor((i - lo) / ((hi - lo) / 5))) AS bigint) AS bin, count(*) AS n, round(avg(score), 4) AS mean FROM x, b WHERE hi > lo GROUP BY 1""")
def score_by_intensity(spark, folder):
    x = _sliders(spark, folder).join(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), F.col("id") == F.col("o_orderkey")).selectExpr(f"{_INTENSITY} AS i", "least(100, o_totalprice / 5000) AS score")
    limits = x.agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    return grouped(x.crossJoin(F.broadcast(limits)).where("hi > lo"), {"bin": "CAST(least(4, floor((i - lo) / ((hi - lo) / 5))) AS bigint)"}, {"n": "count(*)", "mean": "round(avg(score), 4)"})


@over("", """SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n, round(100 * avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 1) AS discounted, round(100 * avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 1) AS taxed,
    round(avg(l_quantity), 4) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def monthly_adoption(spark, folder):
    j = table(spark, folder, "lineitem").select("l_orderkey", "l_discount", "l_tax", "l_quantity").join(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = lambda c: f"round(100 * avg(CASE WHEN {c} THEN 1.0D ELSE 0.0D END), 1)"
    return grouped(j, {"ym": "date_format(o_orderdate, 'yyyy-MM')"}, {"n": "count(*)", "discounted": flag("l_discount > 0.05"), "taxed": flag("l_tax > 0.04"), "quantity": "round(avg(l_quantity), 4)"})


@over("", """WITH g AS (SELECT p_brand, p_type, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM g) WHERE rank <= 2""")
def brand_types(spark, folder):
    j = table(spark, folder, "lineitem").select("l_partkey", "l_quantity").join(table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return top_per(grouped(j, ["p_brand", "p_type"], {"n": "count(*)", "mean": "round(avg(l_quantity), 4)"}), ["p_brand"], "n desc, p_type", 2)


@over("", """SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def region_rollup(spark, folder):
    t = lambda n: table(spark, folder, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# vectors

EPS = 0.6
_D = "round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-9) / (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9), 6)"
_PAIRS = f"WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b, {_D} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_D} <= {EPS})"
_GROUPS = _PAIRS + ", both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a AS id, a AS root FROM both_ UNION SELECT both_.b, c.root FROM c JOIN both_ ON both_.a = c.id), g AS (SELECT id, min(root) AS root FROM c GROUP BY 1)"


def _pairs(spark, folder):
    return vectors.similar_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", EPS).withColumn("dist", F.round("dist", 6))


@over("", _PAIRS + " SELECT * FROM e")
def cosine_pairs(spark, folder):
    return _pairs(spark, folder)


@over("", _GROUPS + " SELECT * FROM g")
def near_dup_groups(spark, folder):
    return vectors.components(_pairs(spark, folder))


@over("", _GROUPS + " SELECT CAST(sum(n - 1) AS bigint) AS redundant, (SELECT count(*) FROM embeddings) - CAST(sum(n) AS bigint) AS single, round(100.0 * sum(n - 1) / (SELECT count(*) FROM embeddings), 2) AS pct FROM (SELECT root, count(*) AS n FROM g GROUP BY 1)")
def storage_tiers(spark, folder):
    sizes = vectors.components(_pairs(spark, folder)).groupBy("root").agg(F.count("*").alias("n"))
    total = table(spark, folder, "embeddings").agg(F.count("*").alias("total"))
    return sizes.agg(F.sum(F.col("n") - 1).alias("redundant"), F.sum("n").alias("m")).crossJoin(F.broadcast(total)).selectExpr("redundant", "total - m AS single", "CAST(round(100.0 * redundant / total, 2) AS double) AS pct")


@over("", _GROUPS + ", x AS (SELECT g.*, CAST(label AS double) * 10 AS score FROM g JOIN embeddings ON vec_id = id) SELECT root, count(*) AS size, min_by(id, (-score, id)) AS hero, round(max(score), 4) AS best FROM x GROUP BY 1")
def burst_heroes(spark, folder):
    scores = table(spark, folder, "embeddings").selectExpr("vec_id AS id", "CAST(label AS double) * 10 AS score", "CAST(NULL AS double) AS sharp")
    return vectors.heroes(vectors.components(_pairs(spark, folder)), scores)


SEEDS = 20
_NEAR = f"WITH s AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT {SEEDS}), d AS (SELECT vec_id, round(min(list_distance(embedding::DOUBLE[], s.v)), 5) AS dist FROM embeddings, s GROUP BY 1)"


def _near(spark, folder):
    rows = table(spark, folder, "embeddings")
    seeds = np.array([r[0] for r in rows.orderBy("vec_id").limit(SEEDS).select("embedding").collect()])
    return vectors.seed_distance(rows, seeds, "vec_id", "embedding").withColumn("dist", F.round("dist", 5) + 0.0)


@over("", _NEAR + " SELECT round(quantile_cont(dist, 0.95), 4) AS threshold FROM d")
def coverage_threshold(spark, folder):
    return _near(spark, folder).agg(F.round(F.percentile("dist", 0.95), 4).alias("threshold"))


@over("", _NEAR + " SELECT vec_id, dist > (SELECT quantile_cont(dist, 0.95) FROM d) AS outside FROM d")
def ood_flags(spark, folder):
    near = _near(spark, folder)
    limit = near.agg(F.percentile("dist", 0.95).alias("limit"))
    return near.crossJoin(F.broadcast(limit)).selectExpr("vec_id", "dist > limit AS outside")


# the same over the seeds of the dealt method, which SQL cannot select


@over("", None)
def seed_selection(spark, folder):
    return vectors.select_seeds(table(spark, folder, "embeddings"), "vec_id", "embedding")


def _near_seeds(spark, folder):
    rows = table(spark, folder, "embeddings")
    # bounded by seed_count
    seeds = rows.join(vectors.select_seeds(rows, "vec_id", "embedding"), "vec_id").select("embedding").collect()
    return vectors.seed_distance(rows, np.array([r[0] for r in seeds]), "vec_id", "embedding").withColumn("dist", F.round("dist", 5) + 0.0)


@over("", None)
def seed_coverage_threshold(spark, folder):
    return _near_seeds(spark, folder).agg(F.round(F.percentile("dist", 0.95), 4).alias("threshold"))


@over("", None)
def seed_ood_flags(spark, folder):
    near = _near_seeds(spark, folder)
    limit = near.agg(F.percentile("dist", 0.95).alias("limit"))
    return near.crossJoin(F.broadcast(limit)).selectExpr("vec_id", "dist > limit AS outside")


@over("", """WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT label, d, sum(x) AS s, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT label AS cluster, max(n) AS n, CASE WHEN max(n) > 1 THEN round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 4) + 0.0 END AS within FROM s GROUP BY 1""")
def cluster_quality(spark, folder):
    return vectors.cluster_quality(table(spark, folder, "embeddings"), "label", "embedding")


@over("", None)
def kmeans_assign(spark, folder):
    return vectors.kmeans(table(spark, folder, "embeddings"), "vec_id", "embedding")


@over("", None)
def pca_scatter(spark, folder):
    return vectors.project(table(spark, folder, "embeddings"), "vec_id", "embedding")


@over("", None)
def ridge_cv(spark, folder):
    return vectors.ridge_scores(table(spark, folder, "embeddings").withColumn("y", F.col("label") * 10), "vec_id", "embedding", "y")


# scheduler, over rates by brand and size that stand for model and batch size

_BENCH = "SELECT p_brand AS model, 1 << CAST(least(5, p_size // 9) AS int) AS batch_size, avg(p_retailprice) AS images_per_s FROM part GROUP BY 1, 2"


def _bench(spark, folder):
    return grouped(table(spark, folder, "part"), {"model": "p_brand", "batch_size": "shiftleft(1, CAST(least(5, p_size div 9) AS int))"}, {"images_per_s": "avg(p_retailprice)"})


@over("", f"""WITH b AS ({_BENCH}), t AS (SELECT *, max(images_per_s) OVER (PARTITION BY model) AS top FROM b), m AS (SELECT model, min(CASE WHEN images_per_s >= 0.99 * top THEN batch_size END) AS best, max(top) AS top FROM t GROUP BY 1)
    SELECT model, CAST(best AS bigint) AS best_batch, CAST(greatest(1, best // 2) AS bigint) AS safe_batch, CAST(best AS bigint) AS max_batch, round(top, 3) AS top_rate FROM m""")
def profile_derivation(spark, folder):
    return scheduler.profile(_bench(spark, folder))


_STATE = f"WITH o AS (SELECT p_brand AS model, 1 << CAST(least(5, p_size // 9) AS int) AS arm, p_retailprice / 1000 AS reward FROM part), s AS (SELECT model, arm, count(*) AS n, sum(reward) AS total FROM o GROUP BY 1, 2), u AS (SELECT model, CAST(arm AS bigint) AS arm, round(total / n + sqrt(2 * ln(sum(n) OVER (PARTITION BY model) + 1) / n), 6) AS ucb FROM s)"


def _bounds(spark, folder):
    outcomes = table(spark, folder, "part").selectExpr("p_brand AS model", "shiftleft(1, CAST(least(5, p_size div 9) AS int)) AS arm", "p_retailprice / 1000 AS reward")
    return scheduler.upper_bounds(scheduler.bandit_state(outcomes))


@over("", _STATE + " SELECT * FROM u")
def ucb_scores(spark, folder):
    return _bounds(spark, folder)


@over("", _STATE + " SELECT model, arm FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ucb DESC, arm) AS i FROM u WHERE arm <= 16) WHERE i = 1")
def ucb_choice(spark, folder):
    return scheduler.choose(_bounds(spark, folder), 16)

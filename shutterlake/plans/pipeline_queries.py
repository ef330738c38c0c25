"""Queries of the pipeline around the records: store, scheduler, models, events, and what reports show."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import portable as p
from shutterlake.functions.digests import digest
from shutterlake.functions.media import farthest_first
from shutterlake.operators import records as rec
from shutterlake.operators import rules, scheduler, store, vectors
from shutterlake.operators.aggregates import closed, grouped, summary, top_per, unpivot
from shutterlake.operators.temporal import gap_sessions
from shutterlake.plans.library_queries import _FLAGS, over
from shutterlake.plans.table_queries import _DIGEST
from shutterlake.sources.registry import yaml_overrides
from shutterlake.sources.tables import table

# store


@over("", f"WITH p AS (SELECT {_DIGEST} AS h, source FROM photos), k AS (SELECT h FROM p WHERE source = 'local' AND h IS NOT NULL UNION SELECT {_DIGEST} FROM asset_feed WHERE {_DIGEST} IS NOT NULL) SELECT count(CASE WHEN h IN (SELECT h FROM k) THEN 1 END) AS kept, count(CASE WHEN h IS NULL OR h NOT IN (SELECT h FROM k) THEN 1 END) AS stale FROM p")
def prune_stale(spark, folder):
    """Dry run of pruning to what is in local files or in the deliveries."""
    photos = table(spark, folder, "photos").select(digest("hash").alias("hash"), "source")
    return store.stale(photos, photos.where("source = 'local'"), table(spark, folder, "asset_feed").select(digest("hash").alias("hash")))


@over("", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def point_lookup(spark, folder):
    return store.point(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 77)


@over("", "SELECT count(*) AS n, 0 AS scores, 0 AS vectors FROM photos")
def cleared_columns(spark, folder):
    cleared = store.clear(table(spark, folder, "photos").select("record_id", "aesthetic_score", "dinov3"), ["aesthetic_score", "dinov3", "unknown"])
    return cleared.agg(F.count("*").alias("n"), F.count("aesthetic_score").cast("int").alias("scores"), F.count("dinov3").cast("int").alias("vectors"))


@over("", "SELECT o_orderpriority AS pass_name, max(o_orderdate) AS run_at, arg_max(o_totalprice, (o_orderdate, -o_orderkey)) AS elapsed FROM orders GROUP BY 1")
def latest_passes(spark, folder):
    """The latest run of each pass from an append-only table of runs."""
    runs = table(spark, folder, "orders").selectExpr("o_orderpriority AS pass_name", "o_orderdate AS run_at", "o_orderkey", "o_totalprice AS elapsed")
    return store.merged_snapshots(runs, "pass_name", "run_at desc, o_orderkey").select("pass_name", "run_at", "elapsed")


@over("", "WITH o AS (SELECT p_brand AS model, CAST(p_size AS bigint) AS batch, max(p_retailprice) AS rate FROM part GROUP BY 1, 2), n AS (SELECT p_brand AS model, CAST(p_size AS bigint) AS batch, min(p_retailprice) AS rate FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2) SELECT * FROM n UNION ALL SELECT * FROM o WHERE (model, batch) NOT IN (SELECT (model, batch) FROM n)")
def merged_benchmarks(spark, folder):
    """Fresh results take the place of those of the same model and batch size; the others stay."""
    part = table(spark, folder, "part")
    old = grouped(part, {"model": "p_brand", "batch": "CAST(p_size AS bigint)"}, {"rate": "max(p_retailprice)"})
    new = grouped(part.where("p_size % 2 = 0"), {"model": "p_brand", "batch": "CAST(p_size AS bigint)"}, {"rate": "min(p_retailprice)"})
    both = new.withColumn("age", F.lit(0)).unionByName(old.withColumn("age", F.lit(1)))
    return both.groupBy("model", "batch").agg(F.min(F.struct("age", "rate")).alias("x")).select("model", "batch", "x.rate")


@over("", "SELECT count(*) AS photos, '1' AS schema_version FROM photos")
def report_json(spark, folder):
    """A report document with the label counts, and read again."""
    photos = table(spark, folder, "photos")
    labels = grouped(rec.exploded(rec.records(photos)), ["label"], {"n": "count(*)"})
    document = store.report_document(photos, {"labels": labels})
    return document.select(F.from_json("document", "schema_version string, photos bigint").alias("d")).select("d.photos", "d.schema_version")


@over("", "WITH a AS (SELECT lightroom_id, min(row_id) AS f, max(row_id) AS t FROM asset_feed GROUP BY 1), c AS (SELECT x.lightroom_id, x.lightroom_updated AS u, CASE WHEN x.row_id % 3 > 0 THEN 'x' END AS d FROM a JOIN asset_feed x ON x.row_id = a.f WHERE x.row_id % 5 > 0), n AS (SELECT x.lightroom_id, x.lightroom_updated AS u, x.row_id % 2 AS size FROM a JOIN asset_feed x ON x.row_id = a.t) SELECT CASE WHEN c.lightroom_id IS NULL THEN 'new' WHEN n.u IS DISTINCT FROM c.u THEN 'updated' WHEN d IS NULL AND size > 0 THEN 'develop' END AS change, count(*) AS n FROM n LEFT JOIN c USING (lightroom_id) GROUP BY 1 HAVING change IS NOT NULL")
def changes_by_kind(spark, folder):
    """New assets, updated ones, and those whose settings are missing while a link to them has some size."""
    feed = table(spark, folder, "asset_feed").select("lightroom_id", "lightroom_updated", "row_id")
    ends = feed.groupBy("lightroom_id").agg(F.min(F.struct("row_id", "lightroom_updated")).alias("f"), F.max(F.struct("row_id", "lightroom_updated")).alias("t"))
    fresh = ends.selectExpr("lightroom_id", "t.lightroom_updated", "t.row_id % 2 AS link_size")
    cached = ends.where("f.row_id % 5 > 0").selectExpr("lightroom_id", "f.lightroom_updated", "CASE WHEN f.row_id % 3 > 0 THEN 'x' END AS develop")
    return grouped(store.changed(fresh, cached, "lightroom_id", "lightroom_updated", "develop"), ["change"], {"n": "count(*)"})


@over("", "WITH x AS (SELECT DISTINCT source, unnest(lightroom_album_names) AS album, record_id FROM photos) SELECT album, count(DISTINCT record_id) AS n FROM x GROUP BY 1")
def album_tags(spark, folder):
    """Albums attached to records by their index, and counted again; only records with an id have any."""
    photos = table(spark, folder, "photos").select("record_id", "lightroom_album_names")
    listed = photos.selectExpr("explode(lightroom_album_names) AS album", "CAST(record_id AS string) AS id", "CAST(NULL AS string) AS nested_id")
    tagged = photos.selectExpr("CAST(record_id AS string) AS asset_id").join(store.album_index(listed), "asset_id", "left").selectExpr("asset_id", "coalesce(albums, array()) AS albums")
    return grouped(tagged.selectExpr("explode(albums) AS album"), ["album"], {"n": "count(*)"})


@over("", "SELECT record_id, path FROM photos WHERE list_contains(lightroom_album_names, (SELECT min(a) FROM (SELECT unnest(lightroom_album_names) AS a FROM photos)))")
def album_scope(spark, folder):
    """The records of one album."""
    photos = table(spark, folder, "photos").select("record_id", "path", "lightroom_album_names")
    first = photos.selectExpr("explode(lightroom_album_names) AS a").agg(F.min("a").alias("a"))
    return photos.crossJoin(F.broadcast(first)).where("array_contains(lightroom_album_names, a)").select("record_id", "path")


@over("", "WITH t AS (SELECT label AS x, vec_id AS id FROM embeddings), e AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.x = b.x AND a.id < b.id WHERE b.id - a.id < 40), g AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.x = b.x AND a.id < b.id WHERE b.id - a.id < 20) SELECT count(*) AS predicted, (SELECT count(*) FROM g) AS truth, (SELECT count(*) FROM e JOIN g USING (a, b)) AS hits, round((SELECT count(*) FROM e JOIN g USING (a, b)) / count(*), 4) AS precision, round((SELECT count(*) FROM e JOIN g USING (a, b)) / (SELECT count(*) FROM g), 4) AS recall FROM e")
def pair_quality(spark, folder):
    """Precision and recall of predicted pairs against true ones."""
    t = table(spark, folder, "embeddings").selectExpr("label AS x", "vec_id AS id")
    pairs = t.selectExpr("x", "id AS a").join(t.selectExpr("x", "id AS b"), "x").where("a < b AND b - a < 40").select("a", "b")
    truth = pairs.where("b - a < 20")
    hits = pairs.intersect(truth).agg(F.count("*").alias("hits"))
    one = pairs.agg(F.count("*").alias("predicted")).crossJoin(truth.agg(F.count("*").alias("truth"))).crossJoin(hits)
    return one.selectExpr("predicted", "truth", "hits", "round(hits / predicted, 4) AS precision", "round(hits / truth, 4) AS recall")


# rules

_YAML = "aesthetic: 3  # another key\ntilt_max: 2.5\nscore_floor: 20\nclutter_max: high\n"


@over("r", "SELECT CAST(20 AS double) AS score_floor, CAST(2.5 AS double) AS tilt_max, coalesce(round(quantile_cont(iq, 0.15), 1), 40) AS iq_floor FROM r")
def rule_overrides(rows):
    return rules.thresholds(rows, yaml_overrides(_YAML, set(rules.DEFAULTS))).select("score_floor", "tilt_max", "iq_floor")


@over("r", _FLAGS + ", c AS (SELECT rule, round(100.0 * count(*) / (SELECT count(*) FROM r), 1) AS pct FROM f GROUP BY 1) SELECT rule, pct, CASE WHEN pct >= 30 THEN 'high' WHEN pct >= 10 THEN 'medium' ELSE 'low' END AS level FROM c WHERE pct >= 5 ORDER BY pct DESC, rule LIMIT 4")
def top_flags(rows):
    """The four most frequent flags of at least five per cent."""
    flagged = rules.flags(rules.severities(rows, rules.thresholds(rows)), ["rid"])
    rolled = rules.rollup(flagged, rows.agg(F.count("*").alias("total"))).withColumn("pct", F.col("pct").cast("double")).where("pct >= 5")
    return top_per(rolled, [], "pct desc,rule", 4).selectExpr("rule", "pct", "CASE WHEN pct >= 30 THEN 'high' WHEN pct >= 10 THEN 'medium' ELSE 'low' END AS level")


@over("r", _FLAGS + ", x AS (SELECT rule, unnest(labels) AS label FROM f JOIN r USING (rid)), tot AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM r) GROUP BY 1) SELECT rule, label, count(*) AS n, round(100.0 * count(*) / max(tot.n), 1) AS pct FROM x JOIN tot USING (label) GROUP BY 1, 2")
def flag_rate_by_label(rows):
    labels = rec.exploded(rows)
    flagged = grouped(rules.flags(rules.severities(labels, rules.thresholds(rows)), ["label"]), ["rule", "label"], {"n": "count(*)"})
    totals = grouped(labels, ["label"], {"m": "count(*)"})
    return flagged.join(totals, "label").selectExpr("rule", "label", "n", "CAST(round(100.0 * n / m, 1) AS double) AS pct")


# shares that reports show


@over("r", ", c AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM r) GROUP BY 1) SELECT label, n, least(100.0, round(100.0 * n / (SELECT count(*) FROM r), 1)) AS pct, CASE WHEN n / (SELECT count(*) FROM r) >= 0.65 THEN 'dominant' WHEN n / (SELECT count(*) FROM r) >= 0.35 THEN 'moderate' ELSE 'slight' END AS tier FROM c")
def label_shares(rows):
    total = rows.agg(F.count("*").alias("total"))
    return grouped(rec.exploded(rows), ["label"], {"n": "count(*)"}).crossJoin(F.broadcast(total)).selectExpr("label", "n", "CAST(least(100.0, round(100.0 * n / total, 1)) AS double) AS pct", "CASE WHEN n / total >= 0.65 THEN 'dominant' WHEN n / total >= 0.35 THEN 'moderate' ELSE 'slight' END AS tier")


@over("r", ", g AS (SELECT avg(thirds) AS a, avg(symmetry) AS b, avg(space) AS c, avg(clutter) AS d, avg(isolation) AS e, 0.0 AS f, 0.0 AS g, avg(highlights) AS h, avg(shadows) AS i FROM r WHERE thirds IS NOT NULL) SELECT round(e, 4) AS centre, round((a + c + g + i) / 4, 4) AS corners, round((b + d + f + h) / 4, 4) AS edges, round(e / greatest(a, b, c, d, e, f, g, h, i), 4) AS centre_of_most FROM g")
def grid_shares(rows):
    """Centre, corners and edges of the mean grid, and the centre against its largest cell."""
    g = summary(rows.where("thirds IS NOT NULL"), {"a": "avg(thirds)", "b": "avg(symmetry)", "c": "avg(space)", "d": "avg(clutter)", "e": "avg(isolation)", "h": "avg(highlights)", "i": "avg(shadows)"})
    return g.selectExpr("round(e, 4) AS centre", "round((a + c + i) / 4, 4) AS corners", "round((b + d + h) / 4, 4) AS edges", "round(e / greatest(a, b, c, d, e, h, i), 4) AS centre_of_most")


@over("r", """, u AS (SELECT 'framing' AS field, framing AS value FROM r UNION ALL SELECT 'source', source FROM r UNION ALL SELECT 'light', light FROM r), c AS (SELECT field, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2) SELECT field, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY field), 1) AS pct, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c""")
def field_shares(rows):
    """Shares of framings, sources and light classes of their own totals, in order."""
    c = grouped(unpivot(rows, [], {"framing": "framing", "source": "source", "light": "light"}), ["field", "value"], {"n": "count(*)"})
    return c.selectExpr("field", "value", "n", "CAST(round(100.0 * n / sum(n) over (partition by field), 1) AS double) AS pct", "CAST(row_number() over (partition by field order by n desc, value) AS bigint) AS rank")


@over("r", ", m AS (SELECT avg(CASE WHEN len(albums) > 0 THEN score END) AS i, avg(CASE WHEN coalesce(len(albums), 0) = 0 THEN score END) AS o FROM r) SELECT round(i - o, 2) + 0.0 AS score_delta FROM m")
def album_delta(rows):
    return rows.agg(F.expr("avg(CASE WHEN size(albums) > 0 THEN score END)").alias("i"), F.expr("avg(CASE WHEN coalesce(size(albums), 0) = 0 THEN score END)").alias("o")).selectExpr("round(i - o, 2) + 0.0D AS score_delta")


@over("r", ", m AS (SELECT ym, count(*) AS n, count(CASE WHEN hour BETWEEN 5 AND 7 OR hour BETWEEN 17 AND 19 THEN 1 END) AS golden FROM r WHERE ym IS NOT NULL GROUP BY 1) SELECT ym, n - golden AS other_hours, round(100.0 * golden / n, 1) AS golden_pct FROM m")
def month_remainders(rows):
    m = grouped(rows, ["ym"], {"n": "count(*)", "golden": f"count_if({p.time_of_day('hour')} = 'golden_hour')"})
    return m.selectExpr("ym", "n - golden AS other_hours", "CAST(round(100.0 * golden / n, 1) AS double) AS golden_pct")


@over("", r"""WITH h AS (SELECT coalesce(CASE WHEN exif.hour BETWEEN 0 AND 23 THEN exif.hour END, try_cast(regexp_extract(lightroom_capture_date, 'T(\d{1,2}):', 1) AS int)) AS hour FROM asset_feed) SELECT b AS hour, count(h.hour) AS n FROM range(0, 24) t(b) LEFT JOIN h ON h.hour = b GROUP BY 1""")
def capture_hours(spark, folder):
    """Hours of capture from exif, else from the capture date's text."""
    feed = table(spark, folder, "asset_feed").selectExpr("CAST(coalesce(CASE WHEN exif.hour BETWEEN 0 AND 23 THEN exif.hour END, try_cast(regexp_extract(lightroom_capture_date, 'T(\\\\d{1,2}):', 1) AS int)) AS bigint) AS hour")
    return closed(grouped(feed, ["hour"], {"n": "count(*)"}), "hour", list(range(24)), ["n"])


# events of a user stand for photos of a shoot

_EVENTS = """WITH e AS (SELECT user_id, ts, value, event_type, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 14400000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e),
    g AS (SELECT user_id, session, count(*) AS n, min(ts) AS began, max(value) AS hero FROM s GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _shoots(spark, folder) -> tuple[DataFrame, DataFrame]:
    s = gap_sessions(table(spark, folder, "events"), "user_id", "ts", 4 * 3600)
    return s, grouped(s, ["user_id", "session"], {"n": "count(*)", "began": "min(ts)", "hero": "max(value)"}, "n >= 2")


@over("", _EVENTS + """, c AS (SELECT user_id, session, event_type, row_number() OVER (PARTITION BY user_id, session ORDER BY count(*) DESC, event_type) AS i FROM s GROUP BY 1, 2, 3)
    SELECT g.user_id, CAST(g.session AS bigint) AS session, string_agg(event_type, ', ' ORDER BY i) AS top_types FROM g JOIN c ON c.user_id = g.user_id AND c.session = g.session AND i <= 3 GROUP BY 1, 2""")
def session_top_types(spark, folder):
    s, g = _shoots(spark, folder)
    top = top_per(grouped(s, ["user_id", "session", "event_type"], {"k": "count(*)"}), ["user_id", "session"], "k desc, event_type", 3)
    named = top.groupBy("user_id", "session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x.event_type), ", ").alias("top_types"))
    return named.join(g.select("user_id", "session"), ["user_id", "session"])


@over("", _EVENTS + " SELECT user_id, CAST(session AS bigint) AS session, n, strftime(began, '%Y-%m-%d') AS day, round(coalesce(hero, 0), 2) AS hero FROM g WHERE n >= 3 AND began >= TIMESTAMP '2024-01-10' ORDER BY day DESC, user_id, session")
def shown_sessions(spark, folder, least: int = 3, since: str = "2024-01-10"):
    """The sessions a report shows: of some size and not too old; both are parameters."""
    _, g = _shoots(spark, folder)
    return g.where(f"n >= {least} AND began >= TIMESTAMP_NTZ '{since} 00:00:00'").selectExpr("user_id", "session", "n", "date_format(began, 'yyyy-MM-dd') AS day", "round(coalesce(hero, 0), 2) AS hero")


@over("", None)
def label_stories(spark, folder):
    """A sentence per label from its three least alike members: farthest-first over at most the hundred best scored of each."""
    rows = table(spark, folder, "photos").selectExpr("explode(scene.scene_types) AS label", "record_id", "dinov3", "aesthetic_score", "caption.setting AS setting", "caption.time_of_day AS tod").where("dinov3 IS NOT NULL AND aesthetic_score BETWEEN 0 AND 100")
    best = top_per(rows, ["label"], "aesthetic_score desc, record_id", 100)

    def story(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rank")
        m = [np.asarray(v, np.float64) for v in pdf["dinov3"]]
        good = [i for i, v in enumerate(m) if len(v) == 768 and np.isfinite(v).all()]
        chosen = [good[i] for i in farthest_first(np.stack([m[i] for i in good]), 3)] if len(good) >= 3 else list(range(min(3, len(m))))
        setting = next((s for s in pdf["setting"].iloc[chosen] if s), "mixed")
        tod = next((t for t in pdf["tod"].iloc[chosen] if t), None)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "story": [". ".join([f"A {setting} shoot"] + ([f"during {tod}"] if tod else [])) + "."]})

    return best.groupBy("label").applyInPandas(story, "label string, story string")


# scheduler

_PART = "SELECT p_brand AS model, CAST(1 << CAST(least(5, p_size // 9) AS int) AS bigint) AS arm, p_retailprice / 1000 AS rate, p_size AS s FROM part"


def _part(spark, folder):
    return table(spark, folder, "part").selectExpr("p_brand AS model", "CAST(shiftleft(1, CAST(least(5, p_size div 9) AS int)) AS bigint) AS arm", "p_retailprice / 1000 AS rate", "p_size AS s")


@over("", f"WITH b AS ({_PART}), m AS (SELECT model, max(arm) AS best, round(avg(rate), 6) AS rate, round(avg(s), 6) * 200 AS mb FROM b GROUP BY 1), r AS (SELECT *, rate - 0.3 * greatest(0, 1 - mb / 8000) AS reward, unnest([1, 2, 4, 8, 16, 32]) AS arm FROM m) SELECT model, CAST(arm AS bigint) AS arm, CAST(CASE WHEN arm = best THEN 5 ELSE 1 END AS bigint) AS n, round(CASE WHEN arm = best THEN reward * 5 ELSE reward * pow(arm / best, 0.7) END, 6) AS total FROM r WHERE arm <= best")
def bandit_preseed(spark, folder):
    profiles = grouped(_part(spark, folder), ["model"], {"best_batch": "max(arm)", "rate": "round(avg(rate), 6)", "memory_mb": "round(avg(s), 6) * 200"}).withColumn("p95", F.lit(50.0))
    return scheduler.preseeded(profiles).select("model", F.col("arm").cast("bigint").alias("arm"), "n", F.round("total", 6).alias("total"))


@over("", f"WITH b AS ({_PART}), o AS (SELECT model, arm, rate - 0.3 * greatest(0, 1 - s * 200 / 8000.0) - 0.2 * greatest(0, (s + 10) / 30.0 - 1) - 0.5 * CAST(s % 10 = 0 AS int) AS reward FROM b) SELECT model, arm, 2 * count(*) AS n, round(2 * sum(reward), 6) AS total FROM o GROUP BY 1, 2")
def bandit_update(spark, folder):
    """State after the same outcomes have come twice."""
    reward = scheduler.reward(F.col("rate"), F.col("s") * 200.0, F.col("s") + 10.0, F.lit(30.0), F.col("s") % 10 == 0)
    outcomes = _part(spark, folder).select("model", "arm", reward.alias("reward"))
    return scheduler.updated(scheduler.bandit_state(outcomes), outcomes).select("model", "arm", "n", F.round("total", 6).alias("total"))


@over("", """WITH t AS (SELECT event_type, user_id % 5 AS run, value + 1 AS v, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) AS i FROM events WHERE value >= 0), k AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY event_type, run) AS n FROM t WHERE i > 10),
    r AS (SELECT event_type, run, max(CASE WHEN pos = CAST(floor(0.5 * n) AS bigint) THEN v END) AS p50, max(CASE WHEN pos = CAST(floor(0.95 * n) AS bigint) THEN v END) AS p95 FROM k GROUP BY 1, 2) SELECT event_type, count(*) AS runs, round(quantile_cont(p50, 0.5), 2) AS p50, round(quantile_cont(p95, 0.5), 2) AS p95, round(stddev_samp(1000 / p50) / avg(1000 / p50) * 100, 1) AS cv_pct FROM r GROUP BY 1""")
def latency_statistics(spark, folder):
    timed = table(spark, folder, "events").where("value >= 0").selectExpr("event_type", "user_id % 5 AS run", "value + 1 AS v", "struct(ts, event_id) AS at_")
    return scheduler.latencies(timed, ["event_type"], "run", "at_", "v", 10)


@over("", f"WITH b AS (SELECT model, arm, avg(rate) AS r FROM ({_PART}) GROUP BY 1, 2) SELECT model, " + ", ".join(f"round(max(CASE WHEN arm = {a} THEN r END), 3) AS b{a}" for a in (1, 2, 4, 8, 16, 32)) + " FROM b GROUP BY 1")
def batch_curves(spark, folder):
    return scheduler.curves(grouped(_part(spark, folder), {"model": "model", "batch_size": "arm"}, {"images_per_s": "avg(rate)"}))


@over("", f"WITH b AS (SELECT model, arm, avg(rate) AS r FROM ({_PART}) GROUP BY 1, 2), e AS (SELECT model, arg_min(r, arm) AS lo, arg_max(r, arm) AS hi FROM b GROUP BY 1 HAVING count(*) >= 2) SELECT model, round((hi - lo) / lo * 100, 2) AS gain_pct, (hi - lo) / lo * 100 < 15 AS flat, hi < 4 AS bottleneck FROM e")
def batch_scaling(spark, folder):
    return scheduler.scaling(grouped(_part(spark, folder), {"model": "model", "batch_size": "arm"}, {"images_per_s": "avg(rate)"}))


@over("", f"WITH b AS ({_PART}), a AS (SELECT model, arm, count(*) AS n, sum(rate) AS t FROM b GROUP BY 1, 2) SELECT model, CAST(sum(n) AS bigint) AS pulls, arg_max(arm, (t / n, -arm)) AS dominant, arg_max(arm, (n, -arm)) AS most_pulled FROM a GROUP BY 1")
def bandit_summary(spark, folder):
    a = grouped(_part(spark, folder), ["model", "arm"], {"n": "count(*)", "t": "sum(rate)"})
    best = lambda by: F.min(F.struct((-F.expr(by)).alias("v"), "arm"))["arm"]
    return a.groupBy("model").agg(F.sum("n").alias("pulls"), best("t / n").alias("dominant"), best("n").alias("most_pulled"))


@over("", "WITH q AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'Pass 1' ELSE o_orderpriority END AS name, count(*) AS photos, sum(o_totalprice) / 1e6 AS s, max(o_totalprice) / 100 AS mb FROM orders GROUP BY 1), o AS (SELECT max(CASE WHEN name <> 'Pass 1' THEN photos END) AS heavy, sum(mb) AS mb, max(mb) AS peak, sum(s) AS s FROM q) SELECT CASE WHEN heavy / 4000 >= 0.8 THEN 'full' ELSE 'incremental' END AS run_type, 62.5 AS hit_rate_pct, round(mb + 3174, 1) AS naive_mb, round(peak, 1) AS peak_mb, round(100 * (1 - peak / (mb + 3174)), 1) AS saved_pct, round(s, 1) AS elapsed_s FROM o")
def run_profile(spark, folder):
    passes = grouped(table(spark, folder, "orders"), {"pass_name": "CASE WHEN o_orderpriority LIKE '1%' THEN 'Pass 1' ELSE o_orderpriority END"}, {"photos": "count(*)", "elapsed_s": "sum(o_totalprice) / 1e6D", "memory_mb": "max(o_totalprice) / 100"})
    return scheduler.run_summary(passes, 4000, 2500)


# models

_E = "SELECT vec_id % 7 AS c, label AS l, embedding::DOUBLE[] AS v FROM embeddings"


@over("", f"""WITH e AS ({_E}), k AS (SELECT c, l, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT n / CAST(sum(n) OVER () AS double) AS p, sum(n) OVER (PARTITION BY c) / CAST(sum(n) OVER () AS double) AS pc, sum(n) OVER (PARTITION BY l) / CAST(sum(n) OVER () AS double) AS pl FROM k), i AS (SELECT sum(p * ln(p / (pc * pl))) AS mi, -sum(p * ln(pc)) AS hc, -sum(p * ln(pl)) AS hl FROM p),
    u AS (SELECT c, unnest(v) / (sqrt(list_dot_product(v, v)) + 1e-9) AS x, generate_subscripts(v, 1) AS d FROM e), s AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM u GROUP BY 1, 2), q AS (SELECT c, max(n) AS n, sum(s * s) AS q FROM s GROUP BY 1), w AS (SELECT avg((q - n) / (n * (n - 1))) AS w, count(*) AS k FROM q), b AS (SELECT sum(t * t) AS t FROM (SELECT d, sum(s / sqrt(q)) AS t FROM s JOIN q USING (c) GROUP BY 1))
    SELECT (SELECT count(*) FROM e) AS n, round(2 * mi / (hc + hl), 4) AS nmi, round(w, 4) AS within, round((t - k) / (k * (k - 1)), 4) AS between, round(w / ((t - k) / (k * (k - 1)) + 1e-9), 2) AS separation FROM i, w, b""")
def cluster_evaluation(spark, folder):
    """Clusters by key modulo seven, which agree with labels only by chance."""
    rows = table(spark, folder, "embeddings").selectExpr("vec_id % 7 AS c", "label", "embedding")
    return vectors.cluster_evaluation(rows, "c", "label", "embedding")


@over("", "WITH k AS (SELECT vec_id % 7 AS cluster, label, count(*) AS k FROM embeddings GROUP BY 1, 2) SELECT cluster, CAST(sum(k) AS bigint) AS n, arg_max(label, (k, -label)) AS top_label, round(max(k) / CAST(sum(k) AS double), 3) AS purity FROM k GROUP BY 1")
def cluster_purity(spark, folder):
    return vectors.purity(table(spark, folder, "embeddings").selectExpr("vec_id % 7 AS c", "label"), "c", "label")


@over("", None)
def vector_fingerprint(spark, folder):
    return vectors.fingerprint(table(spark, folder, "embeddings"), "vec_id", "embedding")


@over("", None)
def student_scores(spark, folder):
    """A student trained on the label scores of even keys scores the odd ones."""
    rows = table(spark, folder, "embeddings").selectExpr("vec_id", "embedding", "label * 10.0D AS y")
    return vectors.predict(rows.where("vec_id % 2 = 1"), vectors.train(rows.where("vec_id % 2 = 0"), "vec_id", "embedding", "y"), "vec_id", "embedding")


@over("", None)
def photo_ridge(spark, folder):
    """Out-of-fold quality of scores from the photos' vectors, by penalty."""
    usable = "size(dinov3) = 768 and not exists(dinov3, x -> x is null or isnan(x) or abs(x) = float('infinity')) and aesthetic_score between 0 and 100"
    return vectors.ridge_scores(table(spark, folder, "photos").where(usable), "record_id", "dinov3", "aesthetic_score")

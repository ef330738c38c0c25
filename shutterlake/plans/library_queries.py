"""Queries of the library analysis over photos, each with SQL for another engine to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import portable as p
from shutterlake.operators import records as rec
from shutterlake.operators import rules
from shutterlake.operators.aggregates import closed, crosstab, grouped, histogram, share, summary, top_per, unpivot
from shutterlake.operators.temporal import change_from_baseline, deltas, zscores
from shutterlake.sources.tables import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: The flat records, and a row per record and label.
R = f"WITH r AS ({rec.SQL})"
L = R + ", d AS (SELECT *, unnest(labels) AS label FROM r)"


def _counted(sql: str) -> str:
    """``count_if`` spelled so that its type is the same in every engine."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def over(kind: str, sql: str | None, name: str | None = None):
    """Register a query over the records ('r'), their labels ('d') or the folder's tables (''), with its SQL after the common views."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            if kind == "":
                out = f(spark, folder)
            else:
                rows = rec.records(table(spark, folder, "photos"))
                out = f(rec.exploded(rows) if kind == "d" else rows)
            # quotients of decimal literals come out as doubles, as in other engines
            return out.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in out.dtypes])

        key = name or f.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = _counted((L if kind == "d" else R if kind == "r" else "") + " " + sql)
        return f

    return register


def simple(name: str, kind: str, keys: dict[str, str], metrics: dict[str, str], having: str | None = None, where: str | None = None, sql: str | None = None) -> None:
    """A query that is one pass of aggregates; without ``sql`` of its own the same metrics make the SQL."""

    def f(rows: DataFrame) -> DataFrame:
        rows = rows.where(where) if where else rows
        return grouped(rows, keys, metrics, having) if keys else summary(rows, metrics)

    if sql:
        over(kind, sql, name)(f)
        return
    cols = ", ".join([f"{e} AS {k}" for k, e in keys.items()] + [f"{e.replace('percentile(', 'quantile_cont(')} AS {k}" for k, e in metrics.items()])
    sql = f"SELECT {cols} FROM {kind}" + (f" WHERE {where}" if where else "")
    if keys:
        sql += " GROUP BY " + ", ".join(str(i + 1) for i in range(len(keys)))
        sql = f"SELECT * FROM ({sql}) WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in keys) + (f" AND ({having})" if having else "")
    over(kind, sql, name)(f)


def mean(*names: str, digits: int = 4) -> dict[str, str]:
    # half-way cases of short decimals fall on the same side in every engine
    return {f"avg_{n}": f"round(avg({n}) + 1e-9, {digits})" for n in names}


N = {"n": "count(*)"}
simple("color_stats", "r", {}, N | mean("sat", "bright", "contrast", "warm", "cool") | {"std_sat": "round(stddev_pop(sat), 4)", "std_contrast": "round(stddev_pop(contrast), 4)"})
simple("composition_stats", "r", {}, mean("thirds", "symmetry", "space", "isolation", "clutter") | {"level_n": "count_if(abs(tilt) <= 1)", "tilted_n": "count_if(abs(tilt) > 1)", "no_horizon_n": "count_if(tilt IS NULL)"})
simple("exposure_stats", "r", {}, mean("highlights", "shadows") | {"blown_pct": "round(100.0 * count_if(highlights > 0.02) / nullif(count(highlights), 0), 2)", "blocked_pct": "round(100.0 * count_if(shadows > 0.02) / nullif(count(shadows), 0), 2)"})
simple("score_summary", "r", {}, {"n": "count(score)", "mean": "round(avg(score), 3)", "lo": "min(score)", "hi": "max(score)", "std": "round(stddev_pop(score), 3)", "med": "round(percentile(score, 0.5), 3)", "low_n": "count_if(score < 33)", "mid_n": "count_if(score BETWEEN 33 AND 66)", "high_n": "count_if(score > 66)"})
#: Mean of the coefficients of variation that there are.
CVS = {c: f"round(stddev_pop({c}) / nullif(avg({c}), 0), 4)" for c in ("sat", "bright", "contrast")}


@over("r", ", c AS (SELECT round(stddev_pop(sat) / nullif(avg(sat), 0), 4) AS s, round(stddev_pop(bright) / nullif(avg(bright), 0), 4) AS b, round(stddev_pop(contrast) / nullif(avg(contrast), 0), 4) AS k FROM r), m AS (SELECT *, list_avg([x for x in [s, b, k] if x IS NOT NULL]) AS m FROM c) SELECT s AS cv_sat, b AS cv_bright, k AS cv_contrast, CASE WHEN m IS NULL THEN 'unknown' WHEN m < 0.1 THEN 'highly consistent' WHEN m < 0.25 THEN 'moderate variation' ELSE 'eclectic' END AS style FROM m")
def consistency(rows):
    cvs = summary(rows, {f"cv_{c}": e for c, e in CVS.items()})
    mean_of = "aggregate(array_compact(array(cv_sat, cv_bright, cv_contrast)), 0D, (a, x) -> a + x) / nullif(size(array_compact(array(cv_sat, cv_bright, cv_contrast))), 0)"
    return cvs.selectExpr("*", f"{mean_of} AS m").selectExpr("cv_sat", "cv_bright", "cv_contrast", "CASE WHEN m IS NULL THEN 'unknown' WHEN m < 0.1 THEN 'highly consistent' WHEN m < 0.25 THEN 'moderate variation' ELSE 'eclectic' END AS style")


TONE = p.case(("coalesce(avg(bright), 0) >= 0.60", "'high_key'"), ("coalesce(avg(bright), 0) <= 0.38", "'low_key'"), ("coalesce(avg(contrast), 0) >= 0.38", "'moody'"), ("coalesce(avg(contrast), 0) <= 0.22", "'flat_matte'"), other="'balanced'")
simple("tone_class", "r", {}, mean("bright", "contrast", "warm", "cool") | {"tone": TONE, "temperature": p.case(("avg(warm) > 0.52", "'warm'"), ("avg(cool) > 0.42", "'cool'"), other="'neutral'")}, sql="""SELECT round(avg(bright) + 1e-9, 4) AS avg_bright, round(avg(contrast) + 1e-9, 4) AS avg_contrast, round(avg(warm) + 1e-9, 4) AS avg_warm, round(avg(cool) + 1e-9, 4) AS avg_cool,
    CASE WHEN coalesce(avg(bright), 0) >= 0.60 THEN 'high_key' WHEN coalesce(avg(bright), 0) <= 0.38 THEN 'low_key' WHEN coalesce(avg(contrast), 0) >= 0.38 THEN 'moody' WHEN coalesce(avg(contrast), 0) <= 0.22 THEN 'flat_matte' ELSE 'balanced' END AS tone,
    CASE WHEN avg(warm) > 0.52 THEN 'warm' WHEN avg(cool) > 0.42 THEN 'cool' ELSE 'neutral' END AS temperature FROM r""")
simple("saliency_stats", "r", {}, {"n": "count(area)"} | mean("area", "cx", "cy", "off"))
simple("capabilities", "r", {}, {"has_local": "bool_or(source <> 'lightroom')", "has_remote": "bool_or(source <> 'local')", "has_scores": "bool_or(score IS NOT NULL)", "has_albums": "bool_or(albums IS NOT NULL)"})
simple("score_iq_corr", "r", {}, {"pairs": "count(CASE WHEN score IS NOT NULL AND iq IS NOT NULL THEN 1 END)", "r": "CASE WHEN count(CASE WHEN score IS NOT NULL AND iq IS NOT NULL THEN 1 END) >= 10 THEN round(corr(score, iq), 3) + 0.0 END"})
simple("label_distribution", "d", {"label": "label"}, N)
simple("score_by_label", "d", {"label": "label"}, {"mean": "round(avg(score), 4)", "std": "round(stddev_pop(score), 4)", "n": "count(score)"})
simple("metrics_by_label", "d", {"label": "label"}, {"n": "count(*)"} | mean("thirds", "symmetry", "space", "isolation", "sat", "bright", "warm", "iq", "area") | {"n_composed": "greatest(count(thirds), count(symmetry), count(space))", "std_sat": "round(stddev_pop(sat), 4)", "n_saliency": "count(cx)"})
simple("iq_by_focal", "r", {"focal_cat": "focal_cat"}, {"n": "count(iq)", "mean": "round(avg(iq), 3)"}, having="n >= 5")
_PHONE = "apple samsung google pixel iphone huawei xiaomi oneplus oppo vivo realme".split()
_MIRRORLESS = "ilce α a7 a6 zfc z50 z6 z7 z8 z9 xt x-t x-s gfx om-1 om-5 e-m sl2 sl3 rp r5 r6 r7 r8 r10 r50 r100 r3 r1 s5 s9 gh6 gh7 g9".split()
_DSLR = ["nikon d", "nikon z", *"eos d3 d4 d5 d6 d7 d8 d500 d750 d800 d810 d850 7d 5d 6d rebel k- pentax".split()]
_ANY = lambda words: f"len(list_filter({words}, lambda w: contains(lower(coalesce(make, '') || ' ' || coalesce(model, '')), w))) > 0"
simple("device_rollup", "r", {"device": p.device_class("make", "model")}, N | mean("score", digits=2) | mean("iq", digits=3), sql=f"""SELECT CASE WHEN coalesce(make, '') = '' AND coalesce(model, '') = '' THEN 'unknown' WHEN {_ANY(_PHONE)} THEN 'phone' WHEN {_ANY(_MIRRORLESS)} THEN 'mirrorless' WHEN {_ANY(_DSLR)} THEN 'dslr'
    WHEN coalesce(make, '') <> '' THEN 'other' ELSE 'unknown' END AS device, count(*) AS n, round(avg(score) + 1e-9, 2) AS avg_score, round(avg(iq) + 1e-9, 3) AS avg_iq FROM r GROUP BY 1""")
simple("rating_summary", "r", {"rating": "CAST(rating AS bigint)"}, {"n": "count(*)"} | mean("score", "iq", "isolation"))
simple("pose_framing", "r", {"framing": "framing"}, {"n": "count(*)"} | mean("score", "area"))
simple("area_framing", "r", {"tier": p.framing_tier("area")}, {"n": "count(*)"} | mean("score"))
simple("people_counts", "r", {"people": p.case(("persons IS NULL", "NULL"), ("persons >= 4", "'4+'"), other="CAST(persons AS varchar(10))")}, N)
simple("focal_iso_trend", "r", {"ym": "ym"}, {"focal": "round(percentile(focal, 0.5), 1)", "iso": "round(percentile(iso, 0.5), 0)", "aperture": "round(percentile(aperture, 0.5), 4)", "n": "count(*)"})
simple("monthly_total_golden", "r", {"ym": "ym"}, {"total": "count(*)", "golden": f"count_if({p.time_of_day('hour')} = 'golden_hour')"})
simple("monthly_trends", "r", {"ym": "ym"}, mean("score", "sat", "bright", "contrast", "warm") | {"n": "greatest(count(score), count(sat))"})
simple("hour_categories", "r", {"tod": p.time_of_day("hour")}, N | mean("score"))
simple("season_profile", "r", {"season": p.season("CAST(substr(ym, 6, 2) AS int)")}, N | mean("score", "warm"))
simple("sources_by_year", "r", {"year": "substr(ym, 1, 4)", "source": "source"}, N | mean("score"))
simple("category_rules", "r", {"focal_rule": p.focal_category("focal"), "dof_rule": p.depth_category("aperture"), "light_rule": p.light_category("iso")}, {"n": "count(*)", "agree": "count_if(focal_cat = " + p.focal_category("focal") + ")"})
simple("prime_share", "r", {}, {"n": "count(lens)", "prime_pct": f"round(100.0 * count_if(lens IS NOT NULL AND NOT {p.is_zoom('lens')}) / nullif(count(lens), 0), 1)"})
simple("edit_coverage", "r", {}, {"n": "count(*)", "need_embedding": "count_if(lr IS NOT NULL AND score IS NULL)", "gated_pose": "count_if(person LIKE 'yes%')", "gated_subject": "count_if(person = 'yes' OR persons >= 1)"})
simple("context_profile", "d", {"tod": p.time_of_day("hour"), "label": "label"}, {"focal": "round(percentile(focal, 0.5), 1)", "aperture": "round(percentile(aperture, 0.5), 2)", "iso": "round(percentile(iso, 0.5), 0)", "mean": "round(avg(score), 3)", "n": "greatest(count(focal), count(score), 1)"})


@over("r", "SELECT b AS bucket, count(score) AS n FROM range(0, 10) t(b) LEFT JOIN (SELECT * FROM r WHERE score IS NOT NULL) r ON CAST(least(9, floor(score / 10)) AS bigint) = b GROUP BY b")
def score_histogram10(rows):
    return histogram(rows, "score", 10, 10)


@over("r", "SELECT b AS bucket, count(sat) AS n FROM range(0, 5) t(b) LEFT JOIN (SELECT * FROM r WHERE sat IS NOT NULL) r ON CAST(least(4, floor(sat / 0.2)) AS bigint) = b GROUP BY b")
def saturation_histogram(rows):
    return histogram(rows, "sat", 0.2, 5)


@over("r", "SELECT b AS hour, count(r.hour) AS n FROM range(0, 24) t(b) LEFT JOIN r ON r.hour = b GROUP BY b")
def hours_zero_filled(rows):
    return closed(grouped(rows, {"hour": "CAST(hour AS bigint)"}, N), "hour", list(range(24)), ["n"])


@over("r", "SELECT b AS rating, count(r.rating) AS n FROM range(0, 6) t(b) LEFT JOIN r ON r.rating = b GROUP BY b")
def rating_distribution(rows):
    return closed(grouped(rows, {"rating": "CAST(rating AS bigint)"}, N), "rating", list(range(6)), ["n"])


@over("r", "SELECT d.dof, count(r.dof) AS n FROM (VALUES ('shallow'), ('mid'), ('deep')) d(dof) LEFT JOIN r ON r.dof = d.dof GROUP BY 1")
def closed_distribution(rows):
    return closed(grouped(rows, ["dof"], N), "dof", ["shallow", "mid", "deep"], ["n"])


@over("d", ", c AS (SELECT label, count(*) AS n FROM d GROUP BY 1) SELECT label, n FROM c WHERE n >= 0.9 * (SELECT max(n) FROM c) ORDER BY n DESC, label LIMIT 3")
def dominant_labels(rows):
    counts = grouped(rows, ["label"], N).withColumn("top", F.expr("max(n) over ()"))
    return top_per(counts.where("n >= 0.9 * top").drop("top"), [], "n desc,label", 3)


@over("r", "SELECT folder, count(score) AS n, round(avg(score), 4) AS avg_score, round(avg(sat) + 1e-9, 4) AS avg_sat FROM (SELECT *, CASE WHEN len(string_split(path, '/')) >= 2 THEN string_split(path, '/')[-2] ELSE 'root' END AS folder FROM r) GROUP BY 1 HAVING count(score) + count(sat) > 0")
def folder_rollup(rows):
    from shutterlake.operators.store import folder

    named = rows.withColumn("folder", folder("path"))
    return grouped(named, ["folder"], {"n": "count(score)", "avg_score": "round(avg(score), 4)", "avg_sat": "round(avg(sat) + 1e-9, 4)", "both": "count(score) + count(sat)"}, "both > 0").drop("both")


_CV = lambda c: f"coalesce(round(stddev_pop({c}) / nullif(avg({c}), 0), 4), 0)"
_SPREAD = f"greatest({_CV('sat')}, {_CV('contrast')}, {_CV('bright')})"
_AVG = lambda c: f"coalesce(round(avg({c}), 4), 0)"
#: Where each pattern's confidence begins and is full.
PATTERNS = {
    "warm_toned": p.ramp(_AVG("warm"), 0.45, 0.70), "cool_toned": p.ramp(_AVG("cool"), 0.38, 0.60), "vivid": p.ramp(_AVG("sat"), 0.35, 0.65), "muted": p.ramp(f"(0.30 - {_AVG('sat')})", 0.05, 0.25),
    "high_contrast": p.ramp(_AVG("contrast"), 0.38, 0.60), "flat_matte": p.ramp(f"(0.22 - {_AVG('contrast')})", 0.02, 0.18), "high_key": p.ramp(_AVG("bright"), 0.58, 0.80),
    "low_key": p.ramp(f"(0.42 - {_AVG('bright')})", 0.02, 0.32), "consistent": p.ramp(f"(0.25 - {_SPREAD})", 0.0, 0.20), "varied": p.ramp(_SPREAD, 0.25, 0.60),
}
_PATTERN_SQL = """, m AS (SELECT coalesce(round(avg(warm), 4), 0) AS w, coalesce(round(avg(cool), 4), 0) AS c, coalesce(round(avg(sat), 4), 0) AS s, coalesce(round(avg(contrast), 4), 0) AS k, coalesce(round(avg(bright), 4), 0) AS b,
    greatest(coalesce(round(stddev_pop(sat) / nullif(avg(sat), 0), 4), 0), coalesce(round(stddev_pop(contrast) / nullif(avg(contrast), 0), 4), 0), coalesce(round(stddev_pop(bright) / nullif(avg(bright), 0), 4), 0)) AS v FROM {rows}),
    p AS (SELECT unnest([{{'pattern': 'warm_toned', 'x': w, 'lo': 0.45, 'hi': 0.70}}, {{'pattern': 'cool_toned', 'x': c, 'lo': 0.38, 'hi': 0.60}}, {{'pattern': 'vivid', 'x': s, 'lo': 0.35, 'hi': 0.65}}, {{'pattern': 'muted', 'x': 0.30 - s, 'lo': 0.05, 'hi': 0.25}},
    {{'pattern': 'high_contrast', 'x': k, 'lo': 0.38, 'hi': 0.60}}, {{'pattern': 'flat_matte', 'x': 0.22 - k, 'lo': 0.02, 'hi': 0.18}}, {{'pattern': 'high_key', 'x': b, 'lo': 0.58, 'hi': 0.80}}, {{'pattern': 'low_key', 'x': 0.42 - b, 'lo': 0.02, 'hi': 0.32}},
    {{'pattern': 'consistent', 'x': 0.25 - v, 'lo': 0.0, 'hi': 0.20}}, {{'pattern': 'varied', 'x': v, 'lo': 0.25, 'hi': 0.60}}], recursive := true) FROM m)
    SELECT pattern, CAST(CASE WHEN x <= lo THEN 0 ELSE round(least(1.0, (x - lo) / (hi - lo)) + 1e-9, 2) END AS double) AS confidence FROM p WHERE CASE WHEN x <= lo THEN 0 ELSE round(least(1.0, (x - lo) / (hi - lo)) + 1e-9, 2) END >= 0.18"""


def _patterns(rows):
    return unpivot(summary(rows, {n: f"CAST({e} AS double)" for n, e in PATTERNS.items()}), [], {n: n for n in PATTERNS}, "pattern", "confidence").where("confidence >= 0.18")


@over("r", _PATTERN_SQL.format(rows="r"))
def style_patterns(rows):
    return _patterns(rows)


@over("r", ", q AS (SELECT *, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM r WHERE score IS NOT NULL), t AS (SELECT * FROM q WHERE n >= 10 AND score >= (SELECT score FROM q WHERE i = CAST(floor(0.9 * n) AS bigint) + 1))" + _PATTERN_SQL.format(rows="t"))
def top_decile_patterns(rows):
    return _patterns(_top_decile(rows).where("n >= 10"))


@over("r", ", t AS (SELECT * FROM r WHERE len(albums) > 0 AND (SELECT count(*) FROM r WHERE len(albums) > 0) >= 5)" + _PATTERN_SQL.format(rows="t"))
def album_patterns(rows):
    inside = rows.where("size(albums) > 0")
    enough = inside.agg(F.count("*").alias("inside"))
    return _patterns(inside.crossJoin(F.broadcast(enough)).where("inside >= 5"))


#: When a record counts for a composition pattern.
SHOTS = {"rule_of_thirds": "thirds > 0.74", "centered": "thirds < 0.60", "symmetric": "symmetry > 0.87", "minimal": "space > 0.90", "frame_filling": "space < 0.18", "isolated_subject": "isolation > 1.5", "busy_foreground": "clutter > 0.22"}
_COMPOSED = "coalesce(thirds, symmetry, space, isolation, clutter, tilt, highlights, shadows) IS NOT NULL"


@over("r", f""", c AS (SELECT * FROM r WHERE {_COMPOSED}), u AS (SELECT 'rule_of_thirds' AS pattern, count(*) FILTER (WHERE thirds > 0.74) AS n FROM c UNION ALL SELECT 'centered', count(*) FILTER (WHERE thirds < 0.6) FROM c UNION ALL SELECT 'symmetric', count(*) FILTER (WHERE symmetry > 0.87) FROM c
    UNION ALL SELECT 'minimal', count(*) FILTER (WHERE space > 0.9) FROM c UNION ALL SELECT 'frame_filling', count(*) FILTER (WHERE space < 0.18) FROM c UNION ALL SELECT 'isolated_subject', count(*) FILTER (WHERE isolation > 1.5) FROM c UNION ALL SELECT 'busy_foreground', count(*) FILTER (WHERE clutter > 0.22) FROM c)
    SELECT pattern, n, round(100.0 * n / (SELECT count(*) FROM c), 1) AS pct FROM u WHERE round(100.0 * n / (SELECT count(*) FROM c), 1) >= 5""")
def threshold_patterns(rows):
    counted = summary(rows.where(_COMPOSED), {"total": "count(*)"} | {n: f"count_if({c})" for n, c in SHOTS.items()})
    return unpivot(counted, ["total"], {n: n for n in SHOTS}, "pattern", "n").selectExpr("pattern", "n", "CAST(round(100.0 * n / total, 1) AS double) AS pct").where("pct >= 5")


@over("r", ", g AS (SELECT CAST(least(2, floor(cy * 3)) AS bigint) * 3 + CAST(least(2, floor(cx * 3)) AS bigint) AS cell FROM r WHERE cx IS NOT NULL AND cy IS NOT NULL) SELECT b AS cell, count(g.cell) AS n, round(count(g.cell) / CAST(sum(count(g.cell)) OVER () AS double), 4) AS part FROM range(0, 9) t(b) LEFT JOIN g ON g.cell = b GROUP BY b")
def placement_grid(rows):
    cells = grouped(rows.where("cx IS NOT NULL AND cy IS NOT NULL"), {"cell": "CAST(least(2, floor(cy * 3)) AS bigint) * 3 + CAST(least(2, floor(cx * 3)) AS bigint)"}, N)
    return closed(cells, "cell", list(range(9)), ["n"]).selectExpr("cell", "n", "round(n / CAST(sum(n) over () AS double), 4) AS part")


VQA = {"person": "person", "setting": "setting", "tod": "tod"}
_UNPIVOTED = ", u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS field, {e} AS value, score FROM r WHERE {e} IS NOT NULL" for n, e in VQA.items()) + ")"


@over("r", _UNPIVOTED + ", c AS (SELECT field, value, count(*) AS n FROM u GROUP BY 1, 2) SELECT * FROM (SELECT field, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY field), 1) AS pct, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 6")
def attribute_top6(rows):
    counts = grouped(unpivot(rows, [], VQA), ["field", "value"], N)
    shares = share(counts, "n", by=["field"]).withColumn("pct", F.col("pct").cast("double"))
    return top_per(shares, ["field"], "n desc, value", 6)


@over("r", _UNPIVOTED + " SELECT field, value, count(*) AS n, round(avg(score), 4) AS mean FROM u WHERE score <> 0 GROUP BY 1, 2 HAVING count(*) >= 3")
def score_by_attribute(rows):
    return grouped(unpivot(rows.where("score <> 0"), ["score"], VQA), ["field", "value"], {"n": "count(*)", "mean": "round(avg(score), 4)"}, "n >= 3")


@over("r", "SELECT lens, count(*) AS n FROM r WHERE lens IS NOT NULL GROUP BY 1 ORDER BY n DESC, lens LIMIT 10")
def top_lenses(rows):
    return top_per(grouped(rows, ["lens"], N), [], "n desc,lens", 10)


@over("d", "SELECT label, count_if(light = 'bright') AS bright, count_if(light = 'indoor') AS indoor, count_if(light = 'low_light') AS low_light FROM d WHERE label IS NOT NULL GROUP BY 1", "light_by_label")
def light_by_label(rows):
    return crosstab(rows.drop("bright"), "label", "light", ["bright", "indoor", "low_light"])


@over("d", ", g AS (SELECT label, concat(focal_cat, '/', dof) AS combo, count(score) AS n, round(avg(score), 4) AS mean FROM d WHERE focal_cat IS NOT NULL AND dof IS NOT NULL GROUP BY 1, 2 HAVING count(score) >= 3) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, combo) AS rank FROM g) WHERE rank <= 3")
def sweet_spots(rows):
    g = grouped(rows.where("focal_cat IS NOT NULL AND dof IS NOT NULL"), {"label": "label", "combo": "concat(focal_cat, '/', dof)"}, {"n": "count(score)", "mean": "round(avg(score), 4)"}, "n >= 3")
    return top_per(g, ["label"], "mean desc, combo", 3)


FENCES = {"low": "quantile_cont(iq, 0.25) - 3 * (quantile_cont(iq, 0.75) - quantile_cont(iq, 0.25))", "high": "quantile_cont(iq, 0.75) + 3 * (quantile_cont(iq, 0.75) - quantile_cont(iq, 0.25))"}


@over("r", f", f AS (SELECT {FENCES['low']} AS lo, {FENCES['high']} AS hi FROM r) SELECT round(lo, 4) AS low_fence, round(hi, 4) AS high_fence, count_if(iq < lo) AS low_n, count_if(iq > hi) AS high_n FROM r, f GROUP BY lo, hi")
def iqr_outliers(rows):
    fences = summary(rows, {k: v.replace("quantile_cont", "percentile") for k, v in {"lo": FENCES["low"], "hi": FENCES["high"]}.items()})
    return rows.crossJoin(F.broadcast(fences)).groupBy("lo", "hi").agg(F.expr("count_if(iq < lo)").alias("low_n"), F.expr("count_if(iq > hi)").alias("high_n")).selectExpr("round(lo, 4) AS low_fence", "round(hi, 4) AS high_fence", "low_n", "high_n")


_MONTHS = ", m AS (SELECT ym, round(avg(score), 4) AS score, round(avg(iq), 4) AS iq FROM r WHERE ym IS NOT NULL GROUP BY 1)"


def _months(rows):
    return grouped(rows, ["ym"], {"score": "round(avg(score), 4)", "iq": "round(avg(iq), 4)"})


@over("r", _MONTHS + " SELECT *, round(score - lag(score) OVER (ORDER BY ym), 4) + 0.0 AS score_delta, round(iq - lag(iq) OVER (ORDER BY ym), 4) + 0.0 AS iq_delta FROM m")
def month_deltas(rows):
    return deltas(_months(rows), "ym", ["score", "iq"])


@over("r", _MONTHS + ", b AS (SELECT nullif(score, 0) AS base FROM m WHERE nullif(score, 0) IS NOT NULL ORDER BY ym LIMIT 1) SELECT ym, score, round(100.0 * (nullif(score, 0) - base) / base, 2) + 0.0 AS change_pct FROM m, b")
def change_from_first(rows):
    return change_from_baseline(_months(rows), "ym", "score")


@over("r", _MONTHS + " SELECT ym, CASE WHEN score IS NULL OR count(score) OVER () < 2 THEN NULL WHEN stddev_pop(score) OVER () < 0.01 THEN 0.0 ELSE round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 2) + 0.0 END AS z FROM m")
def month_zscores(rows):
    return zscores(_months(rows), "ym", "score")


@over("r", "SELECT b AS dow, count(r.seen) AS n FROM range(0, 7) t(b) LEFT JOIN r ON isodow(r.seen) - 1 = b GROUP BY b")
def dow_distribution(rows):
    return closed(grouped(rows, {"dow": "CAST(weekday(seen) AS bigint)"}, N), "dow", list(range(7)), ["n"])


_ALBUMS = ", a AS (SELECT *, unnest(albums) AS album FROM r)"


@over("r", _ALBUMS + " SELECT album, count(*) AS n, round(avg(score), 4) AS mean, CASE WHEN count(score) > 1 THEN round(stddev_pop(score), 4) END AS std, round(avg(sat) + 1e-9, 4) AS sat, round(avg(bright) + 1e-9, 4) AS bright, round(avg(warm) + 1e-9, 4) AS warm FROM a GROUP BY 1")
def album_summary(rows):
    return grouped(rec.exploded(rows, "albums", "album"), ["album"], {"n": "count(*)", "mean": "round(avg(score), 4)", "std": "CASE WHEN count(score) > 1 THEN round(stddev_pop(score), 4) END", "sat": "round(avg(sat) + 1e-9, 4)", "bright": "round(avg(bright) + 1e-9, 4)", "warm": "round(avg(warm) + 1e-9, 4)"})


@over("r", ", x AS (SELECT *, coalesce(len(albums), 0) > 0 AS inside FROM r) SELECT count(*) AS total, count_if(inside) AS curated, round(100.0 * count_if(inside) / count(*), 2) AS rate, round(avg(CASE WHEN inside THEN score END), 4) AS mean_in, round(avg(CASE WHEN NOT inside THEN score END), 4) AS mean_out FROM x")
def curation_rate(rows):
    x = rows.selectExpr("score", "coalesce(size(albums), 0) > 0 AS inside")
    return summary(x, {"total": "count(*)", "curated": "count_if(inside)", "rate": "CAST(round(100.0 * count_if(inside) / count(*), 2) AS double)", "mean_in": "round(avg(CASE WHEN inside THEN score END), 4)", "mean_out": "round(avg(CASE WHEN NOT inside THEN score END), 4)"})


@over("d", ", x AS (SELECT label, unnest(albums) AS album FROM d), c AS (SELECT label, album, count(*) AS n FROM x GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, album) AS rank FROM c) WHERE rank <= 5")
def albums_by_label(rows):
    return top_per(grouped(rec.exploded(rows, "albums", "album"), ["label", "album"], N), ["label"], "n desc, album", 5)


@over("r", ", h AS (SELECT *, row_number() OVER (ORDER BY seen, rid) AS i, count(*) OVER () AS total FROM r WHERE seen IS NOT NULL) SELECT CASE WHEN i <= total // 2 THEN 'early' ELSE 'recent' END AS half, count(*) AS n, round(avg(score), 4) AS mean FROM h WHERE total >= 4 GROUP BY 1")
def half_split(rows):
    # a row's place is its day's offset plus its place within the day, so that no window spans all records
    dated = rows.where("seen IS NOT NULL").selectExpr("seen", "rid", "score", "CAST(seen AS date) AS day")
    days = dated.groupBy("day").agg(F.count("*").alias("n")).selectExpr("day", "coalesce(sum(n) over (order by day rows between unbounded preceding and 1 preceding), 0) AS before", "sum(n) over () AS total")
    placed = dated.join(days, "day").withColumn("i", F.expr("before + row_number() over (partition by day order by seen, rid)"))
    return grouped(placed.where("total >= 4"), {"half": "CASE WHEN i <= total div 2 THEN 'early' ELSE 'recent' END"}, {"n": "count(*)", "mean": "round(avg(score), 4)"})


DIMENSIONS = {"time_of_day": p.time_of_day("hour"), "focal_category": "focal_cat", "dof_category": "dof", "light_category": "light", "shutter_category": p.shutter_category("shutter")}


@over("r", """, u AS (SELECT 'time_of_day:' || CASE WHEN hour BETWEEN 5 AND 7 OR hour BETWEEN 17 AND 19 THEN 'golden_hour' WHEN hour BETWEEN 10 AND 15 THEN 'midday' WHEN hour < 5 OR hour >= 20 THEN 'night' ELSE 'morning_evening' END AS condition, score FROM r WHERE hour IS NOT NULL
    UNION ALL SELECT 'focal_category:' || focal_cat, score FROM r UNION ALL SELECT 'dof_category:' || dof, score FROM r UNION ALL SELECT 'light_category:' || light, score FROM r
    UNION ALL SELECT 'shutter_category:' || CASE WHEN shutter <= 0.002 THEN 'freeze' WHEN shutter <= 1.0 / 60 THEN 'hand' WHEN shutter <= 1.0 / 15 THEN 'slow' ELSE 'bulb' END, score FROM r WHERE shutter IS NOT NULL UNION ALL SELECT 'scene:' || label, score FROM (SELECT unnest(labels) AS label, score FROM r))
    SELECT condition, count(score) AS n, round(avg(score) + 1e-9, 1) AS mean FROM u WHERE condition IS NOT NULL GROUP BY 1 HAVING count(score) >= 10 ORDER BY mean DESC, condition LIMIT 10""")
def best_conditions(rows):
    pairs = ", ".join(f"'{n}:' || {e}" for n, e in DIMENSIONS.items())
    u = rows.selectExpr("score", f"explode(concat(array_compact(array({pairs})), transform(coalesce(labels, array()), l -> 'scene:' || l))) AS condition")
    return top_per(grouped(u, ["condition"], {"n": "count(score)", "mean": "round(avg(score) + 1e-9, 1)"}, "n >= 10"), [], "mean desc,condition", 10)


@over("r", ", c AS (SELECT score AS cutoff FROM (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM r WHERE score IS NOT NULL) WHERE i = CAST(floor(0.9 * n) AS bigint) + 1) SELECT cutoff, count(*) AS n, round(avg(sat) + 1e-9, 4) AS sat, round(avg(bright) + 1e-9, 4) AS bright FROM r, c WHERE score >= cutoff GROUP BY 1")
def top_decile(rows):
    return _top_decile(rows).groupBy("cutoff").agg(F.count("*").alias("n"), F.round(F.avg("sat") + 1e-9, 4).alias("sat"), F.round(F.avg("bright") + 1e-9, 4).alias("bright"))


def _top_decile(rows):
    """The records from the score upwards that nine tenths of the scores precede, with that ``cutoff`` and the number of scores ``n``.

    Scores are counted in ten thousand equal bins first, then the records of one bin by score: neither list grows with the library
    but for scores that lie closer than a hundredth.
    """
    scored = rows.where("score IS NOT NULL").selectExpr("*", "CAST(least(9999, floor(score * 100)) AS int) AS bin")
    bins = scored.groupBy("bin").agg(F.count("*").alias("c")).selectExpr("bin", "c", "sum(c) over (order by bin) AS upto", "sum(c) over () AS n")
    at = bins.where("upto >= CAST(floor(0.9 * n) AS bigint) + 1").agg(F.min(F.struct("bin", F.expr("upto - c AS below"), "n")).alias("x")).select("x.*")
    inner = scored.join(F.broadcast(at), "bin").groupBy("score", "below", "n").agg(F.count("*").alias("c")).selectExpr("score", "n", "below + sum(c) over (order by score) AS upto")
    cutoff = inner.where("upto >= CAST(floor(0.9 * n) AS bigint) + 1").agg(F.min("score").alias("cutoff"), F.max("n").alias("n"))
    return rows.join(F.broadcast(cutoff), F.col("score") >= F.col("cutoff"))


#: Aperture stops and limits of ISO bars.
STOPS = [0.0, 1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0, 16.0, 22.0]
ISO = [0.0, 100.0, 400.0, 800.0, 1600.0, 3200.0, 1e9]


def _bars(rows, column, edges):
    total = rows.agg(F.count("*").alias("total"))
    bars = grouped(rows, {"bar": f"CAST({p.bars(column, edges)} AS bigint)"}, N)
    return bars.crossJoin(F.broadcast(total)).selectExpr("bar", "n", "CAST(round(100.0 * n / total, 1) AS double) AS pct")


_BARS = "SELECT bar, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 1) AS pct FROM (SELECT CAST(len(list_filter([{edges}], lambda e: {column} > e)) - 1 AS bigint) AS bar FROM r WHERE {column} > 0 AND {column} <= {last}) GROUP BY 1"


@over("r", _BARS.format(column="aperture", edges="0, 1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0, 16.0, 22.0", last=22))
def aperture_bars(rows):
    return _bars(rows, "aperture", STOPS)


@over("r", _BARS.format(column="iso", edges="0, 100, 400, 800, 1600, 3200", last=1e9))
def iso_bars(rows):
    return _bars(rows, "iso", ISO)


@over("r", "SELECT v AS iso_upper_median, CASE WHEN v <= 100 THEN 'bright-light shooter' WHEN v <= 400 THEN 'mixed-light shooter' WHEN v <= 1600 THEN 'indoor-light shooter' ELSE 'low-light shooter' END AS habit FROM (SELECT iso AS v, row_number() OVER (ORDER BY iso) AS i, count(*) OVER () AS n FROM r WHERE iso IS NOT NULL) WHERE i = n // 2 + 1")
def upper_median(rows):
    counts = rows.where("iso IS NOT NULL").groupBy("iso").agg(F.count("*").alias("c")).selectExpr("iso", "sum(c) over (order by iso) AS upto", "sum(c) over () AS n")
    label = p.case(("iso_upper_median <= 100", "'bright-light shooter'"), ("iso_upper_median <= 400", "'mixed-light shooter'"), ("iso_upper_median <= 1600", "'indoor-light shooter'"), ("iso_upper_median IS NULL", "NULL"), other="'low-light shooter'")
    return counts.where("upto >= n div 2 + 1").agg(F.min("iso").alias("iso_upper_median")).selectExpr("iso_upper_median", f"{label} AS habit").where("iso_upper_median IS NOT NULL")


@over("r", "SELECT CAST(round_even(focal, 0) AS bigint) AS mm, count(*) AS n FROM r WHERE focal IS NOT NULL GROUP BY 1 ORDER BY n DESC, mm LIMIT 20")
def focal_bars(rows):
    return top_per(grouped(rows, {"mm": "CAST(bround(focal, 0) AS bigint)"}, N), [], "n desc,mm", 20)


_LIMITS = """SELECT coalesce(round(quantile_cont(thirds, 0.2), 3), 0.72) AS thirds_min, CAST(1.5 AS double) AS tilt_max, coalesce(round(quantile_cont(clutter, 0.8), 3), 0.22) AS clutter_max, coalesce(round(quantile_cont(space, 0.2), 3), 0.25) AS space_min,
    coalesce(round(quantile_cont(isolation, 0.15), 3), 0.85) AS isolation_floor, coalesce(round(quantile_cont(score, 0.15), 1), 35) AS score_floor, coalesce(round(quantile_cont(score, 0.65), 1), 65) AS score_high, coalesce(round(quantile_cont(iq, 0.15), 1), 40) AS iq_floor,
    CAST(0.03 AS double) AS clip_highlights, CAST(0.05 AS double) AS clip_shadows, coalesce(round(quantile_cont(off, 0.75), 3), 0.25) AS off_max FROM r"""
_FIRED = [
    ("off_thirds", "thirds < thirds_min", "1.0 - thirds"), ("tilted", "abs(tilt) > tilt_max", "abs(tilt)"), ("cluttered", "clutter > clutter_max", "clutter"), ("merged_subject", "isolation < isolation_floor", "1.0 - (CASE WHEN isolation > 2 THEN 2.0 ELSE isolation END) / 2.0"),
    ("busy", "space < space_min", "space_min - space"), ("low_score", "score < score_floor", "(score_floor - score) / score_floor"), ("deep_portrait", "dof = 'deep' AND len(list_filter(labels, lambda l: l = 'people and portraits')) > 0", "1.0"),
    ("dark_and_weak", "light = 'low_light' AND score < score_floor + 5", "1.0"), ("blown_highlights", "highlights > clip_highlights", "highlights"), ("blocked_shadows", "shadows > clip_shadows", "shadows"), ("weak_technique", "iq < iq_floor AND score > score_high", "1.0 - iq / 100.0"),
    ("off_centre", "off > off_max AND thirds < thirds_min", "off"),
]
_FLAGS = f", t AS ({_LIMITS}), f AS (" + " UNION ALL ".join(f"SELECT rid, '{n}' AS rule, round(CAST({how} AS double), 4) AS severity FROM r, t WHERE {when}" for n, when, how in _FIRED) + ")"


@over("r", _LIMITS)
def rule_calibration(rows):
    return rules.thresholds(rows)


@over("r", _FLAGS + " SELECT * FROM f")
def rule_flags(rows):
    return rules.flags(rules.severities(rows, rules.thresholds(rows)), ["rid"])


@over("r", _FLAGS + " SELECT rule, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 1) AS pct, round(avg(severity) + 1e-9, 3) AS mean_severity FROM f GROUP BY 1")
def rule_rollup(rows):
    flagged = rules.flags(rules.severities(rows, rules.thresholds(rows)), ["rid"])
    return rules.rollup(flagged, rows.agg(F.count("*").alias("total"))).withColumn("pct", F.col("pct").cast("double"))


@over("r", _FLAGS + ", x AS (SELECT rule, unnest(labels) AS label FROM f JOIN r USING (rid)), c AS (SELECT rule, label, count(*) AS n FROM x GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY n DESC, label) AS rank FROM c) WHERE rank <= 3")
def rule_labels(rows):
    severe = rec.exploded(rules.severities(rows, rules.thresholds(rows)))
    return top_per(grouped(rules.flags(severe, ["label"]), ["rule", "label"], N), ["rule"], "n desc, label", 3)


_INSIGHT_SQL = """, t AS (SELECT coalesce(round(quantile_cont(score, 0.65), 1), 65) AS high, coalesce(round(quantile_cont(iq, 0.15), 1), 40) AS floor FROM r),
    d AS (SELECT unnest(labels) AS label, score FROM r), c AS (SELECT label, count(*) AS n, round(avg(score), 4) AS mean FROM d GROUP BY 1), dom AS (SELECT label FROM c WHERE n >= 0.9 * (SELECT max(n) FROM c) ORDER BY n DESC, label LIMIT 3),
    best AS (SELECT label, mean FROM c WHERE mean IS NOT NULL ORDER BY mean DESC, label LIMIT 1), lens AS (SELECT lens, count(*) AS n FROM r WHERE lens IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
    a AS (SELECT count(hour) AS timed, count(*) FILTER (WHERE hour IN (5, 6, 7, 17, 18, 19)) AS golden, round(stddev_pop(score), 3) AS spread, round(avg(iq), 4) AS iq, round(avg(thirds), 4) AS thirds, round(avg(area), 4) AS area FROM r)
    SELECT insight FROM (SELECT 1 AS i, 'best_scene_rare' AS insight FROM best WHERE mean > 0 AND label NOT IN (SELECT label FROM dom)
    UNION ALL SELECT 2, 'little_golden_hour' FROM a WHERE timed > 0 AND round_even(100.0 * golden / timed, 0) < 8 UNION ALL SELECT 3, 'high_variance' FROM a WHERE spread > 10 UNION ALL SELECT 4, 'low_iq' FROM a WHERE iq < 50
    UNION ALL SELECT 5, 'strong_but_weak_technique' WHERE (SELECT count(*) FROM r, t WHERE coalesce(score, 0) > high AND iq < floor) > 0
    UNION ALL SELECT 8, 'zoom_heavy' FROM lens HAVING round_even(100.0 * sum(CASE WHEN regexp_matches(lens, '[-–]') AND regexp_matches(lens, '[0-9]') THEN 0 ELSE n END) / sum(n), 0) < 30
    UNION ALL SELECT 9, 'centred' FROM a WHERE thirds < 0.65 UNION ALL SELECT 11, 'small_subjects' FROM a WHERE area < 0.06) ORDER BY i LIMIT 10"""


@over("r", _INSIGHT_SQL)
def insights(rows):
    """The rules over the library that fire, the first ten in their order; those over weather, palette warmth and focal profile need columns the tables lack."""
    limits = rules.thresholds(rows).selectExpr("score_high", "iq_floor")
    whole = summary(rows.crossJoin(F.broadcast(limits)), {"timed": "count(hour)", "golden": "count_if(hour IN (5, 6, 7, 17, 18, 19))", "spread": "round(stddev_pop(score), 3)", "iq": "round(avg(iq), 4)", "thirds": "round(avg(thirds), 4)", "area": "round(avg(area), 4)", "odd": "count_if(coalesce(score, 0) > score_high AND iq < iq_floor)"})
    labels = grouped(rec.exploded(rows), ["label"], {"n": "count(*)", "mean": "round(avg(score), 4)"}).withColumn("top", F.expr("max(n) over ()"))
    common = top_per(labels.where("n >= 0.9 * top"), [], "n desc,label", 3).agg(F.collect_list("label").alias("common"))
    best = top_per(labels.where("mean IS NOT NULL"), [], "mean desc,label", 1).selectExpr("label AS best", "mean AS best_mean")
    lenses = top_per(grouped(rows, ["lens"], N), [], "n desc,lens", 10)
    prime = summary(lenses, {"prime": f"bround(100.0D * sum(CASE WHEN {p.is_zoom('lens')} THEN 0 ELSE n END) / sum(n), 0)"})
    one = whole.crossJoin(F.broadcast(common)).crossJoin(F.broadcast(prime)).join(F.broadcast(best), F.lit(True), "left")
    fired = {
        "best_scene_rare": "best_mean > 0 AND NOT array_contains(common, best)", "little_golden_hour": "timed > 0 AND bround(100.0D * golden / timed, 0) < 8", "high_variance": "spread > 10", "low_iq": "iq < 50",
        "strong_but_weak_technique": "odd > 0", "zoom_heavy": "prime < 30", "centred": "thirds < 0.65", "small_subjects": "area < 0.06",
    }
    names = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in fired.items())
    return one.selectExpr(f"explode(slice(array_compact(array({names})), 1, 10)) AS insight")


@over("r", ", t AS (SELECT coalesce(round(quantile_cont(score, 0.65), 1), 65) AS high, coalesce(round(quantile_cont(iq, 0.15), 1), 40) AS floor FROM r) SELECT count(iq) AS n, round(avg(iq), 4) AS mean, round(stddev_pop(iq), 4) AS std, count(*) FILTER (WHERE coalesce(score, 0) > high AND iq < floor) AS high_score_low_iq FROM r, t")
def iq_summary(rows):
    limits = rules.thresholds(rows).selectExpr("score_high", "iq_floor")
    return summary(rows.crossJoin(F.broadcast(limits)), {"n": "count(iq)", "mean": "round(avg(iq), 4)", "std": "round(stddev_pop(iq), 4)", "high_score_low_iq": "count_if(coalesce(score, 0) > score_high AND iq < iq_floor)"})


@over("r", "SELECT b AS bucket, count(iq) AS n FROM range(0, 10) t(b) LEFT JOIN (SELECT * FROM r WHERE iq IS NOT NULL) r ON CAST(least(9, floor(iq / 10)) AS bigint) = b GROUP BY b")
def iq_histogram10(rows):
    return histogram(rows, "iq", 10, 10)

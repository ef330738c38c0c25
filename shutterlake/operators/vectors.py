"""Vector operators of the library analysis: similar pairs, groups, seeds, models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import cut


def similar_pairs(vectors: DataFrame, key: str, column: str, eps: float, block: int = 2048) -> DataFrame:
    """(a, b, dist): pairs with cosine distance of at most ``eps``, a < b; exact.

    Rows go to the nearest of some pivots, drawn by hash, about one for each ``block`` rows, and as copies to every pivot
    that is at most twice the angle of ``eps`` farther: by the triangle inequality a pair meets in the home of either. A
    pivot's rows are cut into parts of ``block``, and each pair of parts is a task that multiplies two bounded matrices. For
    small ``eps`` a row has few copies; beyond a distance of about 0.3 the pivots no longer divide anything.
    """
    n = vectors.count()
    k = min(1024, max(1, -(-n // block)))
    named = vectors.where(f"{column} is not null").select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
    # bounded by the number of pivots
    drawn = named.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(k).collect()
    pivots = np.array([r.v for r in drawn], np.float64)
    pivots = pivots / (np.linalg.norm(pivots, axis=1, keepdims=True) + 1e-9) if len(drawn) else np.zeros((1, 1))
    reach = 2 * np.arccos(max(-1.0, min(1.0, 1 - eps))) + 1e-6
    id_type = vectors.schema[key].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy())
                if len(pivots) > 1:
                    angle = np.arccos(np.clip(m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9) @ pivots.T, -1, 1))
                    home = angle.argmin(axis=1)
                    row, cell = np.nonzero(angle <= angle[np.arange(len(m)), home][:, None] + reach)
                else:
                    home, row, cell = np.zeros(len(m), int), np.arange(len(m)), np.zeros(len(m), int)
                yield pd.DataFrame({"cell": cell.astype("int32"), "home": cell == home[row], "id": b["id"].to_numpy()[row], "v": b["v"].to_numpy()[row]})

    placed = named.mapInPandas(place, f"cell int, home boolean, id {id_type}, v array<double>")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("m")).selectExpr("cell", f"CAST(ceil(m / {int(block)}) AS int) AS parts")
    rows = placed.join(F.broadcast(sizes), "cell").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # one row for each pivot
    sent = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("cell", F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi"), "id", "v", "p", "home")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_numpy())
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
        ids, p, home, lo, hi = pdf["id"].to_numpy(), pdf["p"].to_numpy(), pdf["home"].to_numpy(), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = np.flatnonzero(p == lo), np.flatnonzero(p == hi)
        d = 1 - m[left] @ m[right].T
        i, j = np.nonzero(d <= eps)
        x, y, d = left[i], right[j], d[i, j]
        # each pair once: in the home of the smaller id
        small = np.where(ids[x] < ids[y], x, y)
        ok = (ids[x] < ids[y] if lo == hi else ids[x] != ids[y]) & home[small]
        x, y, d = x[ok], y[ok], d[ok]
        return pd.DataFrame({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "dist": np.maximum(d, 0.0)})

    return sent.groupBy("cell", "lo", "hi").applyInPandas(match, f"a {id_type}, b {id_type}, dist double")


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over the pairs; minimum propagation with pointer jumping."""
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    while True:
        low = both.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = label.join(low, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = cut(step.join(up, "root", "left").select("id", "old", F.least("root", "up").alias("root")))
        label = new.select("id", "root")
        if new.where("old <> root").isEmpty():
            return label


def heroes(groups: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """(root, size, hero, best): per group its best member, by 0.65 score and 0.35 sharpness relative to the sharpest."""
    joined = groups.join(scores, key).withColumn("top", F.expr("max(sharp) over (partition by root)"))
    rank = F.expr("0.65 * coalesce(score, 0) / 100 + 0.35 * coalesce(sharp, 0) / CASE WHEN coalesce(top, 0) = 0 THEN 1 ELSE top END")
    ranked = joined.withColumn("rank", rank)
    return ranked.groupBy("root").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("rank")).alias("r"), key)).alias("h"), F.round(F.max("score"), 4).alias("best")).select("root", "size", F.col(f"h.{key}").alias("hero"), "best")


def seed_distance(vectors: DataFrame, seeds: np.ndarray, key: str, column: str) -> DataFrame:
    """(key, dist): L2 distance to the nearest of ``seeds``, a bounded set that goes along with the code."""
    held = vectors.sparkSession.sparkContext.broadcast(np.asarray(seeds, np.float64))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held.value
        ss = (s * s).sum(axis=1)
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy()).astype(np.float64)
                d = np.sqrt(np.maximum(0, (m * m).sum(axis=1)[:, None] - 2 * m @ s.T + ss)).min(axis=1)
                yield pd.DataFrame({key: b[key], "dist": np.round(d, 6)})

    return vectors.where(f"{column} is not null").select(key, F.col(column).alias("v")).mapInPandas(near, f"{key} bigint, dist double")


def seed_count(n: int) -> int:
    return min(max(2, round(5 * n**0.5)), 1500)


def select_seeds(vectors: DataFrame, key: str, column: str, seed: int = 42) -> DataFrame:
    """(key, cluster): of each k-means cluster that is not empty the member nearest to its centre, ties to the smaller key.

    There are min(seed_count(n), n // 2) clusters of the n rows with a vector; a single row is its own seed.
    """
    data = vectors.where(f"{column} is not null").select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    n = data.count()
    if n < 2:
        return data.select(key, F.lit(0).cast("bigint").alias("cluster"))
    model = KMeans(k=max(1, min(seed_count(n), n // 2)), seed=seed, maxIter=50).fit(data)
    held = vectors.sparkSession.sparkContext.broadcast(np.stack(model.clusterCenters()))

    def to_centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cluster = b["cluster"].to_numpy()
                yield pd.DataFrame({key: b[key], "cluster": cluster, "dist": np.linalg.norm(np.stack(b["v"].to_numpy()) - held.value[cluster], axis=1)})

    placed = model.transform(data).select(key, F.col("prediction").cast("bigint").alias("cluster"), vector_to_array("features").alias("v"))
    near = placed.mapInPandas(to_centre, f"{key} {vectors.schema[key].dataType.simpleString()}, cluster bigint, dist double")
    return near.groupBy("cluster").agg(F.min(F.struct("dist", key)).alias("e")).select(f"e.{key}", "cluster")


def kmeans(vectors: DataFrame, key: str, column: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """(key, cluster); k defaults to a thirtieth of the rows, between 2 and 10."""
    n = vectors.count()
    k = k or max(2, min(10, n // 30))
    data = vectors.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(data)
    return model.transform(data).select(key, F.col("prediction").cast("bigint").alias("cluster"))


def project(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, x, y): the first two principal components."""
    data = vectors.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(data)
    p = vector_to_array("p")
    return model.transform(data).select(key, F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("y"))


#: Penalties that are tried, and folds.
ALPHAS, FOLDS = (1.0, 10.0, 100.0, 500.0, 1000.0), 5


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_pylist()])


def moments(data: DataFrame, folds: int) -> list[dict]:
    """Per fold the sums that ridge regression needs, of (fold, v, y): one pass, and what reaches the driver is the square of the vectors' length."""
    schema = "fold int, blob binary"

    def of(fold: int, x: np.ndarray, y: np.ndarray) -> bytes:
        z = np.hstack([np.ones((len(x), 1)), x, y[:, None]])
        return (z.T @ z).astype("<f8").tobytes()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y, fold = _matrix(b.column("v")), b.column("y").to_numpy(), b.column("fold").to_numpy()
                kinds = np.unique(fold)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([of(f, x[fold == f], y[fold == f]) for f in kinds], pa.binary())], names=["fold", "blob"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f8") for x in table.column("blob").to_pylist())
        return pa.table({"fold": table.column("fold")[:1], "blob": pa.array([total.tobytes()], pa.binary())})

    rows = data.select("fold", "v", "y").mapInArrow(partial, schema).groupBy("fold").applyInArrow(lambda t: add(t), schema).collect()
    return [{"fold": r.fold, "z": np.frombuffer(r.blob, "<f8").reshape(int(len(r.blob) / 8) and round((len(r.blob) / 8) ** 0.5), -1)} for r in rows]


def solve(z: np.ndarray, alpha: float) -> dict:
    """Ridge regression on standardised features from the summed products of (1, x, y): mean, scale, weights and intercept."""
    n, sx, sy = z[0, 0], z[0, 1:-1], z[0, -1]
    mean = sx / n
    scale = np.sqrt(np.maximum(np.diag(z)[1:-1] / n - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    gram = (z[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(scale, scale)
    cross = (z[1:-1, -1] - mean * sy) / scale
    return {"mean": mean, "scale": scale, "weights": np.linalg.solve(gram + alpha * np.eye(len(mean)), cross), "intercept": sy / n, "alpha": alpha}


def predicted(model: dict, x: np.ndarray) -> np.ndarray:
    return model["intercept"] + ((x - model["mean"]) / model["scale"]) @ model["weights"]


def _folded(vectors: DataFrame, key: str, column: str, target: str, folds: int, seed: int) -> DataFrame:
    rows = vectors.where(f"{column} is not null and {target} is not null")
    return rows.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int").alias("fold"))


def ridge_scores(vectors: DataFrame, key: str, column: str, target: str, alphas: tuple = ALPHAS, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """(alpha, r2, mae, within2, within5, within10): pooled out-of-fold quality per penalty, in two passes over the data."""
    data = _folded(vectors, key, column, target, folds, seed)
    parts = moments(data, folds)
    if not parts:
        return vectors.sparkSession.createDataFrame([], "alpha double, r2 double, mae double, within2 double, within5 double, within10 double")
    whole = sum(p["z"] for p in parts)
    models = {p["fold"]: [solve(whole - p["z"] if len(parts) > 1 else whole, a) for a in alphas] for p in parts}

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y, fold = _matrix(b.column("v")), b.column("y").to_numpy(), b.column("fold").to_numpy()
                for i, a in enumerate(alphas):
                    p = np.empty(len(y))
                    for f in np.unique(fold):
                        p[fold == f] = predicted(models[f][i], x[fold == f])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), a)), pa.array(y), pa.array(p)], names=["alpha", "y", "p"])

    away = F.abs(F.col("y") - F.col("p"))
    share = lambda k: F.round(100 * F.avg(F.when(away <= k, 1.0).otherwise(0.0)), 1).alias(f"within{k}")
    found = data.select("fold", "v", "y").mapInArrow(out_of_fold, "alpha double, y double, p double")
    return found.groupBy("alpha").agg(F.round(1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0)), 4).alias("r2"), F.round(F.avg(away), 3).alias("mae"), share(2), share(5), share(10))


def train(vectors: DataFrame, key: str, column: str, target: str, alphas: tuple = ALPHAS, folds: int = FOLDS, seed: int = 42) -> dict:
    """The model of the penalty with the best pooled quality, fitted on all rows, with its ``r2`` and ``mae``."""
    quality = ridge_scores(vectors, key, column, target, alphas, folds, seed).collect()
    best = max(quality, key=lambda r: (r.r2 if r.r2 is not None else float("-inf"), r.alpha == 100.0, -r.alpha))
    model = solve(sum(p["z"] for p in moments(_folded(vectors, key, column, target, 1, seed), 1)), best.alpha)
    return model | {"r2": best.r2, "mae": best.mae}


def predict(vectors: DataFrame, model: dict, key: str, column: str, out: str = "score") -> DataFrame:
    """(key, out): predictions between 0 and 100, two digits; rows without a vector are left out."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(np.clip(predicted(model, _matrix(b.column(1))), 0, 100), 2))], names=[key, out])

    return vectors.where(f"{column} is not null").select(key, F.col(column).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, `{out}` double")


def save_model(spark, model: dict, path: str) -> None:
    """Write a model as a one-row table; ``seeds`` (array<array<double>>) and ``threshold`` go along where it has them."""
    row = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in model.items()}
    schema = "mean array<double>, scale array<double>, weights array<double>, intercept double, alpha double, r2 double, mae double, threshold double, seeds array<array<double>>, labels array<double>"
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(row.get(n) if n in ("seeds", "labels") or isinstance(row.get(n), list) else None if row.get(n) is None else float(row[n]) for n in names)], schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> dict | None:
    """The model at ``path``; None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.parquet(path).first().asDict()
    return row | {k: np.array(row[k]) for k in ("mean", "scale", "weights", "seeds", "labels") if row[k] is not None}


def cascade(rows: DataFrame, teacher, path: str, key: str = "hash", column: str = "dinov3", forced: bool = False) -> DataFrame:
    """Scores for the rows (key, column, score, score_source) without one: the teacher's for a few seeds, the student's for the rest.

    ``teacher(rows) -> (key, score)`` is costly. ``forced``: it scores all. Without a stored model: it scores seeds that cover the
    vectors, a student learns from them and scores the rest. With one: rows within the coverage of its seeds get the
    student's score; new seeds are chosen among those outside, the student learns from old and new, and all that a
    student has scored before is scored again. A stored model without seeds, or fewer than two rows to score: the teacher scores all.
    """
    spark = rows.sparkSession
    pending = rows.where(f"score is null and {column} is not null").select(key, column)
    taught = lambda df: teacher(df).select(key, "score", F.lit("siglip").alias("score_source"))
    student = lambda df, m: predict(df, m, key, column).withColumn("score_source", F.lit("regressor"))
    model = load_model(spark, path)
    n = pending.count()
    if forced:
        return taught(rows.where(f"{column} is not null").select(key, column))
    if n == 0:
        return taught(pending.limit(0))
    if model is None and n < 2 or model is not None and model.get("seeds") is None:
        return taught(pending)

    def learn(seeds: DataFrame, everything: DataFrame, old: dict | None) -> tuple[dict, DataFrame]:
        """(model, the seeds' scores): the teacher sees every seed once."""
        scores = cut(taught(seeds))
        held = seeds.join(scores.select(key, "score"), key).where("score is not null").collect()  # bounded by seed_count
        x, y = np.array([r[column] for r in held], np.float64), np.array([r["score"] for r in held], np.float64)
        if old is not None:
            x, y = np.vstack([old["seeds"], x]), np.r_[old["labels"], y]
        data = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "i bigint, v array<double>, y double")
        near = seed_distance(everything.withColumn("__id", F.monotonically_increasing_id()), x, "__id", column)
        made = train(data, "i", "v", "y") | {"seeds": x, "labels": y, "threshold": near.agg(F.percentile("dist", 0.95)).first()[0]}
        save_model(spark, made, path)
        return made, scores

    if model is None:
        seeds = cut(pending.join(select_seeds(pending, key, column).select(key), key))
        made, scores = learn(seeds, pending, None)
        return scores.unionByName(student(pending.join(seeds.select(key), key, "left_anti"), made))
    indexed = cut(pending.withColumn("__id", F.monotonically_increasing_id()))
    far = seed_distance(indexed, model["seeds"], "__id", column).where(F.col("dist") > model["threshold"]).select("__id")
    outside, inside = indexed.join(far, "__id", "left_semi").drop("__id"), indexed.join(far, "__id", "left_anti").drop("__id")
    if outside.isEmpty():
        return student(inside, model)
    seeds = cut(outside.join(select_seeds(outside, key, column).select(key), key))
    made, scores = learn(seeds, rows.where(f"{column} is not null").select(key, column), model)
    again = rows.where(f"score_source = 'regressor' and {column} is not null").select(key, column)
    return scores.unionByName(student(inside, model)).unionByName(student(outside.join(seeds.select(key), key, "left_anti"), made)).unionByName(student(again, made))


def auto_train(rows: DataFrame, key: str, column: str, path: str) -> bool:
    """Train again on the rows (key, column, score, score_source) that the teacher scored (a missing source counts as the teacher's); the seeds stay. False with fewer than two."""
    spark = rows.sparkSession
    own = rows.where(f"score is not null and {column} is not null and coalesce(score_source, 'siglip') <> 'regressor'")
    if own.limit(2).count() < 2:
        return False
    old = load_model(spark, path) or {}
    save_model(spark, train(own, key, column, "score") | {k: old.get(k) for k in ("seeds", "labels", "threshold")}, path)
    return True


def fingerprint(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """One row ``fingerprint``: the same for the same set of (key, vector), whatever the order; nothing is gathered."""
    h = lambda seed: F.xxhash64(F.col(key), F.col(column), F.lit(seed))
    return vectors.agg(F.sha2(F.concat_ws("|", F.count("*"), F.bit_xor(h(1)), F.bit_xor(h(2)), F.bit_xor(h(3)), F.bit_xor(h(4))), 256).alias("fingerprint"))


def cluster_evaluation(rows: DataFrame, cluster: str, label: str, column: str) -> DataFrame:
    """One row (n, nmi, within, between, separation): agreement with labels, mean similarity within clusters and between their centres.

    Everything follows from the contingency table and from the clusters' summed unit vectors, without pairs of records.
    """
    slim = rows.select(F.col(cluster).alias("c"), F.col(label).alias("l"), F.col(column).cast("array<double>").alias("v")).where("c is not null and l is not null and v is not null")
    cells = slim.groupBy("c", "l").agg(F.count("*").alias("n"))
    p = cells.selectExpr("n / sum(n) over () AS p", "sum(n) over (partition by c) / sum(n) over () AS pc", "sum(n) over (partition by l) / sum(n) over () AS pl", "n", "sum(n) over (partition by c) AS nc", "sum(n) over (partition by l) AS nl")
    info = p.agg(F.expr("sum(p * ln(p / (pc * pl)))").alias("mi"), F.expr("-sum(n * ln(pc)) / sum(n)").alias("hc"), F.expr("-sum(n * ln(pl)) / sum(n)").alias("hl"), F.sum("n").alias("n"))
    norm = "sqrt(aggregate(v, 0D, (a, x) -> a + x * x)) + 1e-9"
    dims = slim.selectExpr("c", "v", f"{norm} AS norm").selectExpr("c", "norm", "posexplode(v) AS (d, x)").groupBy("c", "d").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    sums = dims.groupBy("c").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    within = sums.where("n > 1").agg(F.expr("avg((q - n) / (n * (n - 1)))").alias("within"))
    # the sum of all unit centres gives the mean over pairs of them, as the sums within clusters do
    centre = dims.join(sums.select("c", "q"), "c").groupBy("d").agg(F.sum(F.col("s") / F.sqrt("q")).alias("s"))
    between = centre.agg(F.sum(F.col("s") * F.col("s")).alias("qq")).crossJoin(sums.agg(F.count("*").alias("k"))).selectExpr("CASE WHEN k > 1 THEN (qq - k) / (k * (k - 1)) ELSE 0D END AS between")
    one = info.crossJoin(within).crossJoin(between)
    return one.selectExpr("n", "round(CASE WHEN hc + hl > 0 THEN 2 * mi / (hc + hl) ELSE 1D END, 4) AS nmi", "round(within, 4) AS within", "round(between, 4) AS between", "round(within / (between + 1e-9), 2) AS separation")


def purity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, n, top_label, purity): the most frequent label of each cluster and its share."""
    cells = rows.where(f"{label} is not null").groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("k"))
    return cells.groupBy("cluster").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "label")).alias("t")).selectExpr("cluster", "n", "t.label AS top_label", "round(-t.k / n, 3) AS purity")


def cluster_quality(vectors: DataFrame, cluster: str, column: str) -> DataFrame:
    """(cluster, n, within): mean similarity of the pairs within, from the length of the sum of unit vectors, without pairs."""
    parts = vectors.select(F.col(cluster).alias("cluster"), F.posexplode(F.col(column).cast("array<double>")).alias("d", "x"))
    sums = parts.groupBy("cluster", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.groupBy("cluster").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).selectExpr("cluster", "n", "CASE WHEN n > 1 THEN round((q - n) / (n * (n - 1)), 4) + 0.0 END AS within")

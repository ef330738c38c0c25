"""The record store: merge of sources, upsert, pruning, change detection and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in ``order``; rows with a null key are left out."""
    return rows.where(F.col(key).isNotNull()).withColumn("__place", F.expr(f"row_number() over (partition by {key} order by {order})")).where("__place = 1").drop("__place")


def merge_sources(rows: DataFrame, key: str = "hash", remote_prefix: str = "lightroom_", remote: str = "lightroom", local: str = "local") -> DataFrame:
    """One row per content digest: remote fields from remote rows, the others from local ones first, ``source`` 'both' where both exist."""
    is_remote = F.col("source").isin(remote, "both")
    picked = []
    for c in rows.columns:
        if c in (key, "source"):
            continue
        mine = is_remote if c.startswith(remote_prefix) else ~is_remote
        # null only where no row has the field; of several the smallest text decides, so that order never matters
        picked.append(F.coalesce(F.min(F.when(mine, F.col(c))), F.min(c)).alias(c))
    kind = F.when(F.bool_or(F.col("source") == "both") | (F.bool_or(is_remote) & F.bool_or(F.col("source") == local)), "both").when(F.bool_or(is_remote), remote).otherwise(local)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(kind.alias("source"), *picked)


def stem(path: str) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(F.replace(F.col(path), F.lit("\\"), F.lit("/")), r"([^/]+?)(\.[^./]*)?$", 1)


def folder(path: str) -> Column:
    """Parent folder's name, else 'root'."""
    parts = F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise("root")


def merge_by_stem(local: DataFrame, remote: DataFrame, key: str = "hash", strict: bool = False) -> DataFrame:
    """(key, local_key, stem, source): remote rows take in the local row of the same file stem where the digests differ.

    Rows of equal digest are one in either case; ``strict`` merges those only. Of several with one stem the smallest digest is taken.
    """
    r = remote.select(F.col(key).alias("r"), stem("path").alias("rs"))
    x = local.select(F.col(key).alias("l"), stem("path").alias("ls"))
    same = r.join(x, r.r == x.l, "inner").select("r", "l", F.col("rs").alias("stem"))
    r2, x2 = r.join(x, r.r == x.l, "left_anti"), x.join(r, x.l == r.r, "left_anti")
    left = x2.groupBy("ls").agg(F.min("l").alias("l"))
    right = r2.groupBy("rs").agg(F.min("r").alias("r"))
    paired = right.join(left, (right.rs == left.ls) & F.lit(not strict)).select("r", "l", F.col("rs").alias("stem"))
    both = same.unionByName(paired)
    only_r = r2.join(paired, "r", "left_anti").select(F.col("r").alias(key), F.lit(None).cast("string").alias("local_key"), F.col("rs").alias("stem"), F.lit("lightroom").alias("source"))
    only_l = x2.join(paired, "l", "left_anti").select(F.col("l").alias(key), F.col("l").alias("local_key"), F.col("ls").alias("stem"), F.lit("local").alias("source"))
    return both.select(F.col("r").alias(key), F.col("l").alias("local_key"), "stem", F.lit("both").alias("source")).unionByName(only_r).unionByName(only_l)


def overlay(fresh: DataFrame, cached: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``fresh`` with ``columns`` taken from ``cached`` where present, and ``hit``."""
    c = cached.select(F.col(key).alias("__key"), *[F.col(x).alias(f"__{x}") for x in columns])
    joined = fresh.join(c, fresh[key] == c["__key"], "left")
    kept = [F.coalesce(f"__{x}", x).alias(x) if x in fresh.columns else F.col(f"__{x}").alias(x) for x in columns]
    return joined.select(*[fresh[x] for x in fresh.columns if x not in columns], *kept, F.col("__key").isNotNull().alias("hit"))


def changed(fresh: DataFrame, cached: DataFrame, key: str, version: str, develop: str | None = None, link: str = "link_size") -> DataFrame:
    """Rows of ``fresh`` that are new or whose ``version`` differs, null-safely, with ``change`` 'new' or 'updated'.

    With ``develop``, also 'develop': the cached column of that name is null while ``fresh`` advertises a link of some size.
    """
    c = cached.select(F.col(key).alias("__key"), F.col(version).alias("__version"), *([F.col(develop).alias("__develop")] if develop else []))
    joined = fresh.join(c, fresh[key] == c["__key"], "left")
    kind = F.when(F.col("__key").isNull(), "new").when(~F.col("__version").eqNullSafe(F.col(version)), "updated")
    if develop:
        kind = kind.when(F.col("__develop").isNull() & (F.col(link) > 0), "develop")
    return joined.withColumn("change", kind).where("change is not null").drop("__key", "__version", "__develop")


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those of the same key."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def prune(base: DataFrame, keep: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by whether the key is in ``keep``."""
    return base.join(keep.select(key), key, "left_semi"), base.join(keep.select(key), key, "left_anti")


def clear(base: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the columns ``keys`` emptied; unknown ones are ignored."""
    return base.withColumns({k: F.lit(None).cast(base.schema[k].dataType) for k in keys if k in base.columns})


def pending(base: DataFrame, key: str, reachable: str = "path IS NOT NULL OR lightroom_id IS NOT NULL") -> DataFrame:
    """The work queue of a column: records without it that can still get it."""
    return base.where(F.col(key).isNull()).where(reachable)


def album_index(albums: DataFrame) -> DataFrame:
    """(asset_id, albums) from rows (album, id, nested_id): an asset is registered under both its ids."""
    each = albums.select("album", F.explode(F.array_distinct(F.array_compact(F.array("id", "nested_id")))).alias("asset_id"))
    return each.groupBy("asset_id").agg(F.array_sort(F.collect_set("album")).alias("albums"))


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new table beside ``path`` and swap it in by two renames: the old one stays readable until the new one is whole."""
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(fresh)
    jvm = spark.sparkContext._jvm
    at = {x: jvm.org.apache.hadoop.fs.Path(x) for x in (path, fresh, old)}
    fs = at[path].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at[old], True)
    if fs.exists(at[path]) and not fs.rename(at[path], at[old]):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at[fresh], at[path]):
        raise OSError(f"cannot move {fresh}")
    fs.delete(at[old], True)


def point(base: DataFrame, key: str, value) -> DataFrame:
    """The record of one key; the filter reaches the Parquet scan."""
    return base.where(F.col(key) == F.lit(value))


def keep_set(*sides: DataFrame, key: str = "hash") -> DataFrame:
    """The keys of all sides, once each."""
    out = sides[0].select(key)
    for s in sides[1:]:
        out = out.unionByName(s.select(key))
    return out.where(F.col(key).isNotNull()).distinct()


def stale(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "hash") -> DataFrame:
    """One row (kept, stale): how pruning to what either side still has would come out."""
    marked = base.join(keep_set(local, remote, key=key).withColumn("__keep", F.lit(True)), key, "left")
    return marked.agg(F.count_if("__keep").alias("kept"), F.count_if(F.col("__keep").isNull()).alias("stale"))


def merged_snapshots(runs: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row per key of an append-only table of runs: partial runs replace only what they ran."""
    return latest(runs, key, order)


def report_document(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row ``document``: JSON with a schema version, the number of records and the result tables, which are small."""
    base = rows.agg(F.count("*").alias("photos"))
    for name, t in tables.items():
        base = base.crossJoin(F.broadcast(t.agg(F.collect_list(F.struct(*t.columns)).alias(name))))
    return base.select(F.to_json(F.struct(F.lit("1").alias("schema_version"), "photos", F.struct(*tables).alias("aggregated"))).alias("document"))


def write_json(document: DataFrame, path: str) -> None:
    """Write one JSON text beside ``path`` and rename it there, so that a reader sees the old one or the new one."""
    text = document.first()[0]
    context = document.sparkSession.sparkContext
    jvm = context._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    staged = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(context._jsc.hadoopConfiguration())
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(staged, target):
        raise OSError(f"cannot rename {path}.tmp")

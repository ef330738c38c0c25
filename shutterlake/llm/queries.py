"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import clusters, components, mixing, neighbours, packing, sentences, survivor, tokens, variety
from shutterlake.session import materialise
from shutterlake.sources.tables import table


def p1_subset(spark: SparkSession, folder: str) -> DataFrame:
    """One per cent of all photos with a usable vector."""
    return variety.varied_subset(table(spark, folder, "photos"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.nearest(table(spark, folder, "photos")), 0.95)


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_rows(neighbours.nearest(table(spark, folder, "photos")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.photo_survivors(table(spark, folder, "photos"))


def p3_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.photo_consensus(table(spark, folder, "photos"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.closed_clusters(clusters.cluster(table(spark, folder, "photos"), typicality=False))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.described(clusters.cluster(table(spark, folder, "photos")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.group_rows(components.groups(components.link_rows(table(spark, folder, "match_edges"))))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sized, _ = materialise(tokens.sized(table(spark, folder, "documents"), ["doc_id"]), "sized")
    return packing.pack(sized, table(spark, folder, "pack_limits"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.usage(_packed(spark, folder), table(spark, folder, "pack_limits"))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    sized, _ = materialise(tokens.sized(table(spark, folder, "documents"), ["doc_id", "source"]), "sized")
    return mixing.mix(sized, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_subset, p2_found, p2_neighbours, p3_found, p3_consensus, p4_found, p4_clusters, p6_found, p8_containers, p8_fill, p9_mix, p9_shares, p10_found)}
_DIGEST = lambda c: f"CASE WHEN length(regexp_replace(lower({c}), '^\\s*sha-?256\\s*[:=]?|[^0-9a-f]', '', 'g')) = 64 THEN regexp_replace(lower({c}), '^\\s*sha-?256\\s*[:=]?|[^0-9a-f]', '', 'g') END"
ORACLES: dict[str, str] = {
    "p3_found": f"""WITH r AS (SELECT {_DIGEST('hash')} AS hash, * EXCLUDE (hash), count(*) OVER (PARTITION BY {_DIGEST('hash')}) AS n FROM photos), u AS (SELECT hash, 'aesthetic_score' AS field, record_id, analysed_at, CASE lower(trim(aesthetic_score_source)) WHEN 'siglip' THEN 2 WHEN 'regressor' THEN 1 ELSE 0 END AS trust, aesthetic_score AS v FROM r WHERE n > 1
        UNION ALL SELECT hash, 'iq_score', record_id, analysed_at, 0, iq_score FROM r WHERE n > 1) SELECT hash, field, record_id FROM (SELECT *, row_number() OVER (PARTITION BY hash, field ORDER BY trust DESC, analysed_at DESC NULLS LAST, record_id DESC) AS i FROM u WHERE hash IS NOT NULL AND v BETWEEN 0 AND 100) WHERE i = 1""",
    "p6_found": f"""WITH RECURSIVE e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT {_DIGEST('hash_a')} AS a, {_DIGEST('hash_b')} AS b FROM match_edges WHERE cos_dist <= 0.05 AND NOT isnan(cos_dist)) WHERE a <> b), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        c AS (SELECT DISTINCT a AS hash, a AS root FROM w UNION SELECT w.b, c.root FROM c JOIN w ON w.a = c.hash WHERE c.root < w.b), g AS (SELECT hash, min(root) AS root FROM c GROUP BY 1) SELECT root AS root_hash, hash FROM g WHERE root <> hash""",
}

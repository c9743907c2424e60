"""The queries of this package over the tables of a data folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import clustering, divergence, html_extract, jaccard, langid, merkle, mixing, packing, pii, quality, secrets, sharding, topk
from fathomline.llm.shared import table

#: Bytes of text that one shard may hold.
SHARD_BYTES = 16 << 20


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mix_sources, op2_near_duplicates, op3_top_k, op4_fingerprints, op5_pii, op6_secrets, op7_pack, op8_shard, op9_main_text, op10_language,
            op11_clusters, op12_divergence, op13_quality,
        )
    }


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds in full: every vector against every centroid."""
    ctes = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "x AS (SELECT r, unnest(range(64)) AS j, unnest(v) AS v FROM kept)",
        f"""first AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster, v FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) <= {k})""",
        "c0 AS (SELECT cluster, unnest(range(64)) AS j, unnest(v) AS v FROM first)",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS (SELECT r, cluster, d FROM (SELECT x.r, c.cluster, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{i} AS c USING (j) GROUP BY x.r, c.cluster)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)"""
        )
        if i < rounds:
            ctes.append(
                f"""c{i + 1} AS (SELECT c.cluster, c.j, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN
                (SELECT cluster, j, CAST((sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM x JOIN a{i} USING (r) GROUP BY cluster, j) AS m USING (cluster, j))"""
            )
    return f"""WITH {", ".join(ctes)}, h AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS name FROM c{rounds} GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, name AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN h USING (cluster)"""


#: Every group with every kept term, counted as 0 where it doesn't occur.
DIVERGENCE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM d),
    dense AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN n USING (lang, source, term)),
    p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v.v) AS HUGEINT) AS p FROM dense JOIN v USING (lang)),
    l AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
    q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v.v) AS HUGEINT) AS q FROM l JOIN v USING (lang)),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs AS p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM found QUALIFY part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_clusters": _clusters_sql(), "op12_divergence": DIVERGENCE_SQL}

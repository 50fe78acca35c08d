"""The queries of this subpackage, by name, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, centroids, decontaminate, divergence, fingerprints, near_dedup, neighbours, quality, token_counts, token_files, toxicity, url_filter, warc
from tidemark.llm.common import table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op2_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op6_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op7_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op8_url_digest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_heavy_light_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_template_decontamination, op2_chunked_bpe, op3_nnpu_toxicity, op4_warc_splits, op5_cws_fingerprints,
        op6_separator_token_counts, op7_repair_token_files, op8_url_digest_rules, op9_dart_minhash, op10_crf_quality,
        op11_heavy_light_divergence, op12_partial_distance_clusters, op13_projected_neighbours,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _share(count: str, total: str, kept: str) -> str:
    return f"1 + (1000000000 * ({count} + 5)) // ({total} + 5 * {kept})"


_DIVERGENCE_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT g.lang, g.source, k.term, k.lang_n, count(w.term) AS n
          FROM g JOIN k USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY 1, 2, 3, 4),
    p AS (SELECT c.*, {_share("n", "sum(n) OVER (PARTITION BY c.lang, c.source)", "v.v")} AS p, {_share("lang_n", "v.lang_total", "v.v")} AS q
          FROM c JOIN v USING (lang)),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round spelled out: distances by component, the nearest centroid of each row, the floor of the means."""
    nearest = """
    d{r} AS (SELECT x.r, c.cluster, sum((x.x - c.x) * (x.x - c.x)) AS distance FROM x JOIN c{r} c ON x.i = c.i GROUP BY 1, 2),
    a{r} AS (SELECT r, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS n FROM d{r}) WHERE n = 1)"""
    move = """,
    m{r} AS (SELECT a.cluster, x.i, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN x ON a.r = x.r GROUP BY 1, 2),
    c{t} AS MATERIALIZED (SELECT c.cluster, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
             FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster AND c.i = m.i),"""
    steps = "".join(nearest.format(r=r) + move.format(r=r, t=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
    u AS (SELECT r, unnest(embedding) AS y, generate_subscripts(embedding, 1) AS i FROM e),
    b AS (SELECT DISTINCT r FROM u WHERE y IS NULL OR NOT isfinite(y)),
    x AS MATERIALIZED (SELECT r, i, CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT) AS x FROM u WHERE r NOT IN (SELECT r FROM b)),
    h AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST) - 1 AS n FROM e WHERE r NOT IN (SELECT r FROM b)),
    c0 AS (SELECT h.n AS cluster, x.i, x.x FROM h JOIN x ON h.r = x.r WHERE h.n < {k}),{steps},
    f AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
    SELECT e.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
           CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
           f.centroid_sha256
    FROM a{rounds} a JOIN e ON a.r = e.r JOIN f ON a.cluster = f.cluster"""


ORACLE_SQL = {
    "op11_heavy_light_divergence": _DIVERGENCE_SQL,
    "op12_partial_distance_clusters": _clusters_sql(),
    "op4_warc_splits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
                          CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        w AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to FROM w""",
    "op8_url_digest_rules": """
        WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM r),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        k(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (SELECT page_id, host, path, verdict, rhost || rpath AS rule,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
              FROM p JOIN k ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1""",
}

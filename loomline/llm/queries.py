"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cost_packing, embedding_dedup, exact_dedup, hard_negatives, jaccard_join, language_id, license_scan, mixing, packing, quality, resampling, suffix_dedup, token_counts
from .workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), Workspace(spark, "op1"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(table(spark, sf_dir, "documents"), Workspace(spark, "op3"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(table(spark, sf_dir, "documents"), Workspace(spark, "op5"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), Workspace(spark, "op6"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"), Workspace(spark, "op7"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op8"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), exact_dedup.arrivals(), Workspace(spark, "op10"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, Workspace(spark, "op11"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op12"))


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.cost_packed(table(spark, sf_dir, "documents"), Workspace(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_source_mixing": op5_source_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_quality": op8_quality,
    "op9_license_scan": op9_license_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_cost_packing": op13_cost_packing,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op5_source_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        per AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
          FROM sized GROUP BY source),
        filled AS (
          SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS fills,
                 sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM per),
        leveled AS (
          SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER (ORDER BY fills, source NULLS LAST) AS place
          FROM filled WINDOW b AS (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        budgets AS (
          SELECT source, source_size, least(cap, coalesce((SELECT level FROM leveled WHERE level <= fills ORDER BY place LIMIT 1), 'inf'::DOUBLE) * w) AS target FROM leveled),
        keyed AS (
          SELECT s.doc_id, s.size, b.source, b.source_size, b.target, CAST(floor(b.target) AS BIGINT) AS budget,
                 CASE WHEN b.source_size = 0 THEN 0 ELSE least(CAST(floor(b.target) AS BIGINT) // b.source_size, 2) END AS whole
          FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
        ordered AS (
          SELECT *, coalesce(sum(size) OVER (PARTITION BY source
                 ORDER BY substr(md5(doc_id || ':' || whole), 1, 15), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM keyed)
        SELECT doc_id, size, source_size, target,
               CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken
        FROM ordered""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
          SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
        QUALIFY row_number() OVER w <= 3""",
    "op12_importance_resampling": r"""
        WITH RECURSIVE bits(i, c, k) AS (
          SELECT range, range::UBIGINT, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        held AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        wanted AS (
          SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        said AS (SELECT r, unnest(words) AS w FROM held),
        known AS (SELECT DISTINCT w FROM (SELECT w FROM said UNION ALL SELECT w FROM wanted)),
        placed AS (
          SELECT w, CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i - 1 AS BIGINT), 2))::UBIGINT)),
                 lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS BIGINT) AS bucket
          FROM known, steps),
        source AS (SELECT bucket, count(*) AS n FROM said JOIN placed USING (w) GROUP BY bucket),
        target AS (SELECT bucket, count(*) AS n FROM wanted JOIN placed USING (w) GROUP BY bucket),
        gains AS (
          SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM said) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)))) AS BIGINT) AS gain
          FROM source s LEFT JOIN target t USING (bucket)),
        weighed AS (SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM said JOIN placed USING (w) JOIN gains USING (bucket) GROUP BY r),
        scored AS (
          SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
          FROM held LEFT JOIN weighed USING (r)),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ordered""",
}

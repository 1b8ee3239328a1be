"""The queries of the corpus operators, as the driver runs them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import exactdedup, hmm, html, jaccard, media, mixing, packing, quality, sharding, substrings


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(_documents(spark, sf_dir))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         ((coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647 * 48271 + 12345) % 2147483647 AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS most FROM s),
r AS (SELECT *, most / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
             sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, docs, least(most, weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target,
             ((rank + 1) * 1000003 % 2147483647 * 48271) % 2147483647 / 2147483647.0::DOUBLE AS u FROM l),
p AS (SELECT d.*, source_size, target, u, row_number() OVER (PARTITION BY d.source ORDER BY h % ((docs + 2047) // 2048), size, h, doc_id) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM p)
SELECT doc_id, size, source_size, target, CAST(floor(place * rate + u) - floor((place - 1) * rate + u) AS BIGINT) * size AS taken FROM q
"""


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op8_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(_documents(spark, sf_dir)).drop("key")


OP4_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST) AS place FROM d)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY place) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_documents(spark, sf_dir)).drop("key")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_digest(substrings.remove_repeats(_documents(spark, sf_dir)))


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT rid, s, sha256(array_to_string(w[s : s + 34], ' ')) AS h FROM d, unnest(range(1, greatest(1, len(w) - 33))) AS t(s)),
r AS (SELECT rid, s FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT rid, p FROM r, unnest(range(s, s + 35)) AS t(p)),
e AS (SELECT rid, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT e.rid, string_agg(v, ' ' ORDER BY e.p) AS kept, count(*) AS n FROM e ANTI JOIN g ON g.rid = e.rid AND g.p = e.p GROUP BY e.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each embedding is drawn as one."""
    drawn = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", media.render(F.col("embedding")).alias("image"))
    return media.copies(drawn, "vec_id", "image").withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_score": op1_hmm_score,
    "op2_mix_sources": op2_mix_sources,
    "op3_pack_best_fit": op3_pack_best_fit,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_extract_html": op5_extract_html,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_votes": op7_quality_votes,
    "op8_shard_slots": op8_shard_slots,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_image_copies": op10_image_copies,
}
SQL: dict[str, str] = {"op2_mix_sources": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op9_substring_dedup": OP9_SQL}

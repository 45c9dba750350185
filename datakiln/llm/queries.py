"""The registered queries of this subpackage, each over its whole table with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm import byte_bpe, hard_negatives, mixing, near, pii, quality, secrets, simhash, token_counts, token_files, top_k, toxicity, va_file


#: Clusters and rounds of the clustering, and what the token files have behind each document.
CENTROIDS, ROUNDS = 40, 5
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mix_plan(docs)
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.find(docs, keep=["doc_id"]))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.report(secrets.find(docs, keep=["doc_id"]))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", label=label)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch.folder(spark, "token_files")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.report(token_files.read(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_token_counts, op2_mixing, op3_top_k, op4_toxicity, op5_nearest, op6_quality, op7_byte_bpe, op8_simhash, op9_pii, op10_secrets, op11_hard_negatives, op12_centroids, op13_token_files)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against plain versions."""
    return {"op2_mixing": MIXING_SQL, "op3_top_k": TOP_K_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_centroids": centroids_sql(CENTROIDS, ROUNDS)}


#: The exact searches and the mixture, as DuckDB states them.
TOP_K_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
whole AS MATERIALIZED (SELECT row_number() OVER () AS place, vec_id, list_transform(v, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM sound),
scored AS (
  SELECT q.place, q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole r ON q.vec_id % 50 = 0 AND q.place <> r.place AND len(q.v) = len(r.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

HARD_NEGATIVES_SQL = """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, r.place, r.vec_id, a.label = r.label AS alike, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM whole a JOIN whole r ON a.vec_id % 100 = 0 AND a.place <> r.place AND len(a.v) = len(r.v)),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, place) AS nth FROM scored WHERE alike)
  WHERE nth <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY n.score DESC, n.vec_id NULLS LAST, n.place) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

CENTROIDS_START = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c FROM kept)
  WHERE cluster < {k})"""

CENTROIDS_NEAREST = """,
a{i} AS MATERIALIZED (
  SELECT place, vec_id, v, cluster, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY distance, cluster) AS nth FROM (
      SELECT k.*, c.cluster, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS distance FROM kept k, c{i} c))
  WHERE nth = 1)"""

CENTROIDS_MEANS = """,
m{i} AS (
  SELECT cluster, list(floor(total / n) ORDER BY d) AS c FROM (
    SELECT cluster, d, sum(v[d]) AS total, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS d) GROUP BY cluster, d) GROUP BY cluster),
c{j} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON o.cluster = m.cluster)"""

CENTROIDS_END = """
SELECT a.vec_id, a.cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{i} a JOIN c{i} c ON a.cluster = c.cluster
"""


def centroids_sql(k: int, rounds: int) -> str:
    """The rounds of the clustering written out one after the other."""
    steps = [CENTROIDS_NEAREST.format(i=i) + CENTROIDS_MEANS.format(i=i, j=i + 1) for i in range(rounds)]
    return CENTROIDS_START.format(k=k) + "".join(steps) + CENTROIDS_NEAREST.format(i=rounds) + CENTROIDS_END.format(i=rounds)


MIXING_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, md5('0:' || CAST(doc_id AS VARCHAR)) AS shuffled,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, sum(size) AS source_size FROM slim GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sizes),
weighted AS (SELECT *, [5.0, 2.0, 1.0][CAST((rank - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight, 3.0 * CAST(source_size AS DOUBLE) AS ceiling FROM ranked),
levels AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER ()
      - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ceiling / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
goals AS (SELECT source, source_size, rank, least(ceiling, weight * max(level) OVER ()) AS target FROM levels),
timed AS (
  SELECT d.*, g.source_size, g.rank, g.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM slim d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT t.*, e.epoch, CAST((e.epoch - 1) * source_size + upto AS DOUBLE) / target AS time
  FROM timed t, (SELECT unnest([1, 2, 3]) AS epoch) e WHERE size > 0),
queued AS (SELECT *, sum(size) OVER (ORDER BY time, rank, shuffled, size ROWS UNBOUNDED PRECEDING) AS total FROM copies),
kept AS (SELECT doc_id, count(*) AS copies FROM queued WHERE total <= (SELECT sum(size) FROM slim) GROUP BY doc_id)
SELECT t.doc_id, t.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, CAST(coalesce(k.copies, 0) * t.size AS BIGINT) AS taken,
       t.source, CAST(coalesce(k.copies, 0) AS INTEGER) AS copies
FROM timed t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

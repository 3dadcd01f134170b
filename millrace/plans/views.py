"""Logical views over the driver's tables, as DataFrames and as SQL.

samples: documents with labels; frames: events as scored frames of videos (users) by method
(event type, ``view`` being the real one); videos: frames by video with both models' mean scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import hash_split, sigmoid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("sample_id"),
        F.when(F.col("quality").isNull(), "").when(F.col("quality") == 1, "FAKE").otherwise("REAL").alias("label"),
        F.col("lang").alias("domain"), "source", F.coalesce(F.col("toxic").cast("string"), F.lit("")).alias("family"),
        F.sha2("text", 256).alias("exact"), F.sha2(F.lower(F.trim("text")), 256).alias("near"), hash_split("split-v1", "doc_id").alias("split"))


SAMPLES = """
  samples AS (
    SELECT d.doc_id AS sample_id, CASE WHEN l.quality IS NULL THEN '' WHEN l.quality = 1 THEN 'FAKE' ELSE 'REAL' END AS label,
      d.lang AS domain, d.source, coalesce(CAST(l.toxic AS VARCHAR), '') AS family, sha256(d.text) AS exact, sha256(lower(trim(d.text))) AS near,
      CASE WHEN substr(sha256('split-v1' || chr(0) || d.doc_id), 1, 1) < '8' THEN 'validation' ELSE 'test' END AS split
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
    base = (2 * F.floor(user / 6)).cast("long")
    a, b = F.log(F.col("value") + 1) - 3.5, (k - 50) / F.lit(20.0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"), user.alias("video"), F.col("event_type").alias("method"), (F.col("event_type") != "view").cast("int").alias("label"),
        F.when(user % 2 == 0, "ff").otherwise("cdf").alias("domain"), "ts", k.alias("k"), a.alias("logit_a"), b.alias("logit_b"),
        sigmoid(a).alias("score"), sigmoid(b).alias("score_b"),
        F.array_sort(F.array_distinct(F.array(F.concat(F.lit("u"), base), F.concat(F.lit("u"), base + user % 2)))).alias("lineage"))


FRAMES = """
  frames0 AS (
    SELECT event_id AS sample_id, user_id AS video, event_type AS method, CAST(event_type <> 'view' AS INTEGER) AS label,
      CASE WHEN user_id % 2 = 0 THEN 'ff' ELSE 'cdf' END AS domain, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      ln(value + 1) - 3.5 AS logit_a, list_sort(list_distinct(['u' || (2 * (user_id // 6)), 'u' || (2 * (user_id // 6) + user_id % 2)])) AS lineage
    FROM events),
  frames1 AS (SELECT *, (k - 50) / 20.0::DOUBLE AS logit_b FROM frames0),
  frames AS (SELECT *, 1 / (1 + exp(-logit_a)) AS score, 1 / (1 + exp(-logit_b)) AS score_b FROM frames1)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("domain", "method", "label", "video", "lineage").agg(
        F.avg("score").alias("base"), F.avg("score_b").alias("candidate"), F.count(F.lit(1)).alias("n"))


VIDEOS = FRAMES + """,
  videos AS (SELECT domain, method, label, video, lineage, avg(score) AS base, avg(score_b) AS candidate, count(*) AS n FROM frames GROUP BY ALL)"""

#: Each method's fakes with all reals of its domain.
PAIRED = FRAMES + """,
  methods AS (SELECT DISTINCT domain, method AS slice_method FROM frames WHERE label = 1),
  paired AS (
    SELECT *, method AS slice_method FROM frames WHERE label = 1
    UNION ALL SELECT f.*, m.slice_method FROM frames f JOIN methods m ON f.domain = m.domain WHERE f.label = 0)"""


def curve(rows: str, keys: str, weight: str = "1") -> str:
    """CTEs that end in ``curve``: counts at and above each distinct score of each slice."""
    return f""",
  sums AS (SELECT {keys}, score, sum({weight} * (label = 1)::INT)::DOUBLE AS pos, sum({weight} * (label = 0)::INT)::DOUBLE AS neg FROM {rows} GROUP BY ALL),
  curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n
    FROM sums WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC), a AS (PARTITION BY {keys}))"""


AUROC = "sum(pos * (n - fp + neg / 2)) / (max(p) * max(n))"
AVERAGE_PRECISION = "sum(pos * tp / (tp + fp)) / max(p)"
TPR_AT_FPR = "coalesce(max(CASE WHEN fp / n <= 0.05 THEN tp / p END), 0)"

#: Points of the curve with the point before; the first gap of 0 or more.
EER = """,
  points AS (SELECT *, fp / n AS fpr, fp / n - 1 + tp / p AS gap FROM curve),
  steps AS (SELECT *, lag(fpr, 1, 0) OVER w AS x0, lag(gap, 1, -1) OVER w AS g0 FROM points WINDOW w AS (PARTITION BY domain, slice_method ORDER BY score DESC)),
  eers AS (SELECT domain, slice_method, x0 + (fpr - x0) * (-g0) / (gap - g0) AS eer FROM steps WHERE gap >= 0
    QUALIFY row_number() OVER (PARTITION BY domain, slice_method ORDER BY score DESC) = 1)"""

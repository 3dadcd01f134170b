"""Queries of reports over runs, plane similarities and extended catalogs, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import geometry
from millrace.operators import listings, reports, subsets
from millrace.plans.catalogue import query, rounded
from millrace.plans.views import AUROC, AVERAGE_PRECISION, SAMPLES, VIDEOS, curve, samples, table, videos

# three runs are three mixtures of the two models' scores

RUNS = f"""{VIDEOS},
  run_rows AS (SELECT r AS run, domain, method, label, video, base * (1 - r / 4.0::DOUBLE) + candidate * (r / 4.0::DOUBLE) AS score FROM videos, range(3) t(r)),
  paired AS (SELECT *, method AS slice_method FROM run_rows WHERE label = 1
    UNION ALL SELECT v.*, m.slice_method FROM run_rows v JOIN (SELECT DISTINCT run, domain, method AS slice_method FROM run_rows WHERE label = 1) m ON v.run = m.run AND v.domain = m.domain WHERE v.label = 0){curve('paired', 'run, domain, slice_method')},
  points AS (SELECT *, fp / n AS fpr, fp / n - 1 + tp / p AS gap FROM curve),
  steps AS (SELECT *, lag(fpr, 1, 0) OVER w AS x0, lag(gap, 1, -1) OVER w AS g0 FROM points WINDOW w AS (PARTITION BY run, domain, slice_method ORDER BY score DESC)),
  eers AS (SELECT run, domain, slice_method, x0 + (fpr - x0) * (-g0) / (gap - g0) AS eer FROM steps WHERE gap >= 0 QUALIFY row_number() OVER (PARTITION BY run, domain, slice_method ORDER BY score DESC) = 1),
  measured AS (SELECT run, domain, slice_method, {AUROC} AS auroc, {AVERAGE_PRECISION} AS average_precision, coalesce(max(CASE WHEN fp / n <= 0.01 THEN tp / p END), 0) AS tpr_at_fpr FROM curve GROUP BY ALL),
  long AS (SELECT run, domain, slice_method AS method, unnest(['auroc', 'average_precision', 'tpr_at_fpr', 'eer']) AS metric, unnest([auroc, average_precision, tpr_at_fpr, eer]) AS value FROM measured JOIN eers USING (run, domain, slice_method)),
  run_values AS (SELECT * FROM long UNION ALL SELECT run, domain, 'macro', metric, avg(value) FROM long GROUP BY ALL)"""


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    each = videos(spark, d).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    share = F.col("run") / F.lit(4.0)
    return each.select("run", "domain", "method", "label", "video", (F.col("base") * (1 - share) + F.col("candidate") * share).alias("score"))


@query(f"""WITH {RUNS}
SELECT domain, method, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n_seeds FROM run_values GROUP BY ALL""")
def q_seed_summary(spark: SparkSession, d: str) -> DataFrame:
    told = spark.createDataFrame([(i, 100 + i, "model", "manifest") for i in range(3)], "run long, seed long, model string, manifest string")
    out = reports.seed_summary(run_rows(spark, d), told, ["model", "manifest"], ["domain", "method", "label", "video"])
    return rounded(out, "mean", "sd", "low", "high")


@query(f"""WITH {RUNS}, asked AS (SELECT * FROM (VALUES ('near', 0, 1), ('far', 0, 2), ('gone', 1, 7)) t(name, b, c))
SELECT name, x.domain AS domain, x.method AS method, x.metric AS metric, round(x.value, 6) AS baseline, round(y.value, 6) AS candidate, round(y.value - x.value, 6) AS diff, 'ok' AS status
FROM asked JOIN run_values x ON x.run = b JOIN run_values y ON y.run = c AND y.domain = x.domain AND y.method = x.method AND y.metric = x.metric
UNION ALL SELECT name, NULL, NULL, NULL, NULL, NULL, NULL, 'absent: 7' FROM asked WHERE c = 7""")
def q_run_comparisons(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("near", 0, 1), ("far", 0, 2), ("gone", 1, 7)], "name string, baseline long, candidate long")
    return rounded(reports.compare_runs(reports.run_metrics(run_rows(spark, d), ["run"]), asked), "baseline", "candidate", "diff")


@query("""WITH p AS (
  SELECT a.vec_id, unnest(range(1, len(a.embedding) // 2 + 1)) AS i, a.embedding AS s, b.embedding AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND len(a.embedding) = len(b.embedding)),
  q AS (SELECT vec_id, s[2 * i - 1]::DOUBLE AS sx, s[2 * i]::DOUBLE AS sy, t[2 * i - 1]::DOUBLE AS tx, t[2 * i]::DOUBLE AS ty FROM p),
  m AS (SELECT *, avg(sx) OVER w AS mx, avg(sy) OVER w AS my, avg(tx) OVER w AS nx, avg(ty) OVER w AS ny FROM q WINDOW w AS (PARTITION BY vec_id)),
  f AS (SELECT vec_id, any_value(mx) AS mx, any_value(my) AS my, any_value(nx) AS nx, any_value(ny) AS ny,
    sum((sx - mx) * (tx - nx) + (sy - my) * (ty - ny)) / sum((sx - mx) ** 2 + (sy - my) ** 2) AS a, sum((sx - mx) * (ty - ny) - (sy - my) * (tx - nx)) / sum((sx - mx) ** 2 + (sy - my) ** 2) AS b FROM m GROUP BY ALL),
  g AS (SELECT vec_id, a, b, avg(sqrt((a * sx - b * sy + nx - a * mx + b * my - tx) ** 2 + (b * sx + a * sy + ny - b * mx - a * my - ty) ** 2)) AS distance FROM q JOIN f USING (vec_id) GROUP BY ALL)
SELECT vec_id, round(sqrt(a * a + b * b), 6) AS scale, round(atan2(b, a), 6) AS turn, round(distance, 6) AS distance FROM g""")
def q_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The best similarity of each vector, read as points of the plane, to the next one's."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = rows.alias("a").join(rows.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    s, t = geometry.points_of(F.col("a.embedding")), geometry.points_of(F.col("b.embedding"))
    fitted = both.select("a.vec_id", s.alias("s"), t.alias("t")).withColumn("m", geometry.similarity(F.col("s"), F.col("t"))).where(F.col("m").isNotNull())
    far = geometry.mean_distance(geometry.moved(F.col("m"), F.col("s")), F.col("t"))
    return rounded(fitted.select("vec_id", F.hypot("m.a", "m.b").alias("scale"), F.atan2("m.b", "m.a").alias("turn"), far.alias("distance")), "scale", "turn", "distance")


LISTED = {m: listings.LISTED_METHODS[m] for m in ("fomm", "mraa")}


@query("""WITH members AS (SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'train/fomm.zip' ELSE 'test/MRAA.zip' END AS archive, 'v' || page_id % 50 AS video, page_id || CASE WHEN page_id % 11 = 0 THEN '.txt' ELSE '.png' END AS frame,
    CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN 'ff' ELSE 'cdf' END AS domain FROM pages),
  placed AS (SELECT *, CASE page_id % 2 WHEN 0 THEN 'fomm' ELSE 'mraa' END AS method, CASE page_id % 2 WHEN 0 THEN 'fomm/frames/' ELSE 'MRAA/' || domain || '/' END || video || '/' || frame AS member FROM members WHERE page_id % 11 <> 0),
  dealt AS (SELECT *, CASE method WHEN 'fomm' THEN 'train' WHEN 'mraa' THEN CASE WHEN substr(sha256('eval-v1' || chr(0) || 'grow-v1' || chr(0) || domain || chr(0) || video), 1, 1) < '8' THEN 'validation' ELSE 'test' END END AS split,
    'deepfakes_detection_datasets/DF40/' || member AS source_path FROM placed),
  new AS (SELECT *, 'images/' || domain || '/' || method || '/' || split || '/none/' || video || '/' || substr(sha256(source_path), 1, 12) || '_' || frame AS path FROM dealt)
SELECT substr(sha256(path), 1, 24) AS image_id, path AS relative_path, split, CASE split WHEN 'train' THEN 'train' ELSE 'test' END AS official_splits, method AS fake_method, domain || ':' || video AS video_id,
  page_id::VARCHAR AS frame_index, 'archive:' || archive AS source_json, domain || ':' || video AS lineage_video_ids FROM new
UNION ALL SELECT 's' || s_suppkey, 'images/s' || s_suppkey, 'train', '', '', 'ff:' || s_suppkey || '_' || s_nationkey, '', '',
  CASE s_suppkey % 3 WHEN 0 THEN 'ff:told' WHEN 1 THEN 'ff:a|ff:b' ELSE array_to_string(list_sort(list_distinct(['ff:' || s_suppkey, 'ff:' || s_nationkey])), '|') END FROM supplier""")
def q_extend_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Pages as members of two archives, suppliers as the catalog that they extend."""
    page = F.col("page_id")
    folder = F.when(page % 2 == 0, "fomm/frames/").when(page % 3 == 0, "MRAA/ff/").otherwise("MRAA/cdf/")
    members = table(spark, d, "pages").select(
        F.when(page % 2 == 0, "train/fomm.zip").otherwise("test/MRAA.zip").alias("archive"), F.concat(folder, F.lit("v"), page % 50, F.lit("/"), page, F.when(page % 11 == 0, ".txt").otherwise(".png")).alias("member"))
    key, empty = F.col("s_suppkey"), F.lit("")
    base = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), key).alias("image_id"), F.concat(F.lit("images/s"), key).alias("relative_path"), F.lit("REAL").alias("label"), F.lit("train").alias("split"), F.lit("ff").alias("source_domain"),
        F.concat(F.lit("ff:"), key, F.lit("_"), "s_nationkey").alias("video_id"), F.when(key % 3 == 1, " b | a ").otherwise("").alias("source_video_id"), F.when(key % 3 == 0, "ff:told").otherwise("").alias("lineage_video_ids"),
        *(empty.alias(c) for c in ("official_splits", "fake_method", "manipulation_family", "identity_id", "frame_index", "compression", "source_json", "source_path", "target_identity_id")))
    out = listings.extend_catalog(base, members, "grow-v1", LISTED)
    return out.select("image_id", "relative_path", "split", "official_splits", "fake_method", "video_id", "frame_index", "source_json", "lineage_video_ids")


# a subset by quotas of split, method and domain; three samples are a video

SUBSET = {
    "seed": "subset-v1", "id": "sample_id", "label": "label", "split": "split", "method": "method", "domain": "domain", "group_columns": ["video"], "frame": "sample_id", "strict": False, "disjoint": "all",
    "rules": {"validation": {"methods": ["m0", "m1"], "images": 1, "groups": 8, "frames": 2, "domains": {"en": 9, "de": 5}}, "test": {"methods": ["m2"], "images": 15, "groups": 9, "frames": 3}},
}

_SPACED = "k <= take OR CASE take WHEN 1 THEN pos = k // 2 ELSE list_contains(list_transform(range(take), lambda i: round_even(i * (k - 1) / (take - 1), 0)::BIGINT), pos) END"


@query(f"""WITH {SAMPLES},
  rows0 AS (SELECT sample_id, label, split, coalesce(domain, '') AS domain, 'm' || (sample_id // 3 % 3) AS method, 'video:' || (sample_id // 3) AS grp FROM samples),
  cells AS (SELECT * FROM (VALUES ('validation', 'm0', 'de', 5, 8, 2), ('validation', 'm0', 'en', 9, 8, 2), ('validation', 'm1', 'de', 5, 8, 2), ('validation', 'm1', 'en', 9, 8, 2), ('test', 'm2', '', 15, 9, 3)) t(s, m, d, images, groups, frames)),
  placed AS (SELECT * FROM rows0 JOIN cells ON split = s AND method = m AND (d = '' OR d = domain) WHERE label = 'FAKE'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY s, m, d ORDER BY sha256('subset-v1' || chr(0) || s || chr(0) || m || chr(0) || grp), grp) AS rk FROM (SELECT s, m, d, images, groups, frames, grp, count(*) AS n FROM placed GROUP BY ALL)),
  taken AS (SELECT *, least(least(n, frames), images - coalesce(sum(least(n, frames)) OVER (PARTITION BY s, m, d ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS take FROM ranked WHERE rk <= groups),
  fakes AS (SELECT sample_id, split, domain, label, method, grp FROM (SELECT p.*, t.take, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY s, m, d, grp) AS k FROM placed p JOIN taken t USING (s, m, d, grp) WHERE take > 0
    WINDOW w AS (PARTITION BY s, m, d, grp ORDER BY sample_id)) WHERE {_SPACED}),
  target AS (SELECT split, domain, count(*) AS target, CASE split WHEN 'test' THEN 3 ELSE 2 END AS frames FROM fakes GROUP BY ALL),
  real_ranked AS (SELECT *, row_number() OVER (PARTITION BY split, domain ORDER BY sha256('subset-v1' || chr(0) || split || chr(0) || 'real' || chr(0) || domain || chr(0) || grp), grp) AS rk
    FROM (SELECT split, domain, target, frames, grp, count(*) AS n FROM rows0 JOIN target USING (split, domain) WHERE label = 'REAL' GROUP BY ALL)),
  real_taken AS (SELECT *, least(least(n, frames), target - coalesce(sum(least(n, frames)) OVER (PARTITION BY split, domain ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS take FROM real_ranked),
  reals AS (SELECT sample_id, split, domain, label, method, grp FROM (SELECT p.*, t.take, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY p.split, p.domain, p.grp) AS k
    FROM rows0 p JOIN real_taken t ON p.split = t.split AND p.domain = t.domain AND p.grp = t.grp WHERE p.label = 'REAL' AND take > 0 WINDOW w AS (PARTITION BY p.split, p.domain, p.grp ORDER BY sample_id)) WHERE {_SPACED})
SELECT sample_id, split, domain, label, method, grp AS selection_group, 'fake' AS selection_role FROM fakes UNION ALL SELECT sample_id, split, domain, label, method, grp, 'real' FROM reals""".replace("", ""))
def q_subset_quotas(spark: SparkSession, d: str) -> DataFrame:
    video = F.floor(F.col("sample_id") / 3).cast("long")
    rows = samples(spark, d).select(
        "sample_id", "split", F.coalesce("domain", F.lit("")).alias("domain"), "label", F.concat(F.lit("m"), video % 3).alias("method"), video.cast("string").alias("video"))
    return subsets.select_subset(rows, subsets.spec_of(SUBSET))[0].drop("video")

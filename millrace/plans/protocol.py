"""Queries of catalogs, manifests and evaluation protocols over the driver's tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bundles, catalog, fusion, gates, partition, sampling
from millrace.plans.catalogue import DECIDED, decided, query, rounded
from millrace.plans.views import AUROC, FRAMES, SAMPLES, curve, frames, samples, table

# catalogs: a record for each user and event type, whose frames are the distinct numbers of its events

SOURCES = {"view": "SimSwap_ff.json", "click": "wav2lip_cdf.json", "purchase": "sd2.1_ff.json", "signup": "StarGANv2.json", "error": "blendface_cdf.json"}


def records(spark: SparkSession, d: str) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    events = table(spark, d, "events").select(user, kind, F.get_json_object("props", "$.k").alias("k"))
    shots = events.groupBy(user, kind).agg(F.sort_array(F.collect_set(F.concat_ws("/", F.lit("in"), kind, user, F.concat("k", F.lit(".png"))))).alias("frames"))
    where = F.when(user % 4 == 0, F.array(F.lit("train"))).when(user % 4 == 1, F.array(F.lit("val"))).when(user % 4 == 2, F.array(F.lit("test"))).otherwise(F.array(F.lit("val"), F.lit("test")))
    source = F.element_at(F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair]), kind)
    keys = F.array(F.lit("cat"), F.when(user % 2 == 0, "a_real").otherwise("fake-b"), F.col("where"), F.lit("C23"), F.concat_ws("_", user, user % 7))
    nodes = shots.withColumn("where", F.explode(where)).select(
        F.concat(F.lit("/x/"), source).alias("source"), keys.alias("keys"), F.parse_json(F.to_json(F.struct("frames"))).alias("record"))
    ranks = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(sorted(SOURCES.values(), key=str.lower), 1) for x in (f"/x/{v}", i)]), F.col("source"))
    return nodes.withColumn("source_rank", ranks)


CATALOG = """
  e AS (SELECT DISTINCT user_id AS u, event_type AS t, json_extract_string(props, '$.k') AS k FROM events),
  m AS (SELECT * FROM (VALUES ('view', 'SimSwap_ff.json', 'simswap', 'face_swap', 'ff'), ('click', 'wav2lip_cdf.json', 'wav2lip', 'face_reenactment', 'cdf'),
    ('purchase', 'sd2.1_ff.json', 'sd21', 'entire_face_synthesis', 'ff'), ('signup', 'StarGANv2.json', 'starganv2', 'face_edit', 'celeba'), ('error', 'blendface_cdf.json', 'blendface', 'face_swap', 'cdf'))
    v(t, source_json, method, family, domain)),
  f AS (SELECT 'in/' || t || '/' || u || '/' || k || '.png' AS source_path, k || '.png' AS name, u || '_' || u % 7 AS video, CASE WHEN u % 2 = 0 THEN 'REAL' ELSE 'FAKE' END AS label,
    CASE u % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' ELSE 'test|validation' END AS official_splits, u, k, m.* FROM e JOIN m USING (t)),
  g AS (SELECT *, CASE WHEN u % 4 = 0 THEN 'train' WHEN substr(sha256('eval-v1' || chr(0) || 'seed-v1' || chr(0) || domain || chr(0) || video), 1, 1) < '8' THEN 'validation' ELSE 'test' END AS split FROM f),
  r AS (SELECT *, 'images/' || domain || '/' || CASE label WHEN 'FAKE' THEN method ELSE 'real' END || '/' || split || '/C23/' || video || '/' || substr(sha256(source_path), 1, 12) || '_' || name AS relative_path FROM g),
  catalog AS (SELECT substr(sha256(relative_path), 1, 24) AS image_id, relative_path, label, split, official_splits, CASE label WHEN 'FAKE' THEN method ELSE '' END AS fake_method,
    CASE label WHEN 'FAKE' THEN family ELSE 'real' END AS manipulation_family, domain AS source_domain, domain || ':' || video AS video_id, '' AS identity_id, k::BIGINT::VARCHAR AS frame_index,
    'C23' AS compression, source_json, source_path, '' AS source_video_id, '' AS target_identity_id,
    CASE domain WHEN 'ff' THEN array_to_string(list_sort(list_distinct(['ff:' || u, 'ff:' || u % 7])), '|') ELSE domain || ':' || video END AS lineage_video_ids FROM r)"""


def official(spark: SparkSession, d: str) -> DataFrame:
    return catalog.normalize_catalog(records(spark, d), "seed-v1")


@query(f"WITH {CATALOG} SELECT * FROM catalog")
def q_normalize_catalog(spark: SparkSession, d: str) -> DataFrame:
    return official(spark, d)


@query("""WITH files AS (SELECT DISTINCT 'seg/' || c_nationkey || '/' || c_custkey || '.png' AS file FROM customer JOIN orders ON c_custkey = o_custkey),
  q AS (SELECT c_custkey, 'seg/' || c_nationkey || '/' || c_custkey || '.png' AS path_query, c_mktsegment FROM customer)
SELECT sha256('set' || chr(0) || '1' || chr(0) || c_custkey) AS sample_id, 'set' AS dataset_name, '1' AS dataset_version, c_custkey::VARCHAR AS source_id, path_query, coalesce(file, '') AS relative_path,
  c_mktsegment AS label, '' AS split, CASE WHEN file IS NULL THEN 'missing_image' ELSE 'ok' END AS status, c_mktsegment FROM q LEFT JOIN files ON file = path_query""")
def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    ordered = customers.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    files = ordered.select(F.concat(F.lit("seg/"), "c_nationkey", F.lit("/"), "c_custkey", F.lit(".png")).alias("path"))
    rows = customers.withColumn("split", F.lit(" "))
    return catalog.project_manifest(rows, files, "set", "1", "c_custkey", "c_mktsegment", "split", "seg/{c_nationkey}/{c_custkey}.png", ["c_mktsegment", "c_mktsegment"])


@query(f"WITH {SAMPLES} SELECT sample_id AS image_id, split, source AS video_id, label, exact, near FROM samples")
def q_subset_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d)
    subset = rows.select(F.col("sample_id").alias("image_id"), "split", F.col("source").alias("video_id"), "label")
    manifest = rows.select(F.col("sample_id").alias("source_id"), "split", F.col("source").alias("video_id"), F.lit("ok").alias("status"), "exact", "near")
    return catalog.require_same_samples(subset, manifest, ["exact", "near"], ["train", "validation", "test"])


@query(f"""WITH {SAMPLES}, vids AS (SELECT sample_id, split, exact, near, sample_id // 3 AS video FROM samples),
  long AS (SELECT split, video, CASE split WHEN 'test' THEN 3 ELSE 2 END AS p, unnest(['exact', 'near']) AS kind, unnest([exact, near]) AS key FROM vids),
  held AS (SELECT kind, key, max(p) AS best FROM long GROUP BY ALL HAVING max(p) > min(p)),
  gone AS (SELECT DISTINCT split, video FROM long JOIN held USING (kind, key) WHERE p < best)
SELECT sample_id, split, video FROM vids WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.split = vids.split AND gone.video = vids.video)""")
def q_pruned(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).select("sample_id", "split", "exact", "near", F.floor(F.col("sample_id") / 3).cast("long").alias("video"))
    return sampling.pruned(rows, ["exact", "near"], {"test": 3, "validation": 2, "train": 1}).select("sample_id", "split", "video")


# audits of protocols, over the catalog as a manifest

def manifest(spark: SparkSession, d: str) -> DataFrame:
    hashed = F.sha2("source_path", 256)
    return official(spark, d).select(
        F.col("image_id").alias("sample_id"), "split", "label", "fake_method", "video_id", "source_domain", "lineage_video_ids", "identity_id", "target_identity_id",
        hashed.alias("pixel_sha256"), F.substring(hashed, 1, 4).alias("dhash64"), F.when(F.col("frame_index") == "13", "bad").otherwise("ok").alias("status"))


AUDIT = CATALOG + """,
  rows0 AS (SELECT image_id AS sample_id, split, label, fake_method, video_id, source_domain, lineage_video_ids, sha256(source_path) AS pixel, substr(sha256(source_path), 1, 4) AS dhash,
    CASE frame_index WHEN '13' THEN 'bad' ELSE 'ok' END AS status, CASE label WHEN 'FAKE' THEN fake_method ELSE 'real' END AS cell FROM catalog),
  links AS (SELECT sample_id, split, status, 'video' AS kind, source_domain || ':' || video_id AS key FROM rows0
    UNION ALL SELECT sample_id, split, status, 'parent', unnest(string_split(lineage_video_ids, '|')) FROM rows0
    UNION ALL SELECT sample_id, split, status, 'identity', source_domain || ':' || unnest(string_split(lineage_video_ids, '|')) FROM rows0 WHERE source_domain IN ('ff', 'celeba')
    UNION ALL SELECT sample_id, split, status, 'pixel', pixel FROM rows0 UNION ALL SELECT sample_id, split, status, 'dhash', dhash FROM rows0)"""
PROTOCOL = {"train": ["simswap", "wav2lip"], "validation": ["sd21"], "test": ["starganv2", "fomm"]}
TARGETS = {("ff", "real"): 10, ("ff", "sd21"): 10_000, ("cdf", "wav2lip"): 5, ("celeba", "starganv2"): 5, ("cdf", "fomm"): 1}


@query(f"""WITH {AUDIT}, ok AS (SELECT * FROM rows0 WHERE status = 'ok'), wanted AS (SELECT * FROM (VALUES ('train', 'simswap'), ('train', 'wav2lip'), ('train', 'real'), ('validation', 'sd21'), ('validation', 'real'),
    ('test', 'starganv2'), ('test', 'fomm'), ('test', 'real')) t(split, cell)),
  parts AS (SELECT 'count' AS section, split || '/' || cell AS key, count(*) AS n FROM ok GROUP BY ALL
    UNION ALL SELECT 'invalid', '', count(*) FROM rows0 WHERE status <> 'ok' HAVING count(*) > 0
    UNION ALL SELECT 'forbidden', split || '/' || cell, count(*) FROM ok WHERE label = 'FAKE' AND NOT EXISTS (SELECT 1 FROM wanted w WHERE w.split = ok.split AND w.cell = ok.cell) GROUP BY ALL
    UNION ALL SELECT 'absent', split || '/' || cell, 0 FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM ok WHERE w.split = ok.split AND w.cell = ok.cell)
    UNION ALL SELECT 'overlap', kind, count(*) FROM (SELECT kind, key FROM links WHERE status = 'ok' GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY ALL
    UNION ALL SELECT 'missing', 'identity', count(*) FROM ok WHERE source_domain = 'cdf' HAVING count(*) > 0)
SELECT section, key, n::BIGINT AS n, section <> 'count' AS failure FROM parts""")
def q_unseen_audit(spark: SparkSession, d: str) -> DataFrame:
    return gates.unseen_audit(manifest(spark, d), PROTOCOL)


@query(f"""WITH {AUDIT}, ok AS (SELECT * FROM rows0 WHERE status = 'ok' AND split = 'test'), wanted AS (SELECT * FROM (VALUES ('ff', 'real', 10), ('ff', 'sd21', 10000), ('cdf', 'wav2lip', 5),
    ('celeba', 'starganv2', 5), ('cdf', 'fomm', 1)) t(source_domain, cell, target)),
  vids AS (SELECT source_domain, cell, count(DISTINCT video_id) AS n FROM ok GROUP BY ALL),
  parts AS (SELECT 'count' AS section, source_domain || '/' || cell AS key, n FROM vids
    UNION ALL SELECT 'invalid', '', count(*) FROM rows0 WHERE status <> 'ok' OR split <> 'test' HAVING count(*) > 0
    UNION ALL SELECT 'unexpected', source_domain || '/' || cell, n FROM vids WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.source_domain = vids.source_domain AND w.cell = vids.cell)
    UNION ALL SELECT 'short', source_domain || '/' || cell, coalesce(n, 0) FROM wanted LEFT JOIN vids USING (source_domain, cell) WHERE coalesce(n, 0) < target
    UNION ALL SELECT 'overlap', kind, count(*) FROM (SELECT kind, key FROM links WHERE status = 'ok' AND split = 'test' INTERSECT SELECT kind, key FROM links WHERE split IN ('train', 'validation')) GROUP BY ALL
    UNION ALL SELECT 'missing', 'identity', count(*) FROM ok WHERE source_domain = 'cdf' HAVING count(*) > 0)
SELECT section, key, n::BIGINT AS n, section <> 'count' AS failure FROM parts""")
def q_heldout_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d)
    return gates.heldout_audit(rows, rows, TARGETS)


# aggregation and the external report

@query(f"""WITH {FRAMES},
  ranked AS (SELECT video, method, label, logit_a AS x, row_number() OVER (PARTITION BY video, method, label ORDER BY logit_a) AS r, count(*) OVER (PARTITION BY video, method, label) AS k FROM frames WHERE domain = 'ff'),
  v AS (SELECT video, method, label, ln(avg(1 / (1 + exp(-x))) / (1 - avg(1 / (1 + exp(-x))))) AS mean_probability, avg(x) AS mean, median(x) AS median,
    avg(x) FILTER (r > floor(k * 0.2) AND r <= k - floor(k * 0.2)) AS trimmed, avg(x) FILTER (r > k - greatest(1, ceil(k * 0.25))) AS top_quarter FROM ranked GROUP BY ALL),
  each AS (SELECT method, label, unnest([0, 1, 2, 3, 4]) AS place, unnest(['mean_probability', 'mean', 'median', 'trimmed', 'top_quarter']) AS aggregation, unnest([mean_probability, mean, median, trimmed, top_quarter]) AS score FROM v),
  paired AS (SELECT method AS slice_method, label, place, aggregation, score FROM each WHERE label = 1
    UNION ALL SELECT m.method, label, place, aggregation, score FROM each, (SELECT DISTINCT method FROM each WHERE label = 1) m WHERE label = 0){curve('paired', 'place, aggregation, slice_method')},
  macro AS (SELECT place, aggregation, avg(a) AS auroc FROM (SELECT place, aggregation, slice_method, {AUROC} AS a FROM curve GROUP BY ALL) GROUP BY ALL)
SELECT aggregation, round(auroc, 6) AS auroc, place = (SELECT min(place) FROM macro WHERE auroc >= (SELECT max(auroc) FROM macro) - 0.002) AS chosen FROM macro""")
def q_select_aggregation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.select_aggregation(frames(spark, d), "logit_a", "video", "method", "domain", "ff"), "auroc")


@query(f"""WITH {DECIDED}, b AS (SELECT method AS bundle, video || '/' || label AS video, label, probability, ['u' || video % 40] AS identities FROM called),
  bundles AS (SELECT bundle, video, label, probability, identities FROM b UNION ALL SELECT m.bundle, b.video, b.label, b.probability, b.identities FROM b, (SELECT DISTINCT bundle FROM b WHERE bundle <> 'view') m WHERE b.bundle = 'view'),
  decided0 AS (SELECT * FROM bundles WHERE bundle <> 'view'), held AS (SELECT 'u' || i AS identity FROM range(7) t(i)),
  scored AS (SELECT bundle, 'excluding_abstentions' AS variant, video, label, probability AS score, identities FROM decided0 WHERE probability IS NOT NULL
    UNION ALL SELECT bundle, 'abstain_as_0.5', video, label, coalesce(probability, 0.5), identities FROM decided0),
  parts AS (SELECT bundle, variant, 'all' AS population, label, score FROM scored UNION ALL SELECT bundle, variant, 'identity_disjoint', label, score FROM scored WHERE NOT list_has_any(identities, (SELECT list(identity) FROM held)))
  {curve('parts', 'bundle, variant, population')},
  c AS (SELECT bundle, variant, population, {AUROC} AS auroc, sum(pos * tp / (tp + fp)) / max(p) AS average_precision, coalesce(max(CASE WHEN fp / n <= 0.01 THEN tp / p END), 0) AS tpr_at_fpr FROM curve GROUP BY ALL),
  bins AS (SELECT bundle, variant, population, least(floor(score * 10), 9) AS bin, count(*) AS k, sum(score) AS s, sum(label) AS y, sum((score - label) ** 2) AS q FROM parts GROUP BY ALL),
  cal AS (SELECT bundle, variant, population, sum(k)::BIGINT AS videos, sum(q) / sum(k) AS brier, sum(abs(s - y)) / sum(k) AS ece FROM bins GROUP BY ALL)
SELECT bundle, variant, population, videos, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(tpr_at_fpr, 6) AS tpr_at_fpr, round(brier, 6) AS brier, round(ece, 6) AS ece FROM c JOIN cal USING (bundle, variant, population)""")
def q_external_report(spark: SparkSession, d: str) -> DataFrame:
    called = decided(spark, d).select(
        F.col("method").alias("bundle"), F.concat_ws("/", "video", "label").alias("video"), "label", "probability", F.array(F.concat(F.lit("u"), F.col("video") % 40)).alias("identities"))
    others = called.where("bundle <> 'view'")
    names = others.select(F.col("bundle").alias("name")).distinct()  # a few methods
    rows = others.unionByName(called.where("bundle = 'view'").crossJoin(F.broadcast(names)).withColumn("bundle", F.col("name")).drop("name"))
    held = spark.range(7).select(F.concat(F.lit("u"), "id").alias("identity"))
    return rounded(fusion.external_report(rows, held), "auroc", "average_precision", "tpr_at_fpr", "brier", "ece")


# picks of an unseen-method protocol, over the users' frames as videos of two entities each

UNSEEN = partition.PartitionSpec(
    "unseen-v1", {"train": ["click", "purchase"], "validation": ["signup"], "test": ["error"]},
    {"test": {"ff": 6, "cdf": 4}, "validation": {"ff": 5, "cdf": 3}, "train": {"ff": 12}})


@query(f"""WITH RECURSIVE {FRAMES},
  vids AS (SELECT DISTINCT domain, CASE label WHEN 1 THEN method ELSE '' END AS method, CASE label WHEN 1 THEN 'FAKE' ELSE 'REAL' END AS label, video::VARCHAR AS video,
    list_sort(list_distinct(['e' || (video // 24 * 12 + video % 24 // 2), 'e' || (video // 24 * 12 + (video * 5 + 3) % 12)])) AS entities FROM frames),
  cells AS (SELECT * FROM (VALUES (1, 'test', 'FAKE', 'error', 'ff', 6), (2, 'test', 'FAKE', 'error', 'cdf', 4), (3, 'validation', 'FAKE', 'signup', 'ff', 5), (4, 'validation', 'FAKE', 'signup', 'cdf', 3),
    (5, 'train', 'FAKE', 'click', 'ff', 12), (6, 'train', 'FAKE', 'purchase', 'ff', 12), (7, 'test', 'REAL', '', 'ff', 6), (8, 'test', 'REAL', '', 'cdf', 4),
    (9, 'validation', 'REAL', '', 'ff', 5), (10, 'validation', 'REAL', '', 'cdf', 3), (11, 'train', 'REAL', '', 'ff', 24)) t(stage, split, label, method, domain, quota)),
  turns AS (SELECT row_number() OVER (ORDER BY stage, i) AS p, stage, split, label, method, domain FROM (SELECT *, unnest(range(quota)) AS i FROM cells)),
  able AS (SELECT stage, v.domain || '/' || v.method || '/' || v.video AS name, v.*, split,
    sha256('unseen-v1' || chr(0) || CASE v.label WHEN 'REAL' THEN 'real' || chr(0) || split ELSE split || chr(0) || v.method END || chr(0) || v.domain || chr(0) || v.video) AS hash,
    list_transform(entities, lambda e: split || '|' || v.domain || '|' || e) AS own,
    flatten(list_transform(list_filter(['test', 'validation', 'train'], lambda s: s <> split), lambda s: list_transform(entities, lambda e: s || '|' || v.domain || '|' || e))) AS foreigners
    FROM vids v JOIN cells c ON c.label = v.label AND c.method = v.method AND c.domain = v.domain),
  run AS (
    SELECT 0::BIGINT AS p, []::VARCHAR[] AS owned, []::VARCHAR[] AS picked
    UNION ALL
    SELECT p, owned, picked FROM (
      SELECT t.p, CASE WHEN a.name IS NULL THEN r.owned ELSE list_concat(r.owned, a.own) END AS owned, list_append(r.picked, coalesce(a.name, '')) AS picked,
        row_number() OVER (ORDER BY a.name IS NULL, len(list_filter(a.own, lambda e: NOT list_contains(r.owned, e))), a.hash) AS best
      FROM run r JOIN turns t ON t.p = r.p + 1 LEFT JOIN able a ON a.stage = t.stage AND NOT list_contains(r.picked, a.name) AND NOT list_has_any(r.owned, a.foreigners))
    WHERE best = 1),
  last AS (SELECT unnest(picked) AS name, unnest(range(1, len(picked) + 1)) AS p FROM run WHERE p = (SELECT max(p) FROM run))
SELECT a.split, a.label, a.method, a.domain, a.video, array_to_string(a.entities, '|') AS entities, CAST(row_number() OVER (PARTITION BY a.stage ORDER BY p) AS INTEGER) AS pick
FROM last JOIN turns USING (p) JOIN able a ON a.stage = turns.stage AND a.name = last.name""")
def q_unseen_partition(spark: SparkSession, d: str) -> DataFrame:
    video = F.col("video")
    name = lambda n: F.concat(F.lit("e"), n.cast("long"))
    block = F.floor(video / 24) * 12
    rows = frames(spark, d).select(F.when(F.col("label") == 1, "FAKE").otherwise("REAL").alias("label"), F.col("method").alias("fake_method"), F.col("domain").alias("source_domain"),
                                   video.cast("string").alias("video_id"), F.array(name(block + F.floor(video % 24 / 2)), name(block + (video * 5 + 3) % 12)).alias("entities"))
    picked = partition.disjoint_partition(partition.candidates_of(rows, F.col("entities")), UNSEEN)
    return picked.withColumn("entities", F.array_join("entities", "|"))


# bundles fixed on one domain's videos, and decisions on media; three models are the frames' numbers modulo 3

#: Newton steps for slope and offset from the group's odds; the optimum doesn't depend on the way to it.
def newton(rows: str, keys: str) -> str:
    return f"""
  odds AS (SELECT {keys}, 0.0::DOUBLE AS a, ln(avg(label) / (1 - avg(label))) AS b FROM {rows} GROUP BY ALL),
  steps AS (
    SELECT 0 AS step, {keys}, a, b FROM odds
    UNION ALL
    SELECT step + 1, {keys}, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
      SELECT s.step, {keys}, s.a, s.b, sum((p - label) * x) AS ga, sum(p - label) AS gb, sum(p * (1 - p) * x * x) + 1e-9 AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) + 1e-9 AS hbb
      FROM (SELECT s.*, r.x, r.label, 1 / (1 + exp(-(s.a * r.x + s.b))) AS p FROM steps s JOIN {rows} r USING ({keys}) WHERE s.step < 30) s GROUP BY ALL)),
  platt AS (SELECT {keys}, a AS slope, b AS "offset" FROM steps WHERE step = 30)"""


BUNDLES = f"""{FRAMES},
  ranked AS (SELECT k % 3 AS model, video, method, label, logit_a + CASE k % 3 WHEN 1 THEN logit_b / 4 ELSE 0 END AS x FROM frames WHERE domain = 'ff'),
  placed AS (SELECT *, row_number() OVER (PARTITION BY model, video, method, label ORDER BY x) AS r, count(*) OVER (PARTITION BY model, video, method, label) AS n FROM ranked),
  v AS (SELECT model, video, method, label, ln(avg(1 / (1 + exp(-x))) / (1 - avg(1 / (1 + exp(-x))))) AS mean_probability, avg(x) AS mean, median(x) AS median,
    avg(x) FILTER (r > floor(n * 0.2) AND r <= n - floor(n * 0.2)) AS trimmed, avg(x) FILTER (r > n - greatest(1, ceil(n * 0.25))) AS top_quarter FROM placed GROUP BY ALL),
  each AS (SELECT model, method, label, unnest([0, 1, 2, 3, 4]) AS place, unnest(['mean_probability', 'mean', 'median', 'trimmed', 'top_quarter']) AS aggregation, unnest([mean_probability, mean, median, trimmed, top_quarter]) AS score FROM v),
  paired AS (SELECT model, method AS slice_method, label, place, aggregation, score FROM each WHERE label = 1
    UNION ALL SELECT model, m.method, label, place, aggregation, score FROM each JOIN (SELECT DISTINCT model, method FROM each WHERE label = 1) m USING (model) WHERE label = 0){curve('paired', 'model, place, aggregation, slice_method')},
  macro AS (SELECT model, place, aggregation, avg(a) AS auroc FROM (SELECT model, place, aggregation, slice_method, {AUROC} AS a FROM curve GROUP BY ALL) GROUP BY ALL),
  chosen AS (SELECT model, arg_min(aggregation, place) AS aggregation, arg_min(auroc, place) AS auroc FROM macro JOIN (SELECT model, max(auroc) AS best FROM macro GROUP BY ALL) USING (model) WHERE auroc >= best - 0.002 GROUP BY ALL),
  summed AS (SELECT model, label, score AS x FROM each JOIN chosen USING (model, aggregation)),{newton('summed', 'model')},
  called AS (SELECT model, label, 1 / (1 + exp(-(slope * x + "offset"))) AS score FROM summed JOIN platt USING (model)),
  points AS (SELECT model, score, sum(label) OVER w AS tp, count(*) OVER w - sum(label) OVER w AS fp, sum(label) OVER (PARTITION BY model) AS p, count(*) OVER (PARTITION BY model) - sum(label) OVER (PARTITION BY model) AS n
    FROM called WINDOW w AS (PARTITION BY model ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  best AS (SELECT model, arg_min(score, (-(tp * n - fp * p), score)) AS threshold, max(tp / p + 1 - fp / n) / 2 AS balanced_accuracy FROM points GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {BUNDLES}
SELECT model, aggregation, round(auroc, 6) AS auroc, round(slope, 5) AS slope, round("offset", 5) AS "offset", round(threshold, 5) AS threshold, round(balanced_accuracy, 6) AS balanced_accuracy,
  (SELECT count(*) FROM summed s WHERE s.model = chosen.model) AS videos FROM chosen JOIN platt USING (model) JOIN best USING (model)""")
def q_bundles(spark: SparkSession, d: str) -> DataFrame:
    rows = frames(spark, d).withColumn("model", F.col("k") % 3).withColumn("x", F.col("logit_a") + F.when(F.col("model") == 1, F.col("logit_b") / 4).otherwise(0))
    fitted = bundles.fit_bundles(rows, ["model"], "x", "video", "method", "domain", "ff").drop("version")
    return rounded(rounded(fitted, "auroc", "balanced_accuracy"), "slope", "offset", "threshold", places=5)


@query("""WITH crops AS (SELECT conv_id AS media_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'image' ELSE 'video' END AS kind, strlen(text) % 5 <> 0 AS good,
    CASE strlen(text) % 3 WHEN 0 THEN 'blurred' WHEN 1 THEN 'no_face' ELSE 'small' END AS reason, strlen(text) % 4 AS faces, (strlen(text) % 200 - 100) / 40.0::DOUBLE AS x FROM conversations),
  placed AS (SELECT *, row_number() OVER (PARTITION BY media_id, good ORDER BY x) AS r, count(*) OVER (PARTITION BY media_id, good) AS k FROM crops),
  media AS (SELECT media_id, kind, count(*) AS frames_sampled, count(*) FILTER (good) AS frames_scored, max(faces) AS max_faces, arg_min(reason, turn) FILTER (NOT good) AS first_reason,
    avg(x) FILTER (good AND r > floor(k * 0.2) AND r <= k - floor(k * 0.2)) AS x FROM placed GROUP BY ALL),
  counts AS (SELECT media_id, string_agg(reason || ':' || n, ',' ORDER BY reason) AS exclusions FROM (SELECT media_id, reason, count(*) AS n FROM crops WHERE NOT good GROUP BY ALL) GROUP BY ALL),
  decided AS (SELECT *, frames_scored >= CASE kind WHEN 'video' THEN 4 ELSE 1 END AS enough, 1 / (1 + exp(-(1.5 * x - 0.2))) AS p FROM media LEFT JOIN counts USING (media_id))
SELECT media_id, kind, CASE WHEN NOT enough THEN 'ABSTAIN' WHEN p >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS decision, CASE WHEN enough THEN round(p, 6) END AS probability, frames_sampled, frames_scored, max_faces,
  CASE WHEN NOT enough THEN CASE kind WHEN 'video' THEN 'too_few_faces' ELSE coalesce(first_reason, 'no_face') END END AS abstain_reason, CASE WHEN NOT enough THEN coalesce(exclusions, '') END AS exclusions FROM decided""")
def q_media_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Turns as crops of a medium each."""
    size = F.octet_length("text")
    good = size % 5 != 0
    crops = table(spark, d, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("frame"), F.when(F.col("conv_id") % 3 == 0, "image").otherwise("video").alias("kind"), F.when(good, "ok").otherwise("skipped").alias("status"),
        F.when(size % 3 == 0, "blurred").when(size % 3 == 1, "no_face").otherwise("small").alias("reason"), (size % 4).alias("faces"), F.when(good, (size % 200 - 100) / F.lit(40.0)).alias("logit"))
    told = spark.createDataFrame([("trimmed", 1.5, -0.2, 0.5)], "aggregation string, slope double, offset double, threshold double")
    out = bundles.decide_media(crops, told, [])
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("exclusions")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return rounded(out.drop("logit").withColumn("exclusions", listed), "probability")

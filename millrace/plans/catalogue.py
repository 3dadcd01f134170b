"""Queries of the relational operators over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars as s
from millrace.operators import audit, constraints, fusion, gates, graph, media, metrics, reporting, sampling
from millrace.plans.views import (
    AUROC, AVERAGE_PRECISION, EER, FRAMES, PAIRED, SAMPLES, TPR_AT_FPR, VIDEOS, curve, frames, samples, table, videos,
)
from millrace.sources.writers import content_digest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SLICES = ["domain", "slice_method"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Engines sum floats in different orders, so figures are rounded on both sides."""
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def paired(spark: SparkSession, d: str) -> DataFrame:
    return metrics.against_reals(frames(spark, d), "method", "domain")


def curve_of(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_table(paired(spark, d), SLICES)


# audit

@query(f"""WITH {SAMPLES}
SELECT c AS "column", value, count(*) AS n FROM (
  SELECT 'label' AS c, CASE WHEN label = '' THEN '<MISSING>' ELSE label END AS value FROM samples
  UNION ALL SELECT 'family', CASE WHEN family = '' THEN '<MISSING>' ELSE family END FROM samples) GROUP BY ALL""")
def q_value_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: audit.value_counts(samples(spark, d), c).select(F.lit(c).alias("column"), "value", "n")
    return one("label").unionByName(one("family"))


@query(f"""WITH {SAMPLES},
  x AS (SELECT CASE WHEN domain = '' THEN '<MISSING>' ELSE domain END AS a, CASE WHEN label = '' THEN '<MISSING>' ELSE label END AS b FROM samples)
SELECT l.a, r.b, count(x.a) AS n FROM (SELECT DISTINCT a FROM x) l CROSS JOIN (SELECT DISTINCT b FROM x) r LEFT JOIN x ON x.a = l.a AND x.b = r.b GROUP BY ALL""")
def q_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return audit.cross_table(samples(spark, d), "domain", "label")


@query(f"""WITH {SAMPLES}
SELECT 'label' AS "column", count(*) FILTER (label = '') AS n_missing FROM samples UNION ALL SELECT 'family', count(*) FILTER (family = '') FROM samples
UNION ALL SELECT 'domain', count(*) FILTER (coalesce(domain, '') = '') FROM samples UNION ALL SELECT 'source', count(*) FILTER (coalesce(source, '') = '') FROM samples""")
def q_missingness(spark: SparkSession, d: str) -> DataFrame:
    return audit.missingness(samples(spark, d), ["label", "family", "domain", "source"])


GROUPED = f"""{SAMPLES},
  grouped AS (SELECT KIND AS key, count(*) AS n, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits, count(DISTINCT split) > 1 AS crosses
    FROM samples GROUP BY KIND HAVING count(*) > 1)"""


@query(f"WITH {GROUPED.replace('KIND', 'exact')} SELECT * FROM grouped")
def q_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_groups(samples(spark, d), "exact")


@query(f"""WITH {GROUPED.replace('KIND', 'near')}
SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows, count(*) FILTER (crosses) AS cross_groups, coalesce(sum(n) FILTER (crosses), 0)::BIGINT AS cross_rows FROM grouped""")
def q_duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_summary(samples(spark, d), "near")


@query(f"""WITH {GROUPED.replace('KIND', 'exact')},
  head AS (SELECT * FROM grouped ORDER BY key LIMIT 20),
  ids AS (SELECT exact AS key, array_to_string(list_slice(list_sort(list(sample_id)), 1, 10), ',') AS ids FROM samples GROUP BY exact)
SELECT head.*, ids FROM head JOIN ids ON head.key = ids.key""")
def q_duplicate_examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_examples(samples(spark, d), "exact", "sample_id")


@query(f"WITH {GROUPED.replace('KIND', 'source')} SELECT key, n, splits FROM grouped WHERE crosses")
def q_group_overlap(spark: SparkSession, d: str) -> DataFrame:
    return audit.group_overlap(samples(spark, d), "source")


PURITY = f"""{SAMPLES},
  long AS (SELECT unnest(['domain', 'source', 'family', 'exact']) AS c, unnest([domain, source, family, exact]) AS v, label FROM samples WHERE label <> ''),
  counts AS (SELECT c, CASE WHEN v = '' THEN '<MISSING>' ELSE v END AS v, label, count(*) AS k FROM long GROUP BY ALL),
  by_value AS (SELECT c, v, max(k) AS best, sum(k) AS k FROM counts GROUP BY ALL),
  pure AS (SELECT c, sum(best) AS best, sum(k)::BIGINT AS n, count(*) AS n_values FROM by_value GROUP BY ALL),
  tops AS (SELECT c, max(k) AS top FROM (SELECT c, label, sum(k) AS k FROM counts GROUP BY ALL) GROUP BY ALL),
  purity AS (SELECT c AS "column", n, n_values, CASE WHEN n_values <= greatest(50, floor(0.2 * n)) THEN round(best / n, 8) END AS purity,
    CASE WHEN n_values <= greatest(50, floor(0.2 * n)) THEN round(top / n, 8) END AS majority,
    CASE WHEN n_values <= greatest(50, floor(0.2 * n)) THEN round(best / n - top / n, 8) END AS lift FROM pure JOIN tops USING (c))"""


@query(f"WITH {PURITY} SELECT * FROM purity")
def q_label_purity(spark: SparkSession, d: str) -> DataFrame:
    return audit.label_purity(samples(spark, d), ["domain", "source", "family", "exact"], "label")


@query(f"""WITH {PURITY},
  across AS (SELECT 'exact_duplicates_across' AS gate, (SELECT count(*) FROM (SELECT exact FROM samples GROUP BY exact HAVING count(DISTINCT split) > 1)) AS actual
    UNION ALL SELECT 'near_duplicates_across', (SELECT count(*) FROM (SELECT near FROM samples GROUP BY near HAVING count(DISTINCT split) > 1))
    UNION ALL SELECT 'groups_across:domain', (SELECT count(*) FROM (SELECT domain FROM samples GROUP BY domain HAVING count(DISTINCT split) > 1))
    UNION ALL SELECT 'groups_across:source', (SELECT count(*) FROM (SELECT source FROM samples GROUP BY source HAVING count(DISTINCT split) > 1))
    UNION ALL SELECT 'missing_label', (SELECT count(*) FROM samples WHERE label = '') UNION ALL SELECT 'missing_key', 0)
SELECT gate, actual::DOUBLE AS actual, 0.0::DOUBLE AS "limit", CASE WHEN actual > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM across
UNION ALL SELECT 'purity:' || "column", coalesce(purity, 0), 0.98::DOUBLE, CASE WHEN coalesce(purity >= 0.98 AND lift >= 0.05, false) THEN 'warn' ELSE 'pass' END
FROM purity WHERE "column" IN ('domain', 'source')""")
def q_quality_gates(spark: SparkSession, d: str) -> DataFrame:
    return audit.quality_gates(samples(spark, d), "sample_id", "label", "exact", "near", ["domain", "source"])


def _duplicates(column: str) -> str:
    made = GROUPED.replace("KIND", column).split("grouped AS ")[1]
    return f"""(SELECT count(*) AS n_groups, coalesce(sum(n), 0) AS n_rows, count(*) FILTER (crosses) AS cross_groups, coalesce(sum(n) FILTER (crosses), 0) AS cross_rows FROM {made})"""


def _overlap(column: str) -> str:
    return f"SELECT 'overlap:{column}', key, 'n', n FROM {GROUPED.replace('KIND', column).split('grouped AS ')[1]} WHERE crosses"


MISSING_OF_EACH = " UNION ALL ".join(
    f"SELECT 'missing', '{c}', 'n', count(*) FILTER (coalesce({c}::VARCHAR, '') = '') FROM samples" for c in ("sample_id", "label", "domain", "source", "family", "exact", "near", "split"))
REPORT = f"""WITH {PURITY}, gates AS ({SQL['q_quality_gates'].replace(f'WITH {PURITY},', 'WITH', 1)}),
  tokens AS (SELECT CASE WHEN split = '' THEN '<MISSING>' ELSE split END AS a, CASE WHEN label = '' THEN '<MISSING>' ELSE label END AS b FROM samples),
  report(section, key, metric, value) AS (
    {MISSING_OF_EACH}
    UNION ALL SELECT 'count:label', b, 'n', count(*) FROM tokens GROUP BY b
    UNION ALL SELECT 'count:split', a, 'n', count(*) FROM tokens GROUP BY a
    UNION ALL SELECT 'cross', l.a || '|' || r.b, 'n', count(t.a) FROM (SELECT DISTINCT a FROM tokens) l CROSS JOIN (SELECT DISTINCT b FROM tokens) r LEFT JOIN tokens t ON t.a = l.a AND t.b = r.b GROUP BY l.a, r.b
    UNION ALL SELECT 'duplicates:exact', '', unnest(['n_groups', 'n_rows', 'cross_groups', 'cross_rows']), unnest([n_groups, n_rows, cross_groups, cross_rows]) FROM {_duplicates('exact')}
    UNION ALL SELECT 'duplicates:near', '', unnest(['n_groups', 'n_rows', 'cross_groups', 'cross_rows']), unnest([n_groups, n_rows, cross_groups, cross_rows]) FROM {_duplicates('near')}
    UNION ALL {_overlap('domain')} UNION ALL {_overlap('source')}
    UNION ALL SELECT 'purity', "column", 'purity', purity FROM purity WHERE "column" IN ('domain', 'source')
    UNION ALL SELECT 'gate', gate, 'verdict', CASE verdict WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END FROM gates)
SELECT section, key, metric, value::DOUBLE AS value FROM report"""


@query(REPORT)
def q_audit_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_report(samples(spark, d), "sample_id", "label", "exact", "near", ["domain", "source"])


@query(f"WITH {SAMPLES} SELECT split, label, domain, count(*) AS n FROM samples GROUP BY ALL")
def q_selection_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.selection_counts(samples(spark, d), "split", "label", "domain")


# constraints

@query(f"""WITH {SAMPLES}, long AS (SELECT unnest(['exact', 'sample_id', 'label']) AS key_column, unnest([exact, sample_id::VARCHAR, label]) AS value FROM samples)
SELECT key_column, value, count(*) AS n FROM long GROUP BY ALL HAVING count(*) > 1 OR value = ''""")
def q_key_constraints(spark: SparkSession, d: str) -> DataFrame:
    return constraints.key_violations(samples(spark, d), "exact", "sample_id", "label")


@query(f"""WITH {SAMPLES}, long AS (SELECT unnest(['source', 'exact', 'family']) AS group_column, unnest([source, exact, family]) AS value, split FROM samples)
SELECT group_column, value, count(DISTINCT split) AS n_splits FROM long WHERE value <> '' GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def q_group_in_split(spark: SparkSession, d: str) -> DataFrame:
    return constraints.split_violations(samples(spark, d), ["source", "exact", "family"])


@query(f"WITH {SAMPLES} SELECT DISTINCT domain AS value FROM samples WHERE domain NOT IN ('en', 'de')")
def q_unexpected_values(spark: SparkSession, d: str) -> DataFrame:
    return constraints.unexpected_values(samples(spark, d), "domain", ["en", "de"])


@query("""WITH m AS (SELECT DISTINCT lower(trim(o_orderpriority)) AS method, o_orderstatus AS split FROM orders),
  w AS (SELECT * FROM (VALUES ('1-urgent', 'F'), ('2-high', 'O'), ('9-none', 'O')) t(method, split))
SELECT method, 'absent' AS problem FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.method = w.method AND m.split = w.split)
UNION ALL SELECT method, 'in another split' FROM m WHERE method IN (SELECT method FROM w) AND NOT EXISTS (SELECT 1 FROM w WHERE m.method = w.method AND m.split = w.split)""")
def q_method_protocol(spark: SparkSession, d: str) -> DataFrame:
    return constraints.method_violations(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", {"F": ["1-urgent"], "O": ["2-high", "9-none"]})


@query(f"""WITH {SAMPLES}, b AS (SELECT exact, count(DISTINCT label || '|' || split) AS n FROM samples GROUP BY exact),
  f AS (SELECT exact, arg_min(sample_id, sample_id) AS sample_id FROM samples GROUP BY exact)
SELECT f.exact, f.sample_id, CASE WHEN b.n > 1 THEN b.n ELSE 0 END AS n_facts FROM f JOIN b ON f.exact = b.exact""")
def q_dedup_conflict(spark: SparkSession, d: str) -> DataFrame:
    first, bad = constraints.conflicting_duplicates(samples(spark, d), "exact", ["label", "split"], ["sample_id"])
    return first.join(bad, "exact", "left").select("exact", "sample_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_facts"))


# projections

@query("SELECT page_id, sha256('pages' || chr(0) || 'v1' || chr(0) || page_id) AS sample_id, sha256(html) AS content FROM pages")
def q_sample_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", s.digest(F.lit("pages"), F.lit("v1"), "page_id").alias("sample_id"), F.sha2("html", 256).alias("content"))


@query("""WITH p AS (SELECT page_id, 'images/' || regexp_extract(url, '^https?://([^/]+)', 1) || '/' || substr(sha256(url), 1, 12) || '_' || page_id || '.html' AS path FROM pages)
SELECT page_id, path, substr(sha256(path), 1, 24) AS image_id FROM p""")
def q_portable_path(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    path = F.concat(F.lit("images/"), host, F.lit("/"), s.short_digest(12, "url"), F.lit("_"), F.col("page_id"), F.lit(".html"))
    return table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("image_id", s.short_digest(24, "path"))


@query(f"""WITH {SAMPLES} SELECT sample_id, CASE WHEN family <> '' THEN 'family:' || family WHEN label <> '' THEN 'label:' || label ELSE 'sample_id:' || sample_id END AS group_key FROM samples""")
def q_group_key(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("sample_id", s.group_key(["family", "label"], "sample_id").alias("group_key"))


@query("""WITH r AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE (page_id * 4)::VARCHAR END AS stem FROM pages),
  i AS (SELECT (doc_id % 900)::VARCHAR AS stem, count(*) AS n FROM documents GROUP BY ALL)
SELECT page_id, CASE WHEN r.stem = '' THEN 'missing_path_value' WHEN n IS NULL THEN 'missing_file' WHEN n > 1 THEN 'ambiguous_path' ELSE 'ok' END AS status
FROM r LEFT JOIN i ON r.stem = i.stem""")
def q_path_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, "").otherwise((F.col("page_id") * 4).cast("string")).alias("stem"))
    index = table(spark, d, "documents").groupBy((F.col("doc_id") % 900).cast("string").alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    return gates.path_status(rows, "page_id", "stem", index)


@query("SELECT o_orderkey, coalesce(try_cast(regexp_extract('clip_' || o_orderkey, '([0-9]+)$', 1) AS BIGINT), 0) AS frame, o_custkey % 5 = 0 AS unsafe FROM orders")
def q_frame_index(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("a/clip_"), F.col("o_orderkey"), F.lit(".png"))
    path = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("../"), name)).otherwise(name)
    return table(spark, d, "orders").select("o_orderkey", s.frame_index(name, F.lit(0).cast("long")).alias("frame"), s.unsafe_path(path).alias("unsafe"))


@query("SELECT 'k' AS key, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events")
def q_nested_json(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").select(F.parse_json("props").alias("node")).createOrReplaceTempView("millrace_props")
    each = spark.sql("SELECT t.key, CAST(t.value AS BIGINT) AS v FROM millrace_props, LATERAL variant_explode(node) t")
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


# sampling

@query(f"WITH {SAMPLES} SELECT split, domain, count(*) AS n FROM samples GROUP BY ALL")
def q_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("split", "domain").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('rank-v1' || chr(0) || c_custkey), c_custkey)::INT AS rank
FROM customer QUALIFY rank <= 3""")
def q_hash_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    ranked = sampling.stable_rank(table(spark, d, "customer"), "rank-v1", "c_custkey", ["c_nationkey"])
    return ranked.where("rank <= 3").select("c_nationkey", "c_custkey", "rank")


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, position FROM n WHERE k <= 4 OR list_contains(list_transform([0, 1, 2, 3], lambda i: round_even(i * (k - 1) / 3.0::DOUBLE, 0)::BIGINT), position)""")
def q_even_frames(spark: SparkSession, d: str) -> DataFrame:
    return sampling.even_rows(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], 4).select("conv_id", "turn", "position")


QUOTA = """
  sizes AS (SELECT o_orderstatus, o_orderpriority, o_custkey, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256('quota-v1' || chr(0) || o_custkey), o_custkey)::INT AS rank FROM sizes),
  taken AS (SELECT *, coalesce(sum(least(n, 2)) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked),
  fakes AS (SELECT o_orderstatus, o_orderpriority, o_custkey, n, rank, least(least(n, 2), IMAGES - before)::BIGINT AS take FROM taken WHERE before < IMAGES)"""


def fakes_of(spark: SparkSession, d: str, images: int) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    return sampling.quota_groups(rows, ["o_orderstatus", "o_orderpriority"], "o_custkey", "quota-v1", images, 2)


@query(f"WITH {QUOTA.replace('IMAGES', '150')} SELECT * FROM fakes")
def q_quota_fake(spark: SparkSession, d: str) -> DataFrame:
    return fakes_of(spark, d, 150)


@query(f"""WITH {QUOTA.replace('IMAGES', '150')},
  target AS (SELECT o_orderstatus, ceil(sum(take) * 0.5)::BIGINT AS target FROM fakes GROUP BY ALL),
  rsizes AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY ALL),
  rranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('quota-v1' || chr(0) || 'real' || chr(0) || o_orderstatus || chr(0) || o_custkey), o_custkey)::INT AS rank FROM rsizes),
  rtaken AS (SELECT *, coalesce(sum(least(n, 2)) OVER (PARTITION BY o_orderstatus ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rranked)
SELECT o_orderstatus, o_custkey, n, rank, least(least(n, 2), target - before)::BIGINT AS take FROM rtaken JOIN target USING (o_orderstatus) WHERE before < target""")
def q_quota_real_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderpriority = '5-LOW'")
    return sampling.real_quota(fakes_of(spark, d, 150), rows, ["o_orderstatus"], "o_custkey", "quota-v1", 0.5, 2)


@query(f"""WITH {QUOTA.replace('IMAGES', '1100')}
SELECT o_orderstatus, o_orderpriority, sum(take)::BIGINT AS taken, (1100 - sum(take))::BIGINT AS missing FROM fakes GROUP BY ALL HAVING sum(take) < 1100""")
def q_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shortfalls(fakes_of(spark, d, 1100), ["o_orderstatus", "o_orderpriority"], 1100)


SUBSET = """WITH r AS (SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'REAL' ELSE 'FAKE' END AS label, o_orderstatus AS split, o_orderpriority AS method, o_custkey AS g, o_orderkey AS frame FROM orders),
  sizes AS (SELECT split, method, g, count(*) AS n FROM r WHERE label = 'FAKE' GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY split, method ORDER BY sha256('subset-v1' || chr(0) || g), g) AS rank FROM sizes),
  taken AS (SELECT *, coalesce(sum(least(n, 2)) OVER (PARTITION BY split, method ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked),
  fakes AS (SELECT split, method, g, least(least(n, 2), 150 - before)::BIGINT AS take FROM taken WHERE before < 150),
  target AS (SELECT split, ceil(sum(take) * 0.5)::BIGINT AS target FROM fakes GROUP BY ALL),
  rsizes AS (SELECT split, g, count(*) AS n FROM r WHERE label = 'REAL' GROUP BY ALL),
  rranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('subset-v1' || chr(0) || 'real' || chr(0) || split || chr(0) || g), g) AS rank FROM rsizes),
  rtaken AS (SELECT *, coalesce(sum(least(n, 2)) OVER (PARTITION BY split ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rranked),
  reals AS (SELECT split, g, least(least(n, 2), target - before)::BIGINT AS take FROM rtaken JOIN target USING (split) WHERE before < target),
  chosen AS (SELECT r.*, take, 'fake' AS selection_role FROM r JOIN fakes f ON r.split = f.split AND r.method = f.method AND r.g = f.g WHERE label = 'FAKE'
    UNION ALL SELECT r.*, take, 'real' FROM r JOIN reals f ON r.split = f.split AND r.g = f.g WHERE label = 'REAL'),
  placed AS (SELECT *, row_number() OVER (PARTITION BY selection_role, split, CASE selection_role WHEN 'fake' THEN method END, g ORDER BY frame) - 1 AS p,
    count(*) OVER (PARTITION BY selection_role, split, CASE selection_role WHEN 'fake' THEN method END, g) AS k FROM chosen)
SELECT label, split, method, g AS "group", frame, selection_role FROM placed
WHERE k <= take OR CASE take WHEN 1 THEN p = k // 2 ELSE list_contains(list_transform(range(take), lambda i: round_even(i * (k - 1) / (take - 1)::DOUBLE, 0)::BIGINT), p) END"""


@query(SUBSET)
def q_build_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "REAL").otherwise("FAKE").alias("label"), F.col("o_orderstatus").alias("split"),
        F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("frame"))
    return sampling.build_subset(rows, sampling.SubsetSpec("subset-v1", 150, 2, ratio=0.5))


WEIGHTS = f"""{FRAMES},
  cells AS (SELECT label, method, video, count(*) AS n FROM frames GROUP BY ALL),
  weights AS (SELECT label, method, video, n, 0.5::DOUBLE / count_methods / count_groups / n AS weight FROM cells
    JOIN (SELECT label, method, count(*) AS count_groups FROM cells GROUP BY ALL) USING (label, method)
    JOIN (SELECT label, count(DISTINCT method) AS count_methods FROM cells GROUP BY ALL) USING (label))"""


@query(f"WITH {WEIGHTS} SELECT label, method, video, n, round(weight, 10) AS weight FROM weights")
def q_sampling_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.sampling_weights(frames(spark, d), "label", "method", "video"), "weight", places=10)


@query(f"""WITH {WEIGHTS},
  keyed AS (SELECT method || '/' || video AS key, weight * n AS w FROM weights),
  runs AS (SELECT *, ('0x' || substr(sha256(key), 1, 2))::INT AS run FROM keyed),
  spans AS (SELECT key, sum(w) OVER (ORDER BY run, key) AS hi, sum(w) OVER (ORDER BY run, key) - w AS lo, sum(w) OVER () AS total FROM runs),
  numbers AS (SELECT i AS draw, ('0x' || substr(sha256('draw-v1' || chr(0) || i), 1, 12))::BIGINT / (16.0::DOUBLE ^ 12) AS u FROM range(300) t(i))
SELECT draw, key FROM numbers JOIN spans ON u * total >= lo AND u * total < hi""")
def q_weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    weights = sampling.sampling_weights(frames(spark, d), "label", "method", "video")
    keyed = weights.select(F.concat_ws("/", "method", F.col("video").cast("string")).alias("key"), (F.col("weight") * F.col("n")).alias("w"))
    return sampling.weighted_draw(keyed, "key", "w", 300, "draw-v1")


@query(f"""WITH {SAMPLES},
  long AS (SELECT split, source, CASE split WHEN 'test' THEN 3 ELSE 2 END AS p, unnest(['exact', 'near']) AS kind, unnest([exact, near]) AS key FROM samples),
  held AS (SELECT kind, key, max(p) AS best FROM long GROUP BY ALL HAVING max(p) > min(p))
SELECT DISTINCT split, source FROM long JOIN held USING (kind, key) WHERE p < best""")
def q_prune_cross_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.prune_cross_split(samples(spark, d), ["exact", "near"], {"test": 3, "validation": 2, "train": 1}, group="source")


TOKENS = f"""{FRAMES},
  users AS (SELECT DISTINCT video, lineage FROM frames),
  links AS (SELECT DISTINCT list_min(lineage) AS a, unnest(lineage) AS b FROM users),
  both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT b AS node, b AS label FROM both_ways UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON r.node = e.a),
  roots AS (SELECT node, min(label) AS root FROM reach GROUP BY ALL),
  rooted AS (SELECT video, root FROM users JOIN roots ON node = list_min(lineage))"""


@query(f"WITH RECURSIVE {TOKENS} SELECT * FROM rooted")
def q_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.token_components(frames(spark, d).select("video", "lineage").distinct(), "video", "lineage")


@query(f"""WITH RECURSIVE {TOKENS}, drawn AS (SELECT *, ('0x' || substr(sha256('parts-v1' || chr(0) || root), 1, 12))::BIGINT / (16.0::DOUBLE ^ 12) AS u FROM rooted)
SELECT video, root, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split FROM drawn""")
def q_entity_partition(spark: SparkSession, d: str) -> DataFrame:
    return sampling.entity_partition(frames(spark, d), "video", "lineage", "parts-v1", [("train", 0.6), ("validation", 0.2), ("test", 0.2)])


# links and gates

NAMED = f"""{FRAMES},
  named AS (SELECT DISTINCT 'id' || video || '_id' || (video + 7) || '_xid5' AS name, video, label, domain,
    CASE WHEN substr(sha256('split-v1' || chr(0) || video), 1, 1) < '8' THEN 'validation' ELSE 'test' END AS split FROM frames),
  tokened AS (SELECT *, list_distinct(regexp_extract_all(name, '(^|[^A-Za-z0-9])(id[0-9]+)', 2)) AS tokens FROM named)"""


def named(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("id"), F.col("video"), F.lit("_id"), F.col("video") + 7, F.lit("_xid5"))
    rows = frames(spark, d).select(name.alias("name"), "video", "label", "domain", s.hash_split("split-v1", "video").alias("split")).distinct()
    return rows.withColumn("tokens", s.identity_tokens(F.col("name")))


@query(f"""WITH {NAMED}, t AS (SELECT split, count(DISTINCT token) AS n_tokens FROM (SELECT split, unnest(tokens) AS token FROM tokened) GROUP BY ALL)
SELECT split, count(*) AS n_rows, count(*) FILTER (len(tokens) > 0) AS n_with, any_value(n_tokens) AS n_tokens FROM tokened JOIN t USING (split) GROUP BY split""")
def q_identity_tokens(spark: SparkSession, d: str) -> DataFrame:
    return gates.token_coverage(named(spark, d), "tokens")


@query(f"""WITH {NAMED}, each AS (SELECT DISTINCT name, split, label, unnest(tokens) AS token FROM tokened),
  pairs AS (SELECT token FROM each GROUP BY token HAVING count(DISTINCT split) = 2)
SELECT 'test' AS split_a, 'validation' AS split_b, label, (SELECT count(*) FROM pairs) AS n_tokens, count(DISTINCT name) AS n_rows
FROM each JOIN pairs USING (token) GROUP BY label""")
def q_shared_tokens(spark: SparkSession, d: str) -> DataFrame:
    return gates.shared_tokens(named(spark, d), "name", "tokens")


LINKS = f"""{NAMED},
  links AS (SELECT DISTINCT video, label, split, 'video' AS kind, domain || ':' || video AS key FROM tokened
    UNION SELECT DISTINCT video, label, split, 'identity', unnest(tokens) FROM tokened
    UNION SELECT DISTINCT video, label, split, 'parent', domain || ':' || (video // 6) FROM tokened)"""


def links_of(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.array(F.concat(F.col("domain"), F.lit(":"), c))
    return gates.row_links(named(spark, d), ["video", "label", "split"], {
        "video": key(F.col("video")), "identity": F.col("tokens"), "parent": key(F.floor(F.col("video") / 6))}).distinct()


@query(f"WITH {LINKS} SELECT kind, split, count(*) AS n, count(DISTINCT key) AS n_keys FROM links GROUP BY ALL")
def q_row_links(spark: SparkSession, d: str) -> DataFrame:
    return links_of(spark, d).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


@query(f"WITH {LINKS} SELECT kind, key, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits FROM links GROUP BY kind, key HAVING count(DISTINCT split) > 1")
def q_cross_split_links(spark: SparkSession, d: str) -> DataFrame:
    return gates.cross_split_links(links_of(spark, d))


@query(f"""WITH {LINKS}, f AS (SELECT DISTINCT kind, key FROM links WHERE split = 'validation')
SELECT DISTINCT video, kind FROM links JOIN f USING (kind, key) WHERE split = 'test'""")
def q_heldout_semijoin(spark: SparkSession, d: str) -> DataFrame:
    links = links_of(spark, d)
    return gates.forbidden_rows(links.where("split = 'test'"), links.where("split = 'validation'"), ["video"])


@query(f"""WITH {FRAMES},
  owned AS (SELECT DISTINCT unnest(lineage) AS entity FROM frames WHERE video % 10 = 3),
  bad AS (SELECT DISTINCT video FROM (SELECT video, unnest(lineage) AS entity FROM frames) WHERE entity IN (SELECT entity FROM owned)),
  reasons AS (SELECT CASE WHEN frames.video IN (SELECT video FROM bad) THEN 'entity' WHEN k = 7 THEN 'content_collision' WHEN video % 11 = 0 THEN 'excluded' ELSE '' END AS reason FROM frames)
SELECT reason, count(*) AS n FROM reasons GROUP BY ALL""")
def q_heldout_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = frames(spark, d)
    owned = rows.where("video % 10 = 3").select(F.explode("lineage").alias("entity"))
    out = gates.heldout_cascade(rows, "sample_id", "lineage", owned, [("content_collision", F.col("k") == 7), ("excluded", F.col("video") % 11 == 0)])
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FRAMES}, t AS (SELECT * FROM (VALUES ('ff', 'click', 60), ('ff', 'view', 90), ('cdf', 'none', 5)) x(domain, method, target)),
  f AS (SELECT domain, method, count(DISTINCT video) AS found FROM frames GROUP BY ALL)
SELECT domain, method, target::BIGINT AS target, coalesce(found, 0) AS found, greatest(target - coalesce(found, 0), 0)::BIGINT AS missing FROM t LEFT JOIN f USING (domain, method)""")
def q_cell_targets(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("ff", "click", 60), ("ff", "view", 90), ("cdf", "none", 5)], "domain string, method string, target long")
    return gates.cell_targets(frames(spark, d), ["domain", "method"], "video", targets)


# metrics

CURVE = PAIRED + curve("paired", "domain, slice_method")


@query(f"WITH {CURVE} SELECT domain, slice_method, round({AUROC}, 6) AS auroc FROM curve GROUP BY ALL")
def q_auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auroc(curve_of(spark, d), SLICES), "auroc")


@query(f"WITH {CURVE} SELECT domain, slice_method, round({AVERAGE_PRECISION}, 6) AS average_precision FROM curve GROUP BY ALL")
def q_ap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(curve_of(spark, d), SLICES), "average_precision")


@query(f"WITH {CURVE} SELECT domain, slice_method, round({TPR_AT_FPR}, 6) AS tpr_at_fpr FROM curve GROUP BY ALL")
def q_tpr_fpr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.tpr_at_fpr(curve_of(spark, d), SLICES, 0.05), "tpr_at_fpr")


@query(f"WITH {CURVE}{EER} SELECT domain, slice_method, round(eer, 6) AS eer FROM eers")
def q_eer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.equal_error_rate(curve_of(spark, d), SLICES), "eer")


CALIBRATION = """
  bins AS (SELECT domain, slice_method, least(floor(score * 10), 9) AS bin, count(*) AS k, sum(score) AS s, sum(label) AS y, sum((score - label) ^ 2) AS q FROM paired GROUP BY ALL),
  calibrated AS (SELECT domain, slice_method, sum(q) / sum(k) AS brier, sum(abs(s - y)) / sum(k) AS ece FROM bins GROUP BY ALL)"""


@query(f"WITH {PAIRED},{CALIBRATION} SELECT domain, slice_method, round(brier, 6) AS brier, round(ece, 6) AS ece FROM calibrated")
def q_calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration(paired(spark, d), SLICES), "brier", "ece")


AT_THRESHOLD = """
  decided AS (SELECT domain, slice_method, 2.0::DOUBLE * count(*) FILTER (score >= 0.7 AND label = 1) / (count(*) FILTER (score >= 0.7) + count(*) FILTER (label = 1)) AS f1,
    (count(*) FILTER (score >= 0.7 AND label = 1) / count(*) FILTER (label = 1) + count(*) FILTER (score < 0.7 AND label = 0) / count(*) FILTER (label = 0)) / 2 AS balanced_accuracy FROM paired GROUP BY ALL)"""


@query(f"WITH {PAIRED},{AT_THRESHOLD} SELECT domain, slice_method, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM decided")
def q_f1_bacc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.at_threshold(paired(spark, d), SLICES, 0.7), "f1", "balanced_accuracy")


@query(f"""WITH {CURVE}, v AS (SELECT *, (tp / p + 1 - fp / n) / 2 AS v FROM curve)
SELECT domain, slice_method, round(score, 6) AS threshold, round(v, 6) AS balanced_accuracy FROM v QUALIFY row_number() OVER (PARTITION BY domain, slice_method ORDER BY tp * n - fp * p DESC, score) = 1""")
def q_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.best_threshold(curve_of(spark, d), SLICES), "threshold", "balanced_accuracy")


@query(f"""WITH {CURVE}{EER},{CALIBRATION},{AT_THRESHOLD},
  ranks AS (SELECT domain, slice_method, {AUROC} AS auroc, {AVERAGE_PRECISION} AS average_precision, {TPR_AT_FPR} AS tpr_at_fpr FROM curve GROUP BY ALL)
SELECT domain, slice_method, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(tpr_at_fpr, 6) AS tpr_at_fpr, round(eer, 6) AS eer,
  round(brier, 6) AS brier, round(ece, 6) AS ece, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy
FROM ranks JOIN eers USING (domain, slice_method) JOIN calibrated USING (domain, slice_method) JOIN decided USING (domain, slice_method)""")
def q_metric_report(spark: SparkSession, d: str) -> DataFrame:
    report = metrics.metric_report(paired(spark, d), SLICES, 0.7, budget=0.05)
    return rounded(report, *[c for c in report.columns if c not in SLICES])


@query(f"""WITH {CURVE}{EER},
  ranks AS (SELECT domain, slice_method, {AUROC} AS auroc, {AVERAGE_PRECISION} AS average_precision, {TPR_AT_FPR} AS tpr_at_fpr FROM curve GROUP BY ALL),
  every AS (SELECT * FROM ranks JOIN eers USING (domain, slice_method)),
  both_kinds AS (SELECT * FROM every UNION ALL SELECT domain, 'macro', avg(auroc), avg(average_precision), avg(tpr_at_fpr), avg(eer) FROM every GROUP BY domain)
SELECT domain, slice_method, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(tpr_at_fpr, 6) AS tpr_at_fpr, round(eer, 6) AS eer FROM both_kinds""")
def q_macro_by_method(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.macro_by_method(frames(spark, d), "method", "domain", budget=0.05), "auroc", "average_precision", "tpr_at_fpr", "eer")


@query(f"WITH {FRAMES} SELECT method, round(avg((score >= 0.7)::INT), 6) AS recall FROM frames WHERE label = 1 GROUP BY ALL")
def q_fake_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.fake_recall(frames(spark, d), ["method"], 0.7), "recall")


@query(f"WITH {FRAMES} SELECT domain, method, video, label, round(avg(score), 6) AS score, count(*) AS frames FROM frames GROUP BY ALL")
def q_video_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.video_scores(frames(spark, d), ["domain", "method", "video", "label"]), "score")


@query(f"""WITH {FRAMES},
  r AS (SELECT method, video, logit_a AS x, row_number() OVER (PARTITION BY method, video ORDER BY logit_a) AS r, count(*) OVER (PARTITION BY method, video) AS k FROM frames),
  g AS (SELECT method, video, avg(1 / (1 + exp(-x))) AS p, avg(x) AS mean, median(x) AS median, avg(x) FILTER (r > floor(k * 0.2) AND r <= k - floor(k * 0.2)) AS trimmed,
    avg(x) FILTER (r > k - greatest(1, ceil(k * 0.25))) AS top_quarter FROM r GROUP BY ALL)
SELECT method, video, round(ln(p / (1 - p)), 6) AS mean_probability, round(mean, 6) AS mean, round(median, 6) AS median, round(trimmed, 6) AS trimmed, round(top_quarter, 6) AS top_quarter FROM g""")
def q_video_robust(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.robust_logits(frames(spark, d), ["method", "video"], "logit_a"), "mean_probability", "mean", "median", "trimmed", "top_quarter")


@query(f"""WITH {FRAMES},
  shifted AS (SELECT domain, label, s AS corruption, CASE s WHEN 'clean' THEN score ELSE 1 / (1 + exp(-(logit_a + CASE s WHEN 'noise' THEN 0.5 ELSE 1.0 END * logit_b))) END AS score
    FROM frames CROSS JOIN (VALUES ('clean'), ('noise'), ('blur')) t(s)){curve('shifted', 'domain, corruption')},
  areas AS (SELECT domain, corruption, {AUROC} AS auroc FROM curve GROUP BY ALL)
SELECT a.domain, a.corruption, round(a.auroc, 6) AS auroc, round(c.auroc - a.auroc, 6) AS drop FROM areas a JOIN areas c ON a.domain = c.domain AND c.corruption = 'clean'""")
def q_robustness(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.explode(F.create_map(F.lit("clean"), F.lit(0.0), F.lit("noise"), F.lit(0.5), F.lit("blur"), F.lit(1.0))).alias("corruption", "x")
    rows = frames(spark, d).select("domain", "label", "logit_a", "logit_b", kinds).withColumn("score", s.sigmoid(F.col("logit_a") + F.col("x") * F.col("logit_b")))
    return rounded(metrics.robustness(rows, ["domain"], "corruption", "clean"), "auroc", "drop")


@query(f"""WITH {FRAMES}, seeds AS (SELECT domain, method, k % 3 AS seed, avg(score) AS v FROM frames GROUP BY ALL)
SELECT domain, method, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) AS low, round(max(v), 6) AS high, count(v) AS n_seeds FROM seeds GROUP BY ALL""")
def q_seed_spread(spark: SparkSession, d: str) -> DataFrame:
    seeds = frames(spark, d).groupBy("domain", "method", (F.col("k") % 3).alias("seed")).agg(F.avg("score").alias("v"))
    return rounded(metrics.spread(seeds, ["domain", "method"], "v"), "mean", "sd", "low", "high")


# fusion

@query(f"WITH {FRAMES} SELECT sample_id, domain, method, label, round(1 / (1 + exp(-(0.3 * logit_a + 0.7 * logit_b))), 6) AS score FROM frames")
def q_align_blend(spark: SparkSession, d: str) -> DataFrame:
    rows = frames(spark, d)
    keys = ["domain", "method", "label"]
    met = fusion.align(rows.select("sample_id", *keys, F.col("logit_a").alias("logit")), rows.select("sample_id", *keys, F.col("logit_b").alias("logit")), "sample_id", keys, ["logit"])
    return met.select("sample_id", *keys, F.round(s.sigmoid(fusion.blend(F.col("logit_left"), F.col("logit_right"), 0.3)), 6).alias("score"))


@query(f"""WITH {PAIRED},
  grid AS (SELECT i / 20.0::DOUBLE AS weight, domain, slice_method, label, 1 / (1 + exp(-(i / 20.0::DOUBLE * logit_a + (1 - i / 20.0::DOUBLE) * logit_b))) AS score FROM paired, range(21) t(i)){curve('grid', 'weight, domain, slice_method')},
  areas AS (SELECT domain, weight, {AUROC} AS a FROM curve GROUP BY weight, domain, slice_method),
  macro AS (SELECT domain, weight, avg(a) AS auroc FROM areas GROUP BY ALL),
  best AS (SELECT weight FROM macro WHERE domain = 'ff' ORDER BY round(auroc, 12) DESC, abs(weight - 0.5), weight LIMIT 1)
SELECT domain, weight, round(auroc, 6) AS auroc, weight = (SELECT weight FROM best) AS chosen FROM macro""")
def q_weight_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.weight_grid(frames(spark, d), "logit_a", "logit_b", "method", "domain", "ff"), "auroc")


@query(f"""WITH {FRAMES}, r AS (SELECT (score >= 0.5) = (label = 1) AS a, (score_b >= 0.5) = (label = 1) AS b FROM frames)
SELECT count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (b AND NOT a) AS right_only, count(*) FILTER (a AND b) AS "both", count(*) FILTER (NOT a AND NOT b) AS neither FROM r""")
def q_complementarity(spark: SparkSession, d: str) -> DataFrame:
    return fusion.complementarity(frames(spark, d), "score", "score_b")


#: Newton steps from the start that the operator takes; the optimum doesn't depend on the way to it.
@query(f"""WITH RECURSIVE {FRAMES},
  steps AS (
    SELECT 0 AS step, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b
    UNION ALL
    SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
      SELECT step, a, b, sum((p - label) * x) AS ga, sum(p - label) AS gb, sum(p * (1 - p) * x * x) + 1e-9 AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) + 1e-9 AS hbb
      FROM (SELECT s.*, f.logit_a AS x, f.label, 1 / (1 + exp(-(s.a * f.logit_a + s.b))) AS p FROM steps s, frames f WHERE s.step < 20) GROUP BY ALL))
SELECT round(a, 5) AS slope, round(b, 5) AS "offset" FROM steps WHERE step = 20""")
def q_platt(spark: SparkSession, d: str) -> DataFrame:
    slope, offset = fusion.fit_platt(frames(spark, d), "logit_a")
    return spark.createDataFrame([(round(slope, 5), round(offset, 5))], "slope double, offset double")


DECIDED = f"""{FRAMES},
  v AS (SELECT method, video, label, avg(logit_a) AS x, count(*) AS n FROM frames GROUP BY ALL),
  decided AS (SELECT method, video, label, n, CASE WHEN n >= 12 THEN 1 / (1 + exp(-(1.5 * x - 1.2))) END AS probability FROM v),
  called AS (SELECT *, CASE WHEN probability IS NULL THEN 'ABSTAIN' WHEN probability >= 0.6 THEN 'FAKE' ELSE 'REAL' END AS decision FROM decided)"""


def decided(spark: SparkSession, d: str) -> DataFrame:
    v = frames(spark, d).groupBy("method", "video", "label").agg(F.avg("logit_a").alias("x"), F.count(F.lit(1)).alias("n"))
    return fusion.decide(v, "x", "n", 1.5, -1.2, 0.6, 12)


@query(f"WITH {DECIDED} SELECT method, video, label, n, round(probability, 6) AS probability, decision FROM called")
def q_decide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decided(spark, d).select("method", "video", "label", "n", "probability", "decision"), "probability")


@query(f"""WITH {DECIDED} SELECT method, count(*) FILTER (decision = 'FAKE') AS fake, count(*) FILTER (decision = 'REAL') AS real, count(*) FILTER (decision = 'ABSTAIN') AS abstain,
  round(count(*) FILTER (decision = CASE label WHEN 1 THEN 'FAKE' ELSE 'REAL' END) / greatest(1, count(*) FILTER (decision <> 'ABSTAIN')), 6) AS accuracy FROM called GROUP BY ALL""")
def q_decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.decision_counts(decided(spark, d), "label", ["method"]), "accuracy")


BOOTSTRAP = f"""{VIDEOS},
  tokens AS (SELECT DISTINCT domain || chr(0) || list_min(lineage) AS a, domain || chr(0) || unnest(lineage) AS b FROM videos),
  both_ways AS (SELECT a, b FROM tokens UNION SELECT b, a FROM tokens),
  reach AS (SELECT b AS node, b AS label FROM both_ways UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON r.node = e.a),
  roots AS (SELECT node, min(label) AS root FROM reach GROUP BY ALL),
  slots AS (SELECT domain, root, row_number() OVER (PARTITION BY domain ORDER BY substr(sha256(domain || chr(0) || root), 1, 2), root) - 1 AS slot, count(*) OVER (PARTITION BY domain) AS size
    FROM (SELECT DISTINCT split_part(root, chr(0), 1) AS domain, root FROM roots)),
  picks AS (SELECT domain, i AS replicate, ('0x' || substr(sha256('boot-v1' || chr(0) || domain || chr(0) || i || chr(0) || slot), 1, 12))::BIGINT % size AS slot FROM slots, range(2000) t(i)),
  draws AS (SELECT replicate, root, count(*) AS times FROM picks JOIN slots USING (domain, slot) GROUP BY ALL),
  draws0 AS (SELECT * FROM draws UNION ALL SELECT -1, root, 1 FROM slots),
  vm AS (SELECT DISTINCT domain, method AS slice_method FROM videos WHERE label = 1),
  vp AS (SELECT *, method AS slice_method FROM videos WHERE label = 1 UNION ALL SELECT v.*, m.slice_method FROM videos v JOIN vm m ON v.domain = m.domain WHERE v.label = 0),
  rows0 AS (SELECT replicate, times, domain, slice_method, label, unnest(['base', 'candidate']) AS model, unnest([base, candidate]) AS score
    FROM vp JOIN roots ON node = domain || chr(0) || list_min(lineage) JOIN draws0 USING (root)){curve('rows0', 'replicate, domain, slice_method, model', 'times')},
  areas AS (SELECT replicate, domain, slice_method, model, CASE WHEN max(p) > 0 AND max(n) > 0 THEN {AUROC} END AS a FROM curve GROUP BY ALL),
  sides AS (SELECT replicate, domain, slice_method, max(a) FILTER (model = 'base') AS b, max(a) FILTER (model = 'candidate') AS c FROM areas GROUP BY ALL),
  macros AS (SELECT replicate, domain, avg(c) - avg(b) AS diff, count(b) AS methods FROM sides GROUP BY ALL),
  ends AS (SELECT r.domain, list_sort(list(r.diff)) AS d, count(*) AS valid FROM macros r JOIN macros w ON w.replicate = -1 AND w.domain = r.domain AND w.methods = r.methods
    WHERE r.replicate >= 0 GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {BOOTSTRAP}
SELECT domain, round(diff, 6) AS diff, round(d[floor(0.025 * (valid - 1))::INT + 1], 6) AS low, round(d[ceil(0.975 * (valid - 1))::INT + 1], 6) AS high, valid,
  diff >= 0.05 AND d[floor(0.025 * (valid - 1))::INT + 1] > 0 AS clear FROM macros JOIN ends USING (domain) WHERE replicate = -1""")
def q_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.bootstrap_difference(videos(spark, d), "base", "candidate", "method", "domain", "lineage", 2000, "boot-v1"), "diff", "low", "high")


@query(f"""WITH {FRAMES}, x AS (SELECT k % 3 AS seed, domain, avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0) AS diff FROM frames GROUP BY ALL),
  s AS (SELECT seed, max(diff - 0.001) > 0 AS gain, coalesce(min(diff) FILTER (domain = 'ff'), '-inf'::DOUBLE) AS main FROM x GROUP BY ALL)
SELECT count(*) FILTER (gain AND main >= -0.01) AS passed, count(*) AS seeds, count(*) FILTER (gain AND main >= -0.01) * 2 > count(*) AS verdict FROM s""")
def q_verdict(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("score")))
    pairs = frames(spark, d).groupBy((F.col("k") % 3).alias("seed"), "domain").agg((mean(1) - mean(0)).alias("diff"))
    return fusion.verdict(pairs.withColumn("low", F.col("diff") - 0.001), "ff")


# content

@query("""WITH h AS (SELECT vec_id, array_to_string(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN '1' ELSE '0' END), '') AS bits FROM embeddings)
SELECT bits, count(*) AS n, min(vec_id) AS first_id FROM h GROUP BY ALL""")
def q_signhash_collisions(spark: SparkSession, d: str) -> DataFrame:
    bits = s.sign_hash(F.col("embedding")).alias("bits")
    return table(spark, d, "embeddings").groupBy(bits).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


@query("""WITH r AS (SELECT sha256(doc_id || chr(0) || coalesce(lang, chr(1)) || chr(0) || coalesce(n_chars::VARCHAR, chr(1)) || chr(0) || coalesce(source, chr(1)) || chr(0) || coalesce(text, chr(1))) AS h FROM documents),
  s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS a, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS b FROM r)
SELECT n, sha256(n || ':' || coalesce(a, 0)::HUGEINT || ':' || coalesce(b, 0)::HUGEINT) AS digest FROM s""")
def q_content_id(spark: SparkSession, d: str) -> DataFrame:
    return content_digest(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query(f"""WITH {FRAMES}, seeds AS (SELECT domain, method, k % 3 AS seed, avg(score) AS v FROM frames GROUP BY ALL)
SELECT printf('| %s | %s | %.4f ± %.4f [%.4f, %.4f] |', domain, method, avg(v), coalesce(stddev_samp(v), 0), min(v), max(v)) AS line FROM seeds GROUP BY domain, method""")
def q_markdown_report(spark: SparkSession, d: str) -> DataFrame:
    seeds = frames(spark, d).groupBy("domain", "method", (F.col("k") % 3).alias("seed")).agg(F.avg("score").alias("v"))
    return reporting.markdown_rows(metrics.spread(seeds, ["domain", "method"], "v"), ["domain", "method"], "mean", "sd", "low", "high")


@query("""WITH c AS (SELECT * FROM (VALUES ('jpeg', 90.0), ('jpeg', 70.0), ('jpeg', 50.0), ('jpeg', 30.0), ('resize', 0.75), ('resize', 0.5), ('resize', 0.25),
    ('blur', 0.5), ('blur', 1.0), ('blur', 2.0), ('noise', 2.0), ('noise', 5.0), ('noise', 10.0), ('crop', 0.9), ('crop', 0.8), ('crop', 0.7), ('h264', 23.0), ('h264', 30.0), ('h264', 38.0)) t(name, level)),
  h AS (SELECT p_partkey, name, level::DOUBLE AS level, sha256(p_partkey || chr(0) || name || chr(0) || printf('%g', level::DOUBLE)) AS h FROM part, c)
SELECT p_partkey, name, level, ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT::VARCHAR AS noise_seed FROM h""")
def q_corruption_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = media.corruption_plan(table(spark, d, "part"), "p_partkey")
    return plan.select("p_partkey", "name", "level", F.col("noise_seed").cast("string").alias("noise_seed"))


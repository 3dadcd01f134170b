"""Lineage links, hold-out selection and gates on splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import identity_tokens, text_of
from millrace.operators.constraints import require_columns


def row_links(rows: DataFrame, keep: list[str], kinds: dict[str, Column]) -> DataFrame:
    """One row for each link: the kept columns, kind and key. A kind's column is an array of keys."""
    named = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    each = F.concat(*(F.transform(F.array_distinct(keys), named(kind)) for kind, keys in kinds.items()))
    return rows.select(*keep, F.explode(each).alias("link")).select(*keep, "link.*").where(F.col("key") != "")


def cross_split_links(links: DataFrame, split: str = "split") -> DataFrame:
    """(kind, key, splits) of keys in several splits."""
    pairs = links.select("kind", "key", split).distinct()
    held = pairs.groupBy("kind", "key").agg(F.array_sort(F.collect_set(split)).alias("s"))
    return held.where(F.size("s") > 1).select("kind", "key", F.array_join("s", ",").alias("splits"))


def forbidden_rows(links: DataFrame, forbidden: DataFrame, keep: list[str]) -> DataFrame:
    """(kept columns, kind) of rows that have a forbidden (kind, key)."""
    return links.join(forbidden.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select(*keep, "kind").distinct()


def heldout_cascade(rows: DataFrame, key: str, entities: str, owned: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows with ``reason``: empty if they may be used.

    In order: ``no_entity``; ``entity`` if one is in ``owned`` (entity); then the named checks.
    Each row counts under its first reason.
    """
    taken = rows.select(key, F.explode(entities).alias("entity")).join(owned.select("entity").distinct(), "entity", "left_semi").select(key).distinct()
    marked = rows.join(taken.withColumn("taken", F.lit(True)), key, "left")
    reason = F.when(F.size(entities) == 0, "no_entity").when(F.coalesce("taken", F.lit(False)), "entity")
    for name, bad in checks:
        reason = reason.when(F.coalesce(bad, F.lit(False)), name)
    return marked.withColumn("reason", reason.otherwise("")).drop("taken")


def cell_targets(rows: DataFrame, cells: list[str], video: str, targets: DataFrame) -> DataFrame:
    """(cells, target, found, missing): distinct videos of each wanted cell against its target."""
    found = rows.select(*cells, video).distinct().groupBy(*cells).agg(F.count(F.lit(1)).alias("found"))
    joined = targets.join(found, cells, "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))
    return joined.select(*cells, F.col("target").cast("long").alias("target"), "found", F.greatest(F.col("target") - F.col("found"), F.lit(0)).cast("long").alias("missing"))


def unexpected_cells(rows: DataFrame, cells: list[str], targets: DataFrame) -> DataFrame:
    """Cells that occur but aren't wanted."""
    return rows.select(*cells).distinct().join(targets.select(*cells), cells, "left_anti")


def shared_tokens(rows: DataFrame, key: str, tokens: str, split: str = "split", label: str = "label") -> DataFrame:
    """(split_a, split_b, label, n_tokens, n_rows): tokens in both splits of a pair, and the rows of
    either split, by label, that hold one of them."""
    each = rows.select(key, split, label, F.explode(F.array_distinct(tokens)).alias("token"))
    held = each.select("token", split).distinct()
    pairs = held.select("token", F.col(split).alias("split_a")).join(held.select("token", F.col(split).alias("split_b")), "token").where("split_a < split_b")
    sums = pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n_tokens"))
    touched = each.join(pairs, "token").where((F.col(split) == F.col("split_a")) | (F.col(split) == F.col("split_b")))
    counts = touched.select("split_a", "split_b", label, key).distinct().groupBy("split_a", "split_b", label).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(sums, ["split_a", "split_b"]).select("split_a", "split_b", F.col(label).alias("label"), "n_tokens", "n_rows")


def token_coverage(rows: DataFrame, tokens: str, split: str = "split") -> DataFrame:
    """(split, n_rows, n_with, n_tokens): rows, rows with a token, distinct tokens."""
    base = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(tokens) > 0).alias("n_with"))
    each = rows.select(split, F.explode(tokens).alias("token")).distinct().groupBy(split).agg(F.count(F.lit(1)).alias("n_tokens"))
    return base.join(each, split, "left").select(F.col(split).alias("split"), "n_rows", "n_with", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def path_status(rows: DataFrame, key: str, stem: str, index: DataFrame) -> DataFrame:
    """(key, status): how many files of ``index`` (stem, n) a row's stem names."""
    met = rows.select(key, F.lower(text_of(stem)).alias("stem")).join(index, "stem", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("stem") == "", "missing_path_value").when(n == 0, "missing_file").when(n > 1, "ambiguous_path").otherwise("ok")
    return met.select(key, status.alias("status"))


#: The columns that an audit of a protocol needs.
AUDITED = ("sample_id", "split", "label", "fake_method", "video_id", "source_domain", "lineage_video_ids", "identity_id", "target_identity_id", "pixel_sha256", "dhash64", "status")


def protocol_kinds() -> dict[str, Column]:
    """The video, parent, identity, pixel and dhash keys of a manifest row, which must not cross splits.

    Identities are those of both roles and the tokens in names; ``ff`` and ``celeba`` rows without any
    have their parents instead.
    """
    domain = F.col("source_domain")
    listed = lambda c: F.filter(F.transform(F.split(text_of(c), r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    parents = F.filter(F.split(text_of("lineage_video_ids"), r"\|"), lambda t: t != "")
    named = F.array_distinct(F.concat(listed("identity_id"), listed("target_identity_id"), identity_tokens(text_of("video_id")), identity_tokens(text_of("target_identity_id"))))
    identities = F.when((F.size(named) == 0) & domain.isin("ff", "celeba"), parents).otherwise(named)
    under = lambda keys: F.transform(keys, lambda t: F.concat(domain, F.lit(":"), t))
    return {"video": F.array(F.concat(domain, F.lit(":"), "video_id")), "parent": parents, "identity": under(identities),
            "pixel": F.array(text_of("pixel_sha256")), "dhash": F.array(text_of("dhash64"))}


def protocol_links(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, kind, key): the keys of manifest rows that must not cross splits, see ``protocol_kinds``."""
    return row_links(rows, keep, protocol_kinds())


def _cell() -> Column:
    return F.when(F.col("label") == "FAKE", F.col("fake_method")).otherwise("real")


def _lacking(rows: DataFrame) -> DataFrame:
    """(section, key, n): how many usable rows have no parent and no identity."""
    kinds = protocol_kinds()
    none = lambda k: F.count_if(~F.coalesce(F.exists(kinds[k], lambda t: t != ""), F.lit(False)))
    counts = rows.agg(*(none(k).alias(k) for k in ("parent", "identity")))
    each = F.explode(F.create_map(*(x for k in ("parent", "identity") for x in (F.lit(k), F.col(k))))).alias("key", "n")
    return counts.select(F.lit("missing").alias("section"), each).where("n > 0")


def _verdict(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("failure", F.col("section") != "count").select("section", "key", F.col("n").cast("long").alias("n"), "failure")


def unseen_audit(rows: DataFrame, methods: dict[str, list[str]]) -> DataFrame:
    """(section, key, n, failure) of a manifest under an unseen-method protocol; it passes if no row is a
    failure.

    ``count`` has the rows by split and method; ``invalid`` those of unknown split or not decoded;
    ``forbidden`` the fakes of a method that isn't its split's; ``absent`` the cells that the protocol
    wants and nobody fills; ``overlap`` the keys by kind that lie in several splits; ``missing`` the rows
    without parents or identities.
    """
    require_columns(rows, list(AUDITED))
    spark = rows.sparkSession
    good = F.col("split").isin(*methods) & (F.col("status") == "ok")
    usable = rows.where(good)
    bad = rows.where(~F.coalesce(good, F.lit(False))).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("invalid").alias("section"), F.lit("").alias("key"), "n")
    cells = usable.groupBy("split", _cell().alias("method"), "label").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.groupBy("split", "method").agg(F.sum("n").alias("n"))
    wanted = spark.createDataFrame([(s, m) for s, ms in methods.items() for m in [*ms, "real"]], "split string, method string")
    name = F.concat_ws("/", "split", "method").alias("key")
    stray = cells.where(F.col("label") == "FAKE").join(wanted, ["split", "method"], "left_anti").select(F.lit("forbidden").alias("section"), name, "n")
    absent = wanted.join(counts, ["split", "method"], "left_anti").select(F.lit("absent").alias("section"), name, F.lit(0).cast("long").alias("n"))
    links = protocol_links(usable, ["sample_id", "split"])
    across = cross_split_links(links).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("overlap").alias("section"), F.col("kind").alias("key"), "n")
    return _verdict([counts.select(F.lit("count").alias("section"), name, "n"), bad, stray, absent, across, _lacking(usable)])


def heldout_audit(rows: DataFrame, reference: DataFrame, targets: dict[tuple[str, str], int]) -> DataFrame:
    """(section, key, n, failure) of an evaluation-only manifest against a frozen one.

    ``count`` has the videos by domain and method; ``invalid`` the rows outside the test split or not
    decoded; ``unexpected`` the cells that aren't wanted; ``short`` those with fewer videos than their
    target, with their number; ``overlap`` the keys by kind that the frozen train or validation rows have
    too; ``missing`` the rows without parents or identities.
    """
    require_columns(rows, list(AUDITED))
    good = (F.col("split") == "test") & (F.col("status") == "ok")
    usable = rows.where(good)
    bad = rows.where(~F.coalesce(good, F.lit(False))).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("invalid").alias("section"), F.lit("").alias("key"), "n")
    videos = usable.select("source_domain", _cell().alias("method"), "video_id").distinct().groupBy("source_domain", "method").agg(F.count(F.lit(1)).alias("n"))
    wanted = rows.sparkSession.createDataFrame([(d, m, n) for (d, m), n in targets.items()], "source_domain string, method string, target long")
    name = F.concat_ws("/", "source_domain", "method").alias("key")
    stray = videos.join(wanted, ["source_domain", "method"], "left_anti").select(F.lit("unexpected").alias("section"), name, "n")
    found = wanted.join(videos, ["source_domain", "method"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    short = found.where("n < target").select(F.lit("short").alias("section"), name, "n")
    links = protocol_links(usable, ["sample_id"])
    frozen = protocol_links(reference.where(F.col("split").isin("train", "validation")), ["sample_id"]).select("kind", "key").distinct()
    shared = links.select("kind", "key").distinct().join(frozen, ["kind", "key"], "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    overlap = shared.select(F.lit("overlap").alias("section"), F.col("kind").alias("key"), "n")
    return _verdict([videos.select(F.lit("count").alias("section"), name, "n"), bad, stray, short, overlap, _lacking(usable)])

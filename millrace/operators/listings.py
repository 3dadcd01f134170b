"""Catalogs extended by what archives list: methods that no official catalog has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import file_suffix, frame_index, hash_split, lineage_tokens, text_of
from millrace.operators.catalog import safe_part
from millrace.operators.constraints import ConstraintError, require_none

#: Archives of methods without an official catalog, with their families; the suffixes that count; the
#: folder in front of source paths; the method whose members don't tell their domain.
LISTED_METHODS = {
    "fomm": ("train/fomm.zip", "face_reenactment"), "facedancer": ("test/facedancer.zip", "face_swap"), "mraa": ("test/MRAA.zip", "face_reenactment"),
    "stylegan3": ("test/StyleGAN3.zip", "entire_face_synthesis"), "uniface": ("test/uniface.zip", "face_swap"), "mcnet": ("test/mcnet.zip", "face_reenactment"),
    "rddm": ("test/RDDM.zip", "entire_face_synthesis"),
}
LISTED_SUFFIXES = (".png", ".jpg", ".jpeg")
SOURCE_FOLDER = "deepfakes_detection_datasets/DF40/"
DEFAULT_DOMAINS = {"fomm": "ff"}
DOMAINS = ("ff", "cdf")


def _fail(message: str, *parts: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *(text_of(p) for p in parts))).cast("string")


def with_lineage(catalog: DataFrame) -> DataFrame:
    """The rows, those without lineage with the one that their domain, video and named sources give."""
    prefix = F.concat("source_domain", F.lit(":"))
    video = F.when(F.startswith("video_id", prefix), F.substring("video_id", F.char_length(prefix) + 1, F.char_length("video_id"))).otherwise(F.col("video_id"))
    own = F.array_join(lineage_tokens(F.col("source_domain"), video, F.col("source_video_id")), "|")
    return catalog.withColumn("lineage_video_ids", F.when(text_of("lineage_video_ids") != "", F.col("lineage_video_ids")).otherwise(own))


def listed_rows(members: DataFrame, methods: dict[str, tuple[str, str]], eval_seed: str, prefix: str = "eval-v1", defaults: dict[str, str] = DEFAULT_DOMAINS) -> DataFrame:
    """Catalog rows of archive members (archive, member) of ``methods`` (method: archive, family).

    Members without an image's suffix and archives of no method are left out. The last folder is the video
    and a folder of a domain's name tells the domain. Fewer than two folders, a part that leaves its place,
    two domains, or none where the method has no default are errors when a row is read. Rows of archives
    below ``train/`` are train rows; videos of all others are dealt to validation and test by a hash.
    """
    kept = members.where(file_suffix(F.col("member")).isin(*LISTED_SUFFIXES)).select("archive", "member")
    owners = members.sparkSession.createDataFrame([(a, m, f, defaults.get(m, "")) for m, (a, f) in methods.items()], "archive string, fake_method string, manipulation_family string, default string")
    parts = F.split("member", "/")
    unsafe = (F.size(parts) < 3) | F.exists(parts, lambda p: p.isin("", ".", ".."))
    told = F.array_distinct(F.filter(parts, lambda p: p.isin(*DOMAINS)))
    domain = F.when(unsafe, _fail("unsafe archive member: ", F.col("archive"), F.lit(" "), F.col("member"))).when(F.size(told) > 1, _fail("several domains: ", F.col("member"))).when(
        F.size(told) == 1, F.element_at(told, 1)).when(F.col("default") != "", F.col("default")).otherwise(_fail("no domain: ", F.col("archive"), F.lit(" "), F.col("member")))
    rows = kept.join(F.broadcast(owners), "archive").select(
        "*", domain.alias("source_domain"), safe_part(F.element_at(parts, -2), "archive video name").alias("video"), safe_part(F.element_at(parts, -1), "archive frame name").alias("frame"))
    split = F.when(F.startswith("archive", F.lit("train/")), "train").otherwise(hash_split(prefix, F.lit(eval_seed), "source_domain", "video"))
    rows = rows.withColumn("split", split).withColumn("source_path", F.concat(F.lit(SOURCE_FOLDER), "member"))
    path = F.concat_ws("/", F.lit("images"), "source_domain", "fake_method", "split", F.lit("none"), "video", F.concat(F.substring(F.sha2("source_path", 256), 1, 12), F.lit("_"), "frame"))
    empty = F.lit("")
    return rows.select(
        F.substring(F.sha2(path, 256), 1, 24).alias("image_id"), path.alias("relative_path"), F.lit("FAKE").alias("label"), "split", F.when(F.col("split") == "train", "train").otherwise("test").alias("official_splits"),
        "fake_method", "manipulation_family", "source_domain", F.concat("source_domain", F.lit(":"), "video").alias("video_id"), empty.alias("identity_id"),
        frame_index(F.col("frame"), F.lit(0)).cast("string").alias("frame_index"), empty.alias("compression"), F.concat(F.lit("archive:"), "archive").alias("source_json"), "source_path",
        empty.alias("source_video_id"), empty.alias("target_identity_id"), F.array_join(lineage_tokens(F.col("source_domain"), F.col("video"), empty), "|").alias("lineage_video_ids"))


def extend_catalog(catalog: DataFrame, members: DataFrame, eval_seed: str, methods: dict[str, tuple[str, str]] = LISTED_METHODS, prefix: str = "eval-v1") -> DataFrame:
    """The catalog with lineage filled in where it lacks, and a row for each image that the methods' archives
    list. An empty catalog, a method that it has already, an archive that isn't listed, and a path of two
    rows are errors."""
    if catalog.isEmpty():
        raise ConstraintError("the catalog is empty")
    require_none(catalog.where(F.col("fake_method").isin(*methods)).select("fake_method"), "methods that the catalog has already", "fake_method")
    listed = members.select("archive").distinct()
    wanted = members.sparkSession.createDataFrame([(a,) for a, _ in methods.values()], "archive string")
    require_none(wanted.join(listed, "archive", "left_anti"), "missing archives", "archive")
    new = listed_rows(members, methods, eval_seed, prefix)
    columns = new.columns
    if lacking := sorted(set(columns) - set(catalog.columns)):
        raise ConstraintError(f"missing columns: {', '.join(lacking)}")
    out = with_lineage(catalog).select(columns).unionByName(new)
    require_none(out.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "paths of several rows", "relative_path")
    return out

"""From nested official catalogs to one row for each frame, and from catalog rows to a manifest."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import digest, file_name, file_stem, frame_index, hash_split, lineage_tokens, text_of
from millrace.operators.constraints import ConstraintError, require_columns, require_none
from millrace.plans.durable import stored

#: Catalog names of methods with the method and its family.
METHODS = {
    "simswap": ("simswap", "face_swap"), "wav2lip": ("wav2lip", "face_reenactment"), "stylegan2": ("stylegan2", "entire_face_synthesis"),
    "sd2.1": ("sd21", "entire_face_synthesis"), "blendface": ("blendface", "face_swap"), "uniface": ("uniface", "face_swap"),
    "facedancer": ("facedancer", "face_swap"), "fomm": ("fomm", "face_reenactment"), "mraa": ("mraa", "face_reenactment"),
    "mcnet": ("mcnet", "face_reenactment"), "sadtalker": ("sadtalker", "face_reenactment"), "dit": ("dit", "entire_face_synthesis"),
    "stylegan3": ("stylegan3", "entire_face_synthesis"), "rddm": ("rddm", "entire_face_synthesis"), "starganv2": ("starganv2", "face_edit"),
}
#: Names of splits and of compressions, domains by the end of a catalog's name.
SPLIT_NAMES = {"train": "train", "val": "validation", "validation": "validation", "test": "test"}
COMPRESSIONS = ("c23", "c40", "raw")
DOMAIN_ENDINGS = {"_cdf": "cdf", "_ff": "ff"}
#: The columns of a manifest, in order.
MANIFEST = ("sample_id", "dataset_name", "dataset_version", "source_id", "path_query", "relative_path", "label", "split", "status")


def _fail(message: str, *parts: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *(text_of(p) for p in parts))).cast("string")


def _looked_up(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def method_and_domain(source: Column) -> Column:
    """Struct (method, family, domain) of a catalog's file name; an unknown one is an error."""
    stem = file_stem(source)
    ending = F.regexp_extract(stem, "(" + "|".join(DOMAIN_ENDINGS) + ")$", 1)
    name = F.when(ending != "", F.substring(stem, F.lit(1), F.char_length(stem) - F.char_length(ending))).otherwise(stem)
    domain = F.when(ending != "", _looked_up(ending, DOMAIN_ENDINGS)).when(stem == "starganv2", "celeba").otherwise(_fail("unsupported catalog: ", file_name(source)))
    known = F.coalesce(_looked_up(name, {k: m for k, (m, _) in METHODS.items()}), _fail("unsupported method in ", file_name(source)))
    return F.struct(known.alias("method"), _looked_up(name, {k: f for k, (_, f) in METHODS.items()}).alias("family"), domain.alias("domain"))


def single_match(keys: Column, names: dict[str, str], what: str) -> Column:
    """What the one of ``keys`` that is named says, in any case; none or several meanings are an error."""
    found = F.array_distinct(F.array_compact(F.transform(keys, lambda k: _looked_up(F.lower(k), names))))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(_fail(f"expected exactly one {what} in ", F.array_join(keys, "/")))


def label_from_tokens(label: Column, keys: Column) -> Column:
    """REAL or FAKE by the word ``real`` or ``fake`` in the label or a key, between ``_``, ``-`` and the
    ends; neither or both is an error."""
    says = lambda c, word: c.rlike(f"(^|[_-]){word}($|[_-])")
    each = F.transform(F.array_append(keys, text_of(label)), lambda c: F.when(says(F.lower(c), "real"), "REAL").when(says(F.lower(c), "fake"), "FAKE"))
    found = F.array_distinct(F.array_compact(each))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(_fail("missing or conflicting label in ", F.array_join(keys, "/")))


def safe_part(value: Column, what: str) -> Column:
    """The value if it can be one part of a path, else an error."""
    bad = (text_of(value) == "") | value.isin(".", "..") | value.rlike(r'[/\\:<>"|?*\x00]')
    return F.when(bad, _fail(f"unsafe {what}: ", value)).otherwise(value)


def normalize_catalog(records: DataFrame, eval_seed: str | None = None, prefix: str = "eval-v1") -> DataFrame:
    """One row for each frame path of nested catalog records (source, source_rank, keys, record), as
    ``read_catalog`` gives them; ``record`` is a variant with ``frames`` and maybe ``label``,
    ``identity_id``, ``target_identity_id`` and ``source_video_id``.

    A path that several records name keeps the first by the order of files, then of keys and positions;
    records that disagree on its label, split, domain or method are an error. Records are read once; the
    result is a stored table. With ``eval_seed``, videos
    outside the train split are dealt anew to validation and test by a hash of domain and name.
    """
    text = lambda name: F.coalesce(F.expr(f"try_variant_get(record, '$.{name}', 'string')"), F.lit(""))
    facts = records.select(
        "source_rank", "keys", file_name(F.col("source")).alias("source_json"), method_and_domain(F.col("source")).alias("m"),
        single_match(F.col("keys"), SPLIT_NAMES, "split").alias("official"), label_from_tokens(text("label"), F.col("keys")).alias("label"),
        F.coalesce(F.get(F.filter("keys", lambda k: F.lower(k).isin(*COMPRESSIONS)), F.lit(0)), F.lit("")).alias("compression"),
        safe_part(F.element_at("keys", -1), "video name").alias("video"), *(text(c).alias(c) for c in ("identity_id", "target_identity_id", "source_video_id")),
        F.coalesce(F.expr("try_variant_get(record, '$.frames', 'array<string>')"), F.array(_fail("invalid frames in ", F.array_join("keys", "/")))).alias("frames"))
    split = F.when(F.col("official") == "train", "train").otherwise(hash_split(prefix, F.lit(eval_seed), "m.domain", "video")) if eval_seed is not None else F.col("official")
    frames = facts.withColumn("split", split).select("*", F.posexplode(F.array_sort("frames")).alias("position", "frame")).withColumn("source_path", F.replace("frame", F.lit("\\"), F.lit("/")))
    fake = F.col("label") == "FAKE"
    name = safe_part(file_name(F.col("source_path")), "frame name")
    relative = F.concat_ws("/", F.lit("images"), "m.domain", F.when(fake, F.col("m.method")).otherwise("real"), "split", F.when(F.col("compression") == "", "none").otherwise(F.col("compression")),
                           "video", F.concat(F.substring(F.sha2("source_path", 256), 1, 12), F.lit("_"), name))
    rows = frames.select(
        relative.alias("relative_path"), "label", "split", "official", F.when(fake, F.col("m.method")).otherwise("").alias("fake_method"),
        F.when(fake, F.col("m.family")).otherwise("real").alias("manipulation_family"), F.col("m.domain").alias("source_domain"),
        F.concat("m.domain", F.lit(":"), "video").alias("video_id"), "identity_id", frame_index(name, F.col("position")).cast("string").alias("frame_index"),
        "compression", "source_json", "source_path", "source_video_id", "target_identity_id",
        F.array_join(lineage_tokens(F.col("m.domain"), F.col("video"), F.col("source_video_id")), "|").alias("lineage_video_ids"),
        "source_rank", F.array_join("keys", "\0").alias("key_order"), "position")
    facts = F.struct("label", "split", "source_domain", "fake_method")
    rest = [c for c in rows.columns if c not in ("source_path", "official")]
    rank = F.struct("source_rank", "key_order", "position", *(F.col(c).cast("string") for c in ("label", "split", "source_domain", "fake_method")))
    # all that is asked of a path's records in one aggregate: its first row, whether any differ, its official splits (of three)
    paths = stored(rows.groupBy("source_path").agg(
        F.min_by(F.struct(*rest), rank).alias("row"), F.min(facts).eqNullSafe(F.max(facts)).alias("agree"), F.array_join(F.array_sort(F.collect_set("official")), "|").alias("official_splits")))
    require_none(paths.where("NOT agree"), "conflicting frame assignments", "source_path")
    return paths.select("source_path", "row.*", "official_splits").select(
        F.substring(F.sha2("relative_path", 256), 1, 24).alias("image_id"), "relative_path", "label", "split", "official_splits", "fake_method", "manipulation_family",
        "source_domain", "video_id", "identity_id", "frame_index", "compression", "source_json", "source_path", "source_video_id", "target_identity_id", "lineage_video_ids")


def from_template(template: str, columns: list[str]) -> Column:
    """The template with each ``{column}`` replaced by the column's text."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            if name not in columns:
                raise ConstraintError(f"the path template names a missing column: {name}")
            parts.append(text_of(name))
    return F.concat(*parts)


def resolve_paths(rows: DataFrame, query: Column, files: DataFrame) -> DataFrame:
    """Add ``path_query``, ``relative_path`` and ``status`` to the rows: ok, missing_path_value,
    outside_data_root, missing_image or ambiguous_path.

    ``files`` (path) are the paths below the root. A query with ``*``, ``?`` or ``[`` is a pattern of one
    path's parts; patterns meet only the files of their depth that begin with their literal folder.
    """
    asked = rows.withColumn("path_query", F.replace(F.trim(text_of(query)), F.lit("\\"), F.lit("/"))).withColumn("row_no", F.monotonically_increasing_id())
    steps = F.aggregate(
        F.split("path_query", "/"), F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out")),
        lambda s, p: F.when(p.isin("", "."), s).when(p == "..", F.struct(F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["out"] | (F.size(s["at"]) == 0)).alias("out"))).otherwise(
            F.struct(F.array_append(s["at"], p).alias("at"), s["out"].alias("out"))))
    asked = asked.withColumn("outside", steps["out"] | F.col("path_query").startswith("/")).withColumn("clean", F.array_join(steps["at"], "/"))
    there = files.select(F.col("path").alias("file")).distinct()
    pattern = F.col("path_query").rlike(r"[*?\[]")
    plain = asked.where(~pattern).select("row_no", "clean").join(there, F.col("clean") == F.col("file")).select("row_no", "file")
    depth = lambda c: F.size(F.split(c, "/"))
    folder = F.regexp_extract("path_query", r"^([^*?\[/]+)/", 1)
    escaped = F.regexp_replace("path_query", r"([.+^$(){}|\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"\*", "[^/]*"), r"\?", "[^/]"), r"\[!", "[^"), F.lit("$"))
    globs = asked.where(pattern).select("row_no", depth("path_query").alias("depth"), folder.alias("folder"), regex.alias("regex"))
    indexed = there.select("file", depth("file").alias("depth"), F.explode(F.array_distinct(F.array(F.split("file", "/")[0], F.lit("")))).alias("folder"))
    matched = globs.join(indexed, ["depth", "folder"]).where(F.expr("file RLIKE regex")).select("row_no", "file")
    found = plain.unionByName(matched).groupBy("row_no").agg(F.count(F.lit(1)).alias("n_files"), F.min("file").alias("file"))
    status = F.when(F.col("path_query") == "", "missing_path_value").when(F.coalesce("n_files", F.lit(0)) > 1, "ambiguous_path").when(
        F.col("outside"), "outside_data_root").when(F.col("n_files").isNull(), "missing_image").otherwise("ok")
    joined = asked.join(found, "row_no", "left").withColumn("status", status)
    return joined.withColumn("relative_path", F.when(F.col("status") == "ok", F.col("file")).otherwise("")).select(*rows.columns, "path_query", "relative_path", "status")


def sample_id(name: str, version: str, id_column: str, columns: list[str]) -> Column:
    """SHA-256 of the data set's name and version and the row's id, or without one of its path query and
    its whole content as JSON with sorted keys."""
    content = F.to_json(F.struct(*(text_of(c).alias(c) for c in sorted(columns))))
    own = F.trim(text_of(id_column))
    return F.when(own != "", digest(F.lit(name), F.lit(version), own)).otherwise(digest(F.lit(name), F.lit(version), "path_query", content))


def carry_columns(wanted: list[str], columns: list[str]) -> list[str]:
    """The wanted columns once each, in order; one that isn't there or that a manifest has itself is an
    error."""
    once = list(dict.fromkeys(wanted))
    if clash := sorted(set(once) & set(MANIFEST)):
        raise ConstraintError(f"carried columns clash with the manifest's: {', '.join(clash)}")
    if missing := sorted(set(once) - set(columns)):
        raise ConstraintError(f"missing columns: {', '.join(missing)}")
    return once


def project_manifest(rows: DataFrame, files: DataFrame, name: str, version: str, id_column: str, label: str, split: str, template: str, carry: list[str] = ()) -> DataFrame:
    """The manifest of catalog rows: its fixed columns and the carried ones, all trimmed text."""
    require_columns(rows, [id_column, label, split])
    carried = carry_columns(list(carry), rows.columns)
    met = resolve_paths(rows, from_template(template, rows.columns), files)
    trimmed = lambda c: F.trim(text_of(c))
    return met.select(
        sample_id(name, version, id_column, rows.columns).alias("sample_id"), F.lit(name).alias("dataset_name"), F.lit(version).alias("dataset_version"),
        trimmed(id_column).alias("source_id"), "path_query", "relative_path", trimmed(label).alias("label"), trimmed(split).alias("split"), "status", *(trimmed(c).alias(c) for c in carried))


def require_same_samples(subset: DataFrame, manifest: DataFrame, fingerprints: list[str], splits: list[str], group: str = "video_id") -> DataFrame:
    """The subset's rows (image_id) with their manifest's fingerprints (source_id), if the two describe the
    same samples: each id once on both sides, decoded, with all fingerprints, a known split and a group,
    and equal splits and groups. Anything else is an error."""
    left = subset.select(F.col("image_id").alias("sample"), F.lit(True).alias("in_subset"), F.col("split").alias("own_split"), F.col(group).alias("own_group"))
    right = manifest.select(F.col("source_id").alias("sample"), F.lit(True).alias("in_manifest"), "split", F.col(group).alias("group"), "status", *fingerprints)
    incomplete = F.lit(False)
    for f in fingerprints:
        incomplete = incomplete | (text_of(f) == "")
    problem = F.when(F.col("in_subset").isNull() | F.col("in_manifest").isNull(), "on one side only").when(
        (F.col("status") != "ok") | incomplete, "no complete fingerprints").when(
        (F.col("split") != F.col("own_split")) | ~F.col("group").eqNullSafe(F.col("own_group")), "metadata differ").when(
        (text_of("group") == "") | ~F.col("split").isin(*splits), "no group or unknown split")
    met = left.join(right, "sample", "full").withColumn("problem", problem)
    require_none(met.where(F.col("problem").isNotNull()), "samples don't match", "sample", "problem")
    for side, key in ((subset, "image_id"), (manifest, "source_id")):
        require_none(side.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated samples", key)
    return subset.join(manifest.select(F.col("source_id").alias("image_id"), *fingerprints), "image_id")

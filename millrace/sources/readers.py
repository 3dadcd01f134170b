"""Reading catalogs, predictions, listings and lists as text columns, empty where missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import file_name, file_stem, file_suffix, unsafe_path
from millrace.operators.constraints import ConstraintError, require_none
from millrace.plans.durable import cut
from millrace.sources.archives import archive_members
from millrace.sources.stores import file_digests

PREDICTION = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("sample_id", "split", "video_id", "source_domain", "fake_method", "lineage_video_ids")),
    T.StructField("label", T.IntegerType()), T.StructField("logit", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("embedding", T.ArrayType(T.FloatType()))])


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, null as the empty string; nested values as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column is text and nothing is guessed."""
    return as_text(spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True))


def numbered_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """(file, position, value) of text files' lines, those that are empty only with ``blank``; positions are
    from 0 in the order of each file.

    Spark reads a file in splits. Lines are counted by split, which gives each split's first position, and
    a line's own is its distance from the first one there; the only window runs over the splits.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    kept = cut((lines if blank else lines.where(F.col("value") != "")).withColumn("at", F.monotonically_increasing_id()))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = kept.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row for each split
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return kept.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("at") - F.col("first")).alias("position"), "value")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, anything else is an error that names lines."""
    odd = (F.trim("value") != "") & (F.coalesce(F.expr("schema_of_variant(try_parse_json(value))"), F.lit("")).startswith("OBJECT") == F.lit(False))
    if not spark.read.text(path).where(odd).isEmpty():
        examples = numbered_lines(spark, path, blank=True).where(odd).orderBy("file", "position").limit(5).collect()
        raise ConstraintError("not JSON objects: " + "; ".join(f"{r.file.rsplit('/', 1)[-1]}, line {r.position + 1}: {r.value[:80]}" for r in examples))
    return as_text(spark.read.option("primitivesAsString", True).json(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of objects, one object, or an object whose ``records`` are the rows."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if df.columns == ["records"]:
        df = df.select(F.explode("records").alias("r")).select("r.*")
    return as_text(df)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: ``.csv``, ``.jsonl``, ``.ndjson`` or ``.json``."""
    suffix = path.lower().rsplit(".", 1)[-1]
    readers = {"csv": read_csv, "jsonl": read_json_lines, "ndjson": read_json_lines, "json": read_json}
    if suffix not in readers:
        raise ValueError(f"unsupported metadata format: {path}")
    return readers[suffix](spark, path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON objects down to those with ``frames``, however deep: source, source_rank, keys (the path
    of names), record. Anything on the way that isn't an object is an error.

    ``record`` is a variant. Each level is one lateral explode, until none is left; files are read in the
    order of their lower-case names, which ``source_rank`` numbers.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source"), F.parse_json("value").alias("node"))
    names = files.select("source").distinct()
    order = names.withColumn("source_rank", F.row_number().over(Window.orderBy(F.lower(file_name(F.col("source"))), "source")))  # one row for each file
    level, out = files.select("source", F.array().cast("array<string>").alias("keys"), "node"), None
    while True:
        kind = F.expr("schema_of_variant(node)")
        bad = level.where(~kind.startswith("OBJECT")).select("source", F.when(F.size("keys") == 0, "<root>").otherwise(F.array_join("keys", "/")).alias("place"))
        require_none(bad, "expected an object", "source", "place")
        leaf = F.expr("try_variant_get(node, '$.frames', 'variant')").isNotNull()
        found = level.where(leaf).select("source", "keys", F.col("node").alias("record"))
        out = found if out is None else out.unionByName(found)
        level.where(~leaf).createOrReplaceTempView("millrace_catalog_level")
        level = spark.sql("SELECT source, array_append(keys, t.key) AS keys, t.value AS node FROM millrace_catalog_level, LATERAL variant_explode(node) t WHERE t.key IS NOT NULL")
        if level.isEmpty():
            return out.join(order, "source")


def read_zip_listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg")) -> DataFrame:
    """archive, member, size, crc of the members with a suffix; unsafe names are an error.

    Only an archive's directory is read, by one task; many are listed side by side.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("path").alias("name"))
    members = archive_members(files).where(file_suffix(F.col("member")).isin(*suffixes)).select("archive", "member", "size", "crc")
    return members.withColumn("member", F.when(unsafe_path(F.col("member")), F.raise_error(F.concat(F.lit("unsafe member: "), "member")).cast("string")).otherwise(F.col("member")))


def read_file_index(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """stem, n: how many files below a folder have each lower-case stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.where(file_suffix(F.col("path")).isin(*suffixes)).groupBy(file_stem(F.col("path")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of the files below a folder."""
    return file_digests(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows as JSON lines, with a fixed schema."""
    return spark.read.schema(PREDICTION).json(path)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; what follows ``#`` is a comment."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("id")).where("id <> ''").distinct()

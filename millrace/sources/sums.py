"""Digests of all files of a folder beside them, and what differs when they are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.constraints import ConstraintError, require_none
from millrace.sources.stores import file_digests, file_paths

#: Fixed value: the name of the list, whose lines are a digest, two spaces and a path.
SUMS = "SHA256SUMS"


def folder_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of the files below a folder, without its list of digests and without what Spark
    and file systems keep for themselves (names that begin with ``_`` or ``.``). Each file is read in chunks
    by one task, many side by side."""
    own = F.element_at(F.split("name", "/"), -1)
    files = file_paths(spark, folder).where(~own.startswith("_") & ~own.startswith(".") & (F.col("name") != SUMS))
    found = file_digests(files)
    return files.select("path", "name").join(found, "path").select("name", "size", "sha256")


def write_sums(spark: SparkSession, folder: str) -> int:
    """Write the list of a folder's files, sorted by name, as one file; returns how many there are. A list
    that is there already must be the same."""
    jvm = spark._jvm.org.apache.hadoop.fs
    lines = folder_digests(spark, folder).orderBy("name").select(F.concat_ws("  ", "sha256", "name").alias("value"))
    at, staged = jvm.Path(f"{folder}/{SUMS}"), f"{folder}/_{SUMS}.staged"
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(at):
        require_none(sum_problems(spark, folder), f"{folder} was changed", "name", "problem")
        return read_sums(spark, folder).count()
    lines.coalesce(1).write.mode("overwrite").text(staged)  # a line for each file, in one sorted file
    part = next(x.getPath() for x in store.listStatus(jvm.Path(staged)) if x.getPath().getName().startswith("part-"))
    if not store.rename(part, at):
        raise RuntimeError(f"can't rename to {folder}/{SUMS}")
    store.delete(jvm.Path(staged), True)
    return read_sums(spark, folder).count()


def read_sums(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256) of a folder's list; a line of another form and a name twice are errors."""
    lines = spark.read.text(f"{folder}/{SUMS}").where("value <> ''")
    require_none(lines.where(~F.col("value").rlike("^[0-9a-f]{64}  .+$")), f"no digest and path in {SUMS}", "value")
    out = lines.select(F.substring("value", F.lit(67), F.length("value")).alias("name"), F.substring("value", 1, 64).alias("sha256"))
    require_none(out.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"listed twice in {SUMS}", "name")
    return out


def sum_problems(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem) of files that are ``changed``, ``missing`` or ``not listed``; none if all is as listed."""
    listed = read_sums(spark, folder).withColumnRenamed("sha256", "wanted")
    met = listed.join(folder_digests(spark, folder), "name", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "not listed").when(F.col("wanted") != F.col("sha256"), "changed")
    return met.select("name", problem.alias("problem")).where(F.col("problem").isNotNull())


def require_sums(spark: SparkSession, folder: str, digest: str | None = None) -> DataFrame:
    """The folder's (name, sha256), if every file is as listed and, where ``digest`` is given, the list itself
    has that SHA-256. Anything else is an error."""
    if digest is not None:
        found = file_digests(spark.createDataFrame([(f"{folder}/{SUMS}",)], "path string")).first().sha256
        if found != digest:
            raise ConstraintError(f"{folder}/{SUMS} isn't the list that is asked for")
    require_none(sum_problems(spark, folder), f"{folder} was changed", "name", "problem")
    return read_sums(spark, folder)

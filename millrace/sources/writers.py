"""Writing tables under the digest of their content, and reports once."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.sums import SUMS, sum_problems, write_sums


def content_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest): a digest of the rows that doesn't depend on their order or partitions.

    The first 60 bits of each row's SHA-256 are summed, in two halves, and the sums hashed.
    """
    row = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\1")) for c in sorted(df.columns))), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(16).alias("b"))
    text = F.concat_ws(":", F.col("n").cast("string"), F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string"))
    return sums.select("n", F.sha2(text, 256).alias("digest"))


def spec_fingerprint(spec: object) -> str:
    """SHA-256 of the compact JSON, with sorted keys, of a dataclass or mapping."""
    value = asdict(spec) if is_dataclass(spec) else spec
    return sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _files(spark, path)
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(at) else None


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _files(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(part, at):
        raise RuntimeError(f"can't rename to {path}")


def write_artifact(df: DataFrame, folder: str, spec: object | None = None, told: dict | None = None, sums: bool = False) -> tuple[str, str]:
    """Write the table below ``folder`` under the first 20 digits of its digest: (id, path). What is ``told``
    of it goes into its record; with ``sums`` a list of its files' digests lies beside it.

    It is staged and renamed. Equal content is already there and is kept; a place whose content
    differs from its name is an error.
    """
    spark = df.sparkSession
    found = content_digest(df).first()
    name = found.digest[:20]
    path = f"{folder}/{name}"
    fs, at = _files(spark, path)
    if fs.exists(at):
        good, errors = verify_artifact(spark, path)
        if not good:
            raise RuntimeError(f"{path} was changed: {'; '.join(errors)}")
        return name, path
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.staged"), True)  # of a run that failed
    df.write.parquet(f"{path}.staged/rows")
    meta = {"id": name, "digest": found.digest, "rows": found.n, "columns": df.columns, "spec": spec_fingerprint(spec) if spec is not None else None} | (told or {})
    _write_text(spark, f"{path}.staged/artifact.json", json.dumps(meta, sort_keys=True, indent=2))
    if sums:
        write_sums(spark, f"{path}.staged")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.staged"), at):
        raise RuntimeError(f"can't rename to {path}")
    return name, path


def verify_artifact(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """Whether an artifact's rows have the digest that its record and name say, and what is wrong."""
    try:
        text = _read_text(spark, f"{path}/artifact.json")
        meta, errors = json.loads(text) if text is not None else None, []
    except Exception as e:  # an unreadable record is a finding
        return False, [f"artifact.json can't be read: {type(e).__name__}"]
    if meta is None:
        return False, ["artifact.json is missing"]
    try:
        found = content_digest(spark.read.parquet(f"{path}/rows")).first()
    except Exception as e:  # unreadable rows are a finding
        return False, [f"rows can't be read: {type(e).__name__}"]
    if found.digest != meta["digest"]:
        errors.append("the rows' digest differs")
    if found.n != meta["rows"]:
        errors.append("the number of rows differs")
    if meta["digest"][:20] != path.rstrip("/").rsplit("/", 1)[-1]:
        errors.append("the name isn't the digest's")
    if _files(spark, f"{path}/{SUMS}")[0].exists(_files(spark, f"{path}/{SUMS}")[1]):
        errors += [f"{r.name} is {r.problem}" for r in sum_problems(spark, path).orderBy("name").limit(5).collect()]
    return not errors, errors


def write_report(spark: SparkSession, report: dict, folder: str, name: str | None = None) -> str:
    """Write a small report as JSON with sorted keys, once: equal text is kept, other text is an
    error. Without a name it is named by its digest."""
    text = json.dumps(report, sort_keys=True, indent=2)
    path = f"{folder}/{name or 'report-' + sha256(text.encode()).hexdigest()[:20] + '.json'}"
    old = _read_text(spark, path)
    if old is None:
        _write_text(spark, path, text)
    elif old.strip() != text.strip():
        raise RuntimeError(f"{path} exists with other content")
    return path


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV in sorted part files, LF lines, empty text for null; an existing place is an error."""
    df.orderBy(*order).write.mode("errorifexists").csv(path, header=True, lineSep="\n", emptyValue="", nullValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines, columns sorted by name; an existing place is an error."""
    df.select(sorted(df.columns)).write.mode("errorifexists").json(path)


def write_missing_scores(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key combination isn't in the table yet; returns how many combinations."""
    spark = df.sparkSession
    fs, at = _files(spark, path)
    new = df
    if fs.exists(at):
        new = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    count = new.select(*keys).distinct().count()
    if count:
        new.write.mode("append").partitionBy(*keys).parquet(path)
    return count

"""Image-derived values that need no image library, face policy, corruption plans and a scoring hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import digest

#: The registered corruptions and their severities.
CORRUPTIONS = {
    "jpeg": (90, 70, 50, 30), "resize": (0.75, 0.5, 0.25), "blur": (0.5, 1.0, 2.0), "noise": (2, 5, 10), "crop": (0.9, 0.8, 0.7), "h264": (23, 30, 38),
}


def corruption_settings(spark: SparkSession) -> DataFrame:
    """(name, level, level_text, setting) of every corruption and severity."""
    return spark.createDataFrame(
        [(n, float(x), f"{x:g}", f"{n}-{x:g}") for n, levels in CORRUPTIONS.items() for x in levels], "name string, level double, level_text string, setting string")


def noise_seed(sample: Column | str, name: Column | str, level_text: Column | str) -> Column:
    """The first eight bytes of the digest of sample, name and level, read as a little-endian number."""
    h = digest(sample, name, level_text)
    turned = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def corruption_plan(samples: DataFrame, key: str) -> DataFrame:
    """Each sample with each setting and the seed of its noise, which depends on these alone."""
    plan = samples.crossJoin(F.broadcast(corruption_settings(samples.sparkSession)))  # a fixed list
    return plan.withColumn("noise_seed", noise_seed(key, "name", "level_text"))


def difference_hash(gray: Column) -> Column:
    """64 bits, as 16 hex digits, of nine columns by eight rows of grey values, row by row: a bit is
    set where a value exceeds its right neighbour."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(
        F.element_at(gray, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")) > F.element_at(gray, (F.floor(i / 8) * 9 + i % 8 + 2).cast("int")), "1").otherwise("0"))
    return F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0"))


def face_policy(faces: Column, confident: float = 0.8, short: int = 64) -> Column:
    """Struct (status, face) of an array of struct (score, width, height): the largest confident face,
    or why there is none."""
    sure = F.filter(faces, lambda f: f["score"] >= confident)
    largest = F.element_at(F.sort_array(F.transform(sure, lambda f: F.struct((f["width"] * f["height"]).alias("area"), f.alias("face"))), asc=False), 1)["face"]
    none = F.when(F.coalesce(F.size(faces), F.lit(0)) <= 0, "no_face").otherwise("low_confidence")
    small = F.least(largest["width"], largest["height"]) < short
    return F.when(F.size(sure) > 0, F.struct(F.when(small, "face_too_small").otherwise("ok").alias("status"), largest.alias("face"))).otherwise(
        F.struct(none.alias("status"), F.lit(None).cast("struct<score:double,width:double,height:double>").alias("face")))


def score_rows(rows: DataFrame, inputs: list[str], load: Callable[[], Callable[[pa.RecordBatch], tuple]], key: str = "sample_id") -> DataFrame:
    """(key, logit, score, embedding) by a model that ``load`` makes once in each task; it maps a batch
    of the inputs to (logits, embeddings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            logits, embeddings = model(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), pa.array(logits, pa.float64()), pa.array(embeddings, pa.list_(pa.float32()))], names=["key", "logit", "embedding"])

    scored = rows.select(F.col(key).cast("string").alias(key), *inputs).mapInArrow(run, "key string, logit double, embedding array<float>")
    return scored.select(F.col("key").alias(key), "logit", (1 / (1 + F.exp(-F.col("logit")))).alias("score"), "embedding")

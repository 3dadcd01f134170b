"""Jump consistent hashing of stable keys into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published generator: the multiplier of its linear congruence, modulus 2^64.
MULTIPLIER = "2862933555777941757BD"
MODULUS = "18446744073709551616BD"
#: Each shard is numbered in this many hashed runs, so that no task holds a whole shard.
RUNS = 1024


def jump_walk(key: Column, shards: int) -> Column:
    """Struct (shard, grown) of a 64-bit key: its shard among ``shards``, and among one more.

    The walk visits the shard counts at which the key would move; its last stop below a count is
    the key's shard for that count. A step goes one further at least, so ``shards + 1`` steps
    always reach the end. Negative keys count as their unsigned 64-bit value, null as 0. The
    product with the multiplier stays below 10^38, so decimals hold it without overflow.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    last = shards + 1
    long, modulus = (lambda n: F.lit(n).cast("long")), F.expr(MODULUS)
    start = F.coalesce(key.cast("long"), long(0)).cast("decimal(20,0)")
    start = F.when(start < 0, start + modulus).otherwise(start).cast("decimal(20,0)")

    def state(k: Column, j: Column, shard: Column, grown: Column) -> Column:
        return F.struct(k.alias("key"), j.alias("j"), shard.alias("shard"), grown.alias("grown"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["key"] * F.expr(MULTIPLIER) + 1) % modulus).cast("decimal(20,0)")
        draw = F.floor(k / F.expr("8589934592BD")).cast("double") + 1
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / draw)).cast("long")
        moved = state(k, j, F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]), s["j"])
        return F.when(s["j"] < last, moved).otherwise(s)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(last)),
        state(start, long(0), long(0), long(0)),
        step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")),
    )


def number_slots(placed: DataFrame, shard: str, order: list[str], slot: str, runs: int = RUNS) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps in each shard.

    Rows are dealt by (shard, hash of the ordering columns) and numbered in that run; the counts
    of the runs before it, at most ``runs`` a shard, are added. No task sees a whole shard.
    """
    dealt = placed.withColumn("run_no", F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int"))
    before = Window.partitionBy(shard).orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(shard, "run_no")
        .agg(F.count(F.lit(1)).alias("run_rows"))
        .select(shard, "run_no", F.coalesce(F.sum("run_rows").over(before), F.lit(0)).alias("run_start"))
    )
    within = Window.partitionBy(shard, "run_no").orderBy(*order)
    return (
        dealt.withColumn("run_slot", F.row_number().over(within))
        .join(starts, [shard, "run_no"])
        .withColumn(slot, (F.col("run_start") + F.col("run_slot") - 1).cast("long"))
        .drop("run_no", "run_slot", "run_start")
    )


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Place every row by its key alone, under the law ``key``.

    Returns ``id_col``, size (UTF-8 bytes of the text plus 8), text_crc32 (unsigned, of the UTF-8
    bytes), law, shard, slot, grown_shard. A null or empty text has size 8 and CRC 0; a null key
    counts as 0. Repeated rows each get a slot of their own, in the same shard. Other columns of
    the input are not read. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_walk(F.col(id_col), shards).alias("walk"),
    )
    placed = rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
        F.col("walk.shard").alias("shard"), F.col("walk.grown").alias("grown_shard"),
    )
    return number_slots(placed, "shard", ["doc_id", "text_crc32", "size"], "slot").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )

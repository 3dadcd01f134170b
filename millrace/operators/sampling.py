"""Deterministic group-safe sampling, weights, draws and partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import digest, even_positions, uniform
from millrace.operators.constraints import ConstraintError, require_none
from millrace.operators.graph import token_components


def stable_rank(df: DataFrame, seed: str, key: str, within: list[str], salt: list[Column] | None = None) -> DataFrame:
    """Add ``hash`` and ``rank``: the order of a hash of the seed, the salt and the key."""
    hashed = df.withColumn("hash", digest(F.lit(seed), *(salt or []), key))
    return hashed.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy("hash", key)))


def even_rows(df: DataFrame, groups: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """At most ``limit`` evenly spaced rows of each group in the given order, with their position."""
    within = Window.partitionBy(*groups)
    placed = df.withColumn("position", F.row_number().over(within.orderBy(*order)).cast("long") - 1).withColumn("group_rows", F.count(F.lit(1)).over(within))
    return placed.where(F.array_contains(even_positions(F.col("group_rows"), limit), F.col("position")))


def quota_groups(rows: DataFrame, cells: list[str], group: str, seed: str, images: int, frames: int, max_groups: int | None = None, salt: list[Column] | None = None) -> DataFrame:
    """(cells, group, n, rank, take): groups by hash rank, each giving up to ``frames`` rows until a
    cell has ``images``.

    Only one row of each group is ranked. What the groups before have taken is a running sum, so
    that no group waits for another.
    """
    sizes = rows.groupBy(*cells, group).agg(F.count(F.lit(1)).alias("n"))
    ranked = stable_rank(sizes, seed, group, cells, salt)
    if max_groups:
        ranked = ranked.where(F.col("rank") <= max_groups)
    before = Window.partitionBy(*cells).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    most = F.least(F.col("n"), F.lit(frames))
    taken = ranked.withColumn("before", F.coalesce(F.sum(most).over(before), F.lit(0)))
    return taken.withColumn("take", F.least(most, F.lit(images) - F.col("before"))).where(F.col("take") > 0).select(*cells, group, "n", "rank", F.col("take").cast("long"))


def real_quota(fakes: DataFrame, rows: DataFrame, cells: list[str], group: str, seed: str, ratio: float, frames: int) -> DataFrame:
    """Groups of real rows so that each cell has ceil(realised fakes x ratio); as ``quota_groups``."""
    target = fakes.groupBy(*cells).agg(F.ceil(F.sum("take") * F.lit(ratio)).cast("long").alias("target"))
    sizes = rows.groupBy(*cells, group).agg(F.count(F.lit(1)).alias("n")).join(target, cells)
    ranked = stable_rank(sizes, seed, group, cells, [F.lit("real"), *map(F.col, cells)])
    before = Window.partitionBy(*cells).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    most = F.least(F.col("n"), F.lit(frames))
    taken = ranked.withColumn("before", F.coalesce(F.sum(most).over(before), F.lit(0)))
    return taken.withColumn("take", F.least(most, F.col("target") - F.col("before"))).where(F.col("take") > 0).select(*cells, group, "n", "rank", F.col("take").cast("long"))


def shortfalls(taken: DataFrame, cells: list[str], images: int) -> DataFrame:
    """(cells, taken, missing) of cells below their quota."""
    sums = taken.groupBy(*cells).agg(F.sum("take").alias("taken"))
    return sums.withColumn("missing", F.lit(images) - F.col("taken")).where(F.col("missing") > 0)


@dataclass(frozen=True)
class SubsetSpec:
    """Quotas of a subset: per cell of split and method ``images`` rows, ``frames`` of a group, at most
    ``groups`` groups; reals follow the fakes taken, times ``ratio``."""

    seed: str
    images: int
    frames: int
    groups: int | None = None
    ratio: float = 1.0


def picked_positions(rows: str, take: str, position: str) -> Column:
    """Whether a position is one of ``take`` evenly spaced ones among ``rows``, as ``even_positions`` names them."""
    span = F.when(F.col(take) == 1, F.floor(F.col(rows) / 2) == F.col(position)).otherwise(F.exists(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.col(take) - 1, F.lit(1).cast("long"))),
        lambda i: F.bround(i * (F.col(rows) - 1) / (F.col(take) - 1).cast("double"), 0).cast("long") == F.col(position)))
    return (F.col(rows) <= F.col(take)) | span


def build_subset(rows: DataFrame, spec: SubsetSpec, label: str = "label", split: str = "split", method: str = "method", group: str = "group", order: list[str] = ("frame",)) -> DataFrame:
    """The chosen rows with ``selection_role``: fakes by quota of (split, method), reals to match
    them in each split; of a group the evenly spaced rows in ``order``."""
    fake, real = rows.where(F.col(label) == "FAKE"), rows.where(F.col(label) == "REAL")
    fakes = quota_groups(fake, [split, method], group, spec.seed, spec.images, spec.frames, spec.groups)
    reals = real_quota(fakes, real, [split], group, spec.seed, spec.ratio, spec.frames)
    parts = []
    for side, chosen, cells, role in ((fake, fakes, [split, method], "fake"), (real, reals, [split], "real")):
        met = side.join(chosen.select(*cells, group, "take"), [*cells, group])
        within = Window.partitionBy(*cells, group)
        placed = met.withColumn("position", F.row_number().over(within.orderBy(*order)).cast("long") - 1).withColumn("group_rows", F.count(F.lit(1)).over(within))
        parts.append(placed.where(picked_positions("group_rows", "take", "position")).select(*rows.columns, F.lit(role).alias("selection_role")))
    return parts[0].unionByName(parts[1])


def sampling_weights(rows: DataFrame, label: str, method: str, group: str) -> DataFrame:
    """(label, method, group, n, weight): half of all weight to reals, half to fakes, shared equally by
    methods, their groups and the groups' rows. One row for each group."""
    cells = rows.groupBy(label, method, group).agg(F.count(F.lit(1)).alias("n"))
    strata = cells.groupBy(label, method).agg(F.count(F.lit(1)).alias("groups"))
    methods = strata.groupBy(label).agg(F.count(F.lit(1)).alias("methods"))
    joined = cells.join(strata, [label, method]).join(methods, label)
    return joined.select(label, method, group, "n", (F.lit(0.5) / F.col("methods") / F.col("groups") / F.col("n")).alias("weight"))


def weighted_draw(weights: DataFrame, key: str, weight: str, draws: int, seed: str) -> DataFrame:
    """(draw, key): ``draws`` keys with replacement, in proportion to their weights.

    Each draw is a hashed number that falls into one key's span of the running total of weights.
    The total runs over 256 hashed runs of keys first and then inside each run, where numbers and ends
    of spans are sorted together and read once.
    """
    parts = weights.select(key, weight).withColumn("run", F.conv(F.substring(digest(key), 1, 2), 16, 10).cast("int"))
    totals = parts.groupBy("run").agg(F.sum(weight).alias("run_weight"))  # one row for each of the runs
    runs = Window.orderBy("run")
    bounds = totals.withColumn("run_end", F.sum("run_weight").over(runs)).withColumn("run_start", F.col("run_end") - F.col("run_weight"))
    total = F.max("run_end").over(Window.partitionBy())
    bounds = bounds.withColumn("total", total)
    inside = Window.partitionBy("run").orderBy(key)
    spans = parts.select("run", F.sum(weight).over(inside).alias("at"), F.col(key).alias("key"), F.lit(None).cast("long").alias("draw"))
    numbers = weights.sparkSession.range(draws).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("u"))
    placed = numbers.join(F.broadcast(bounds), (F.col("u") * F.col("total") >= F.col("run_start")) & (F.col("u") * F.col("total") < F.col("run_end")))
    at = placed.select("run", (F.col("u") * F.col("total") - F.col("run_start")).alias("at"), F.lit(None).cast(weights.schema[key].dataType).alias("key"), "draw")
    # from the greatest position down, a number's key is the last one passed; a span ends before its end
    down = Window.partitionBy("run").orderBy(F.desc("at"), F.col("draw").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    top = F.first("key", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # rounding may leave a number above all
    return spans.unionByName(at).withColumn("key", F.coalesce(F.last("key", ignorenulls=True).over(down), top)).where(F.col("draw").isNotNull()).select("draw", F.col("key").alias(key))


def prune_cross_split(rows: DataFrame, fingerprints: list[str], priority: dict[str, int], split: str = "split", group: str = "video") -> DataFrame:
    """(split, group) to remove: of a fingerprint that lies in several splits, the split of highest
    priority stays, and every other's whole groups go. All fingerprints are judged on the rows as
    they were."""
    rank = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    long = rows.select(split, group, F.element_at(rank, F.col(split)).alias("p"), F.explode(F.array(*(
        F.struct(F.lit(f).alias("kind"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("key")) for f in fingerprints))).alias("x")).where("x.key <> ''")
    held = long.groupBy("x.kind", "x.key").agg(F.max("p").alias("best"), F.min("p").alias("worst")).where(F.col("best") > F.col("worst"))
    keyed = long.select(split, group, "p", "x.kind", "x.key")
    return keyed.join(held, ["kind", "key"]).where(F.col("p") < F.col("best")).select(split, group).distinct()


def pruned(rows: DataFrame, fingerprints: list[str], priority: dict[str, int], split: str = "split", group: str = "video") -> DataFrame:
    """The rows without the groups that ``prune_cross_split`` names; what would be empty, or would still
    have a fingerprint in several splits, is an error."""
    kept = rows.join(prune_cross_split(rows, fingerprints, priority, split, group), [split, group], "left_anti").select(rows.columns)
    if kept.isEmpty():
        raise ConstraintError("pruning would empty the rows")
    for f in fingerprints:
        left = kept.where(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").groupBy(f).agg(F.min(split).alias("a"), F.max(split).alias("b"))
        require_none(left.where("a <> b"), f"{f} still in several splits", f)
    return kept


def entity_partition(rows: DataFrame, video: str, entities: str, seed: str, shares: list[tuple[str, float]]) -> DataFrame:
    """(video, root, split): videos that share an entity, directly or over others, get one split.

    A component's split follows from a hash of its least entity and the shares, which add up to 1:
    no split can tear a component and no order of picking matters.
    """
    roots = token_components(rows.select(video, entities).distinct(), video, entities)
    u, below, name = uniform(seed, "root"), 0.0, None
    for split, share in shares:
        below += share
        name = F.when(u < below, split) if name is None else name.when(u < below, split)
    return roots.select(video, "root", name.otherwise(shares[-1][0]).alias("split"))

"""Entity-disjoint selection: video groups are picked for splits one after the other, so that no entity is in two splits.

A pick is the eligible group of least (entities that nobody owns yet, hash), and each pick makes its
entities its split's own, which changes what the next pick finds. Groups that share no free entity, not
even over others, don't change each other's numbers. So the components of groups that share entities are
known beforehand, each bucket of components is picked from on its own, and the buckets' sequences are
merged: a pick comes as soon as the largest (number, hash) of its own sequence up to it is the least among
all buckets. That gives the very picks of one long sequence, and its quota cuts the merged one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import digest, file_name, source_entities, text_of
from millrace.operators.constraints import ConstraintError, require_none
from millrace.operators.graph import components
from millrace.plans.durable import stored

#: Candidates of a bucket, about; components are never torn, and one of more than MOST is an error.
BUCKET, MOST = 20_000, 1_000_000
#: Where fakes of methods that aren't trained on must come from.
ARCHIVE = "archive:test/"

_CANDIDATE = "split string, label string, method string, domain string, video string"
PICKED = _CANDIDATE + ", entities array<string>, pick int"


@dataclass(frozen=True)
class PartitionSpec:
    """Methods by split, groups wanted of each of its methods by split and domain, and the order in which
    splits choose. Reals are matched: as many groups as all of a split's methods want in a domain."""

    seed: str
    methods: dict[str, list[str]]
    targets: dict[str, dict[str, int]]
    order: tuple[str, ...] = ("test", "validation", "train")
    trained: str = "train"
    stages: list[tuple[str, str | None, dict[str, int]]] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        """Fakes of each method come first, then reals; a stage is (split, method or None, quotas)."""
        if unknown := sorted(({*self.methods} | {*self.targets}) - {*self.order}):
            raise ConstraintError(f"splits without a place in the order: {', '.join(unknown)}")
        owned = [m for ms in self.methods.values() for m in ms]
        if len(set(owned)) < len(owned):
            raise ConstraintError("a method belongs to several splits")
        fakes = [(s, m, self.targets.get(s, {})) for s in self.order for m in self.methods.get(s, [])]
        reals = [(s, None, {d: n * len(self.methods.get(s, [])) for d, n in self.targets.get(s, {}).items()}) for s in self.order]
        object.__setattr__(self, "stages", [(s, m, {d: n for d, n in q.items() if n > 0}) for s, m, q in fakes + reals])


def eligible_rows(rows: DataFrame, spec: PartitionSpec) -> DataFrame:
    """Catalog rows that the protocol may use: fakes of a known method, those of trained methods from the
    official training rows and all others from the test archives; every real row."""
    owner = F.create_map(*[F.lit(x) for s, ms in spec.methods.items() for m in ms for x in (m, s)])
    own = F.element_at(owner, F.col("fake_method"))
    place = F.when(own == spec.trained, F.col("split") == spec.trained).otherwise(F.startswith("source_json", F.lit(ARCHIVE)))
    return rows.where((F.col("label") != "FAKE") | F.coalesce(own.isNotNull() & place, F.lit(False)))


def candidates_of(rows: DataFrame, entities: Column | None = None) -> DataFrame:
    """(label, method, domain, video, entities): one row for each video of a method, and for each real one.
    Entities are by default those that the video's name tells; videos without any are left out."""
    named = entities if entities is not None else source_entities(F.col("source_domain"), F.col("video_id"))
    fake = F.col("label") == "FAKE"
    each = rows.select(F.when(fake, "FAKE").otherwise("REAL").alias("label"), F.when(fake, F.col("fake_method")).otherwise("").alias("method"),
                       F.col("source_domain").alias("domain"), F.col("video_id").alias("video"), F.array_sort(F.array_distinct(named)).alias("entities"))
    return each.groupBy("label", "method", "domain", "video").agg(F.first("entities").alias("entities")).where(F.size("entities") > 0)


def _sequence(rows: pd.DataFrame) -> pd.DataFrame:
    """Picks of one bucket in order, up to the quota. ``free`` are a group's entities that nobody owns."""
    if len(rows) > MOST:
        raise ValueError(f"{len(rows)} candidates hang together over their entities; {MOST} fit a task")
    hashes, names, free = rows["hash"].tolist(), rows["video"].tolist(), [set(x) for x in rows["free"]]
    sharing: dict[str, list[int]] = {}
    for i, mine in enumerate(free):
        for e in mine:
            sharing.setdefault(e, []).append(i)
    left = [len(x) for x in free]
    heap = [(left[i], hashes[i], names[i], i) for i in range(len(rows))]
    heapify(heap)
    picked, out, top = [False] * len(rows), [], (0, "")
    while heap and len(out) < rows["quota"].iloc[0]:
        n, hashed, _, i = heappop(heap)
        if picked[i] or n != left[i]:
            continue
        picked[i] = True
        top = max(top, (n, hashed))
        out.append((rows["domain"].iloc[0], names[i], rows["entities"].iloc[i], top[0], top[1], rows["bucket"].iloc[0], len(out)))
        for e in free[i]:
            for j in sharing.pop(e, ()):
                left[j] -= 1
                if not picked[j]:
                    heappush(heap, (left[j], hashes[j], names[j], j))
    return pd.DataFrame(out, columns=["domain", "video", "entities", "top_new", "top_hash", "bucket", "place"])


def _stage(pool: DataFrame, owned: DataFrame | None, split: str, method: str | None, quotas: dict[str, int], seed: str) -> DataFrame:
    """The picks of one stage in all domains (see the module); ``owned`` (domain, entity, split)."""
    label, salt = ("REAL", [F.lit("real"), F.lit(split)]) if method is None else ("FAKE", [F.lit(split), F.lit(method)])
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col("domain"))
    some = pool.where((F.col("label") == label) & (F.col("method") == (method or "")) & F.col("domain").isin(*quotas))
    each = some.select("domain", "bucket", "video", "entities", F.explode("entities").alias("entity"))
    if owned is None:
        each = each.withColumn("owner", F.lit(None).cast("string"))
    else:
        each = each.join(owned.withColumnRenamed("split", "owner"), ["domain", "entity"], "left")
    foreign = F.coalesce(F.bool_or(F.col("owner") != split), F.lit(False))
    able = each.groupBy("domain", "bucket", "video").agg(
        F.first("entities").alias("entities"), foreign.alias("foreign"), F.collect_set(F.when(F.col("owner").isNull(), F.col("entity"))).alias("free")).where(~F.col("foreign"))
    ready = able.select("domain", "bucket", "video", "entities", "free", quota.alias("quota"), digest(F.lit(seed), *salt, "domain", "video").alias("hash"))
    drawn = ready.groupBy("domain", "bucket").applyInPandas(_sequence, "domain string, video string, entities array<string>, top_new long, top_hash string, bucket long, place long")
    order = Window.partitionBy("domain").orderBy("top_new", "top_hash", "bucket", "place")
    most = max(quotas.values())  # tells Spark to keep only so many of a domain in each task
    ranked = drawn.withColumn("pick", F.row_number().over(order)).where((F.col("pick") <= most) & (F.col("pick") <= quota))
    return ranked.select(F.lit(split).alias("split"), F.lit(label).alias("label"), F.lit(method or "").alias("method"), "domain", "video", "entities", "pick")


def disjoint_partition(candidates: DataFrame, spec: PartitionSpec) -> DataFrame:
    """(split, label, method, domain, video, entities, pick): the picks of every stage, in its order.

    In a stage a split picks groups of one method, or reals, in each domain up to its quota: always the
    group of least (entities not owned yet, hash, name) of which no other split owns an entity. A real is
    picked for one split only. Stages with fewer eligible groups than wanted give what there is
    (``partition_shortfalls`` names them). Domains know their own entities only. Repeated candidates count
    once; those without entities never. Ties of hash go by name. No candidates give no picks.
    """
    spark = candidates.sparkSession
    once = candidates.where(F.size("entities") > 0).groupBy("label", "method", "domain", "video").agg(F.min("entities").alias("entities"))
    own = F.transform("entities", lambda e: F.concat(F.col("domain"), F.lit("\0"), e))
    rows = once.withColumn("node", F.array_min(own))
    links = rows.select(F.col("node").alias("a"), F.explode(own).alias("b"))
    roots = components(links)
    found = rows.join(roots.withColumnRenamed("label", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    buckets = max(1, ceil(once.count() / BUCKET))
    pool = stored(found.select("label", "method", "domain", "video", "entities", F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket")))
    out, owned = None, None
    for split, method, quotas in spec.stages:
        if quotas:
            picks = stored(_stage(pool, owned, split, method, quotas, spec.seed))
            out = picks if out is None else out.unionByName(picks)
            new = picks.select("domain", F.explode("entities").alias("entity"), "split").distinct()
            owned = stored(new if owned is None else owned.unionByName(new).distinct())
            if method is None:  # a real belongs to one split
                pool = pool.join(picks.select("label", "method", "domain", "video"), ["label", "method", "domain", "video"], "left_anti")
    return spark.createDataFrame([], PICKED) if out is None else out


def partition_shortfalls(picked: DataFrame, spec: PartitionSpec) -> DataFrame:
    """(split, method, domain, target, picked) of stages that got fewer groups than they want; reals have
    the method ``real``."""
    wanted = picked.sparkSession.createDataFrame([(s, m or "real", d, n) for s, m, q in spec.stages for d, n in q.items()], "split string, method string, domain string, target long")
    cells = picked.groupBy("split", F.when(F.col("label") == "REAL", "real").otherwise(F.col("method")).alias("method"), "domain").agg(F.count(F.lit(1)).alias("picked"))
    met = wanted.join(cells, ["split", "method", "domain"], "left").withColumn("picked", F.coalesce("picked", F.lit(0)).cast("long"))
    return met.where("picked < target")


def partition_rows(rows: DataFrame, picked: DataFrame, spec: PartitionSpec) -> DataFrame:
    """The eligible catalog rows of picked groups, with the split, lineage, path and id that these give them.
    Two rows of one path are an error, and so is a stage without all groups that it wants."""
    require_none(partition_shortfalls(picked, spec), "too few disjoint groups", "split", "method", "domain", "picked", "target")
    fake = F.col("label") == "FAKE"
    chosen = picked.select("label", F.col("method").alias("picked_method"), F.col("domain").alias("source_domain"), F.col("video").alias("video_id"), F.col("split").alias("picked_split"), "entities")
    keyed = eligible_rows(rows, spec).withColumn("label", F.when(fake, "FAKE").otherwise("REAL")).withColumn("picked_method", F.when(fake, F.col("fake_method")).otherwise(""))
    met = keyed.join(chosen, ["label", "picked_method", "source_domain", "video_id"])
    video = F.regexp_replace("video_id", F.concat(F.lit("^"), F.col("source_domain"), F.lit(":")), F.lit(""))
    path = F.concat_ws("/", F.lit("images"), "source_domain", F.when(F.col("picked_method") == "", "real").otherwise(F.col("picked_method")), "picked_split",
                       F.when(text_of("compression") == "", "none").otherwise(F.col("compression")), video, F.concat(F.substring(F.sha2("source_path", 256), 1, 12), F.lit("_"), file_name(F.col("source_path"))))
    told = {"split": F.col("picked_split"), "lineage_video_ids": F.array_join("entities", "|"), "relative_path": path, "image_id": F.substring(F.sha2(path, 256), 1, 24)}
    out = met.select(*(told.get(c, F.col(c)).alias(c) for c in rows.columns), *(told[c].alias(c) for c in told if c not in rows.columns))
    require_none(out.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "one path for several rows", "relative_path")
    return out


def owners_in_conflict(picked: DataFrame) -> DataFrame:
    """(domain, entity, splits) of entities in several splits; a partition has none."""
    each = picked.select("domain", F.explode("entities").alias("entity"), "split").distinct()
    return each.groupBy("domain", "entity").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)

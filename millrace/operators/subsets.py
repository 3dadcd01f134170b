"""Subsets by quotas of split, method and domain, from a checked specification."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import digest, frame_order, group_key, text_of
from millrace.operators.constraints import ConstraintError, require_columns, require_none
from millrace.operators.sampling import picked_positions
from millrace.plans.durable import stored


@dataclass(frozen=True)
class SplitRule:
    """A split's fake methods, and of each at most so many images in so many groups, with so many of a
    group; ``domains`` gives each domain a quota of images of its own instead."""

    methods: tuple[str, ...]
    images: int
    groups: int
    frames: int
    domains: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class SubsetSpec:
    """What to select: rules by split, the columns that rows are told by, and how strict to be."""

    seed: str
    rules: dict[str, SplitRule]
    id: str
    label: str
    split: str
    method: str
    domain: str
    group_columns: tuple[str, ...]
    frame: str | None = None
    fake: str = "FAKE"
    real: str = "REAL"
    ratio: float = 1.0
    strict: bool = True
    disjoint: str = "train-test"


def _key(name: str) -> str:
    return name.strip().lower()


def _checked(value: object, want: str, where: str, faults: list[str], least: float = 1) -> object:
    kinds = {"text": str, "whole number": int, "number": (int, float), "yes or no": bool, "list of texts": (list, tuple), "mapping": dict}
    fine = isinstance(value, kinds[want]) and (want == "yes or no" or not isinstance(value, bool))
    if fine and want == "list of texts":
        fine = len(value) > 0 and all(isinstance(x, str) and x.strip() for x in value)
    if fine and want == "text":
        fine = bool(value.strip())
    if not fine:
        faults.append(f"{where} must be a {want}")
    elif want in ("whole number", "number") and not least <= value < float("inf"):
        faults.append(f"{where} must be at least {least:g}")
    return value


def _known(raw: dict, kind: type, where: str, faults: list[str]) -> None:
    names = {f.name for f in fields(kind)}
    needed = {f.name for f in fields(kind) if f.default is f.default_factory}  # neither has a default
    faults += [f"{where}{k} is unknown" for k in sorted(map(str, set(raw) - names))] + [f"{where}{k} is missing" for k in sorted(needed - set(raw))]


def spec_of(raw: object) -> SubsetSpec:
    """The specification that a nested mapping says, as read from YAML or JSON. All that is wrong with it is
    named in one error: unknown and missing names, other types, numbers out of range, methods of several
    splits."""
    if not isinstance(raw, dict):
        raise ConstraintError("a subset's specification must be a mapping")
    faults: list[str] = []
    _known(raw, SubsetSpec, "", faults)
    kinds = {"ratio": "number", "strict": "yes or no", "group_columns": "list of texts", "rules": "mapping"}
    out = {k: _checked(v, kinds.get(k, "text"), k, faults, 0) for k, v in raw.items() if k in {f.name for f in fields(SubsetSpec)} and not (k == "frame" and v is None)}
    if out.get("disjoint", "none") not in ("train-test", "all", "none"):
        faults.append("disjoint must be train-test, all or none")
    rules = {}
    for split, rule in (raw.get("rules") or {}).items() if isinstance(raw.get("rules"), dict) else ():
        where = f"rules.{split}"
        if not isinstance(rule, dict):
            faults.append(f"{where} must be a mapping")
            continue
        _known(rule, SplitRule, f"{where}.", faults)
        told = {k: _checked(v, {"methods": "list of texts", "domains": "mapping"}.get(k, "whole number"), f"{where}.{k}", faults) for k, v in rule.items() if k in {f.name for f in fields(SplitRule)}}
        for domain, n in told["domains"].items() if isinstance(told.get("domains"), dict) else ():
            _checked(n, "whole number", f"{where}.domains.{domain}", faults)
        rules[str(split)] = told
    if "rules" in raw and not rules:
        faults.append("rules must name a split")
    if not faults:
        split_rules = {s: SplitRule(tuple(r["methods"]), r["images"], r["groups"], r["frames"], dict(r.get("domains", {}))) for s, r in rules.items()}
        spec = SubsetSpec(**out | {"rules": split_rules, "group_columns": tuple(raw["group_columns"])})
        faults += _shared_methods(spec)
        if not faults:
            return spec
    raise ConstraintError("; ".join(faults))


def _shared_methods(spec: SubsetSpec) -> list[str]:
    """Methods that splits share which must not, and methods that a split names twice."""
    owners: dict[str, list[str]] = {}
    for split, rule in spec.rules.items():
        for m in map(_key, rule.methods):
            owners.setdefault(m, []).append(split)
    apart = {"all": lambda s: len(s) > 1, "train-test": lambda s: {"train", "test"} <= set(s), "none": lambda s: False}[spec.disjoint]
    return [f"{m} is a method of {' and '.join(s)}" for m, s in sorted(owners.items()) if len(set(s)) < len(s) or apart(s)]


#: (split, method, domain): a cell of fakes; its domain is empty where a method has one quota for all.
CELL = ["cell_split", "cell_method", "cell_domain"]


def _cells(rows: DataFrame, spec: SubsetSpec) -> DataFrame:
    """A row for each wanted cell: method as written, its key, images, groups, frames."""
    wanted = [(s, m, _key(m), d, n, r.groups, r.frames) for s, r in spec.rules.items() for m in r.methods for d, n in (sorted(r.domains.items()) or [("", r.images)])]
    return rows.sparkSession.createDataFrame(wanted, "cell_split string, cell_method string, method_key string, cell_domain string, images long, groups long, frames long")


def _taken(sizes: DataFrame, cell: list[str], rank: Column, images: Column, frames: Column, groups: Column | None = None) -> DataFrame:
    """Groups by rank with ``take``: what each gives until its cell has its images. What the groups before
    give is a running sum."""
    within = Window.partitionBy(*cell).orderBy("rank_hash", "selection_group")
    ranked = sizes.withColumn("rank_hash", rank).withColumn("rank", F.row_number().over(within))
    if groups is not None:
        ranked = ranked.where(F.col("rank") <= groups)
    most = F.least(F.col("n"), frames)
    before = F.coalesce(F.sum(most).over(Window.partitionBy(*cell).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("take", F.least(most, images - before)).where(F.col("take") > 0)


def _frames(rows: DataFrame, taken: DataFrame, keys: list[str], spec: SubsetSpec, role: str, columns: list[str]) -> DataFrame:
    """The evenly spaced rows of each chosen group, as many as it gives."""
    met = rows.join(taken.select(*keys, "take"), keys)
    within = Window.partitionBy(*keys)
    order = [*(frame_order(F.col(spec.frame)) if spec.frame else []), text_of(spec.id)]
    placed = met.withColumn("position", F.row_number().over(within.orderBy(*order)).cast("long") - 1).withColumn("group_rows", F.count(F.lit(1)).over(within))
    return placed.where(picked_positions("group_rows", "take", "position")).select(*columns, "selection_group", F.lit(role).alias("selection_role"))


def select_subset(rows: DataFrame, spec: SubsetSpec) -> tuple[DataFrame, DataFrame]:
    """(the chosen rows with selection_group and selection_role, shortfalls).

    Of each wanted method, or method and domain, groups come by a hash of the seed and give up to ``frames``
    evenly spaced rows until the quota of images is met; then, in each split and domain, real groups give as
    many rows as there are fakes, times ``ratio``. Shortfalls (split, method, domain, wanted, selected) are
    an error if the specification is strict. So are a configured method that a split lacks, a chosen id
    twice, an empty choice. A group is told by the first of ``group_columns`` that a row has, else its id.
    Methods are compared without case and outer spaces. The chosen rows are a stored table.
    """
    require_columns(rows, [spec.id, spec.label, spec.split, spec.method, spec.domain, *spec.group_columns, *([spec.frame] if spec.frame else [])])
    if told := _shared_methods(spec):
        raise ConstraintError("; ".join(told))
    columns = rows.columns
    named = rows.withColumns({"selection_group": group_key(list(spec.group_columns), spec.id), "method_key": F.lower(F.trim(text_of(spec.method))), "cell_split": F.col(spec.split)})
    cells = _cells(rows, spec)
    fakes = named.where(F.col(spec.label) == spec.fake)
    here = fakes.select("cell_split", "method_key").distinct()
    require_none(cells.join(here, ["cell_split", "method_key"], "left_anti"), "splits without a configured method", "cell_split", "cell_method")
    by_domain = [s for s, r in spec.rules.items() if r.domains]
    own_domain = F.when(F.col("cell_split").isin(*by_domain), text_of(spec.domain)).otherwise("") if by_domain else F.lit("")
    placed = fakes.withColumn("cell_domain", own_domain).join(F.broadcast(cells), ["cell_split", "method_key", "cell_domain"])
    sizes = placed.groupBy(*CELL, "images", "groups", "frames", "selection_group").agg(F.count(F.lit(1)).alias("n"))
    rank = digest(F.lit(spec.seed), "cell_split", "cell_method", "selection_group")
    taken = _taken(sizes, CELL, rank, F.col("images"), F.col("frames"), F.col("groups"))
    chosen_fakes = stored(_frames(placed, taken, [*CELL, "selection_group"], spec, "fake", [*columns, "cell_split", "cell_method", "cell_domain"]))

    frames = F.element_at(F.create_map(*[F.lit(x) for s, r in spec.rules.items() for x in (s, r.frames)]), F.col("cell_split"))
    target = chosen_fakes.groupBy("cell_split", text_of(spec.domain).alias("real_domain")).agg(F.ceil(F.count(F.lit(1)) * F.lit(spec.ratio)).cast("long").alias("target"))
    reals = named.where(F.col(spec.label) == spec.real).withColumn("real_domain", text_of(spec.domain))
    real_cell = ["cell_split", "real_domain"]
    real_sizes = reals.groupBy(*real_cell, "selection_group").agg(F.count(F.lit(1)).alias("n")).join(target, real_cell)
    real_rank = digest(F.lit(spec.seed), "cell_split", F.lit("real"), "real_domain", "selection_group")
    real_taken = stored(_taken(real_sizes, real_cell, real_rank, F.col("target"), frames))
    chosen_reals = _frames(reals, real_taken, [*real_cell, "selection_group"], spec, "real", columns)

    got = chosen_fakes.groupBy(*CELL).agg(F.count(F.lit(1)).alias("selected"))
    short_fakes = cells.join(got, CELL, "left").select(
        F.col("cell_split").alias("split"), F.col("cell_method").alias("method"), F.col("cell_domain").alias("domain"), F.col("images").alias("wanted"), F.coalesce("selected", F.lit(0)).cast("long").alias("selected"))
    got_reals = real_taken.groupBy(*real_cell).agg(F.sum("take").cast("long").alias("selected"))
    short_reals = target.join(got_reals, real_cell, "left").select(
        F.col("cell_split").alias("split"), F.lit(spec.real).alias("method"), F.col("real_domain").alias("domain"), F.col("target").alias("wanted"), F.coalesce("selected", F.lit(0)).cast("long").alias("selected"))
    shortfalls = short_fakes.unionByName(short_reals).where("selected < wanted")
    if spec.strict:
        require_none(shortfalls, "quotas that aren't met", "split", "method", "domain", "selected", "wanted")
    chosen = stored(chosen_fakes.select(*columns, "selection_group", "selection_role").unionByName(chosen_reals))
    if chosen.isEmpty():
        raise ConstraintError("nothing was selected")
    require_none(chosen.groupBy(spec.id).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "ids chosen twice", spec.id)
    return chosen, shortfalls


def selection_report(chosen: DataFrame, shortfalls: DataFrame, spec: SubsetSpec) -> dict:
    """What an artifact tells of a selection: rows by split, label, method and domain, and the shortfalls.
    Both are as many as there are cells, not rows."""
    names = [spec.split, spec.label, spec.method, spec.domain]
    counts = chosen.groupBy(*(text_of(c).alias(c) for c in names)).agg(F.count(F.lit(1)).alias("images")).orderBy(*names).collect()
    short = shortfalls.orderBy("split", "method", "domain").collect()
    return {"selection_counts": [r.asDict() for r in counts], "quota_shortfalls": [r.asDict() for r in short]}

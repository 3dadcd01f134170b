"""Rows to members of ZIP archives: listing by central directories, unique matches, selective extraction.

Everything is resolved before anything is written. An archive is never read whole: its listing is its
central directory, and a member is its own range of bytes, so archives may have any size.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import text_of, unsafe_path
from millrace.operators.constraints import ConstraintError, require_columns, require_none
from millrace.plans.durable import cut
from millrace.sources.stores import LISTED, chunks, file_crc, file_paths, place, write_whole

#: The archives of published methods and of real sources, the folders in front of source
#: paths, and the names that archives have for folders of real sources.
FAKE_ARCHIVES = {
    "blendface": "blendface.zip", "dit": "DiT.zip", "facedancer": "facedancer.zip", "fomm": "fomm.zip", "mcnet": "mcnet.zip", "mraa": "MRAA.zip",
    "rddm": "RDDM.zip", "sadtalker": "sadtalker.zip", "sd21": "sd2.1.zip", "simswap": "simswap.zip", "starganv2": "starganv2.zip",
    "stylegan2": "StyleGAN2.zip", "stylegan3": "StyleGAN3.zip", "uniface": "uniface.zip", "wav2lip": "wav2lip.zip",
}
REAL_ARCHIVES = {"ff": "real/FaceForensics++_real_data_for_DF40.zip", "cdf": "real/Celeb-DF-v2_real_data_for_DF40.zip", "celeba": "test/starganv2.zip"}
SOURCE_FOLDER, POOL_FOLDERS = "deepfakes_detection_datasets/", ("DF40_train/", "DF40/")
RENAMED_FOLDERS = {"/YouTube-real/": "/Fake_from_Youtube-real/", "/Celeb-real/": "/Fake_from_Celeb-real/"}
DROPPED_FOLDERS = ("/ff/", "/cdf/")

_MEMBER = "archive string, path string, member string, size long, crc long, offset long, packed long, method int"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


@dataclass(frozen=True)
class Layout:
    """Where rows' files lie: archive names by method and real domain, and how folders are written."""

    fakes: dict[str, str] = field(default_factory=lambda: dict(FAKE_ARCHIVES))
    reals: dict[str, str] = field(default_factory=lambda: dict(REAL_ARCHIVES))
    folder: str = SOURCE_FOLDER
    pools: tuple[str, ...] = POOL_FOLDERS
    renamed: dict[str, str] = field(default_factory=lambda: dict(RENAMED_FOLDERS))
    dropped: tuple[str, ...] = DROPPED_FOLDERS


def archive_members(files: DataFrame) -> DataFrame:
    """All members, folders left out, of archives (path, name): archive, path, member, size, crc, offset,
    packed (bytes in the archive), method (of compression). Each archive's directory is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split() for f in _MEMBER.split(", ")]
        for batch in batches:
            for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist()):
                store, at = place(path)
                with store.open_input_file(at) as stream, zipfile.ZipFile(stream) as z:
                    found = [m for m in z.infolist() if not m.is_dir()]
                for lo in range(0, len(found), LISTED):
                    rows = [(name, path, m.filename, m.file_size, m.CRC, m.header_offset, m.compress_size, m.compress_type) for m in found[lo : lo + LISTED]]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), _KINDS[k]) for x, (_, k) in zip(zip(*rows), names)], names=[n for n, _ in names])

    return files.select("path", "name").repartition("path").mapInArrow(run, _MEMBER)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Members of every ``.zip`` below a folder; ``archive`` is the path from the folder on."""
    return archive_members(file_paths(spark, folder, "*.zip"))


def _error(message: str, *parts: Column, kind: str = "string") -> Column:
    return F.raise_error(F.concat(F.lit(message), *(text_of(p) for p in parts))).cast(kind)


def _named(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def archive_of(layout: Layout) -> Column:
    """The archive of a row by label, domain, method and split; what has none is an error."""
    pool = F.when(F.col("split") == "train", "train/").when(F.col("split").isin("validation", "test"), "test/").otherwise(_error("no pool for split ", F.col("split")))
    fake = F.coalesce(_named(layout.fakes, F.col("fake_method")), _error("no archive for method ", F.col("fake_method")))
    real = F.coalesce(_named(layout.reals, F.col("source_domain")), _error("no archive for real domain ", F.col("source_domain")))
    return F.when(F.col("label") == "REAL", real).when(F.col("label") == "FAKE", F.concat(pool, fake)).otherwise(_error("no archive for label ", F.col("label")))


def _without(c: Column, start: str) -> Column:
    return F.when(F.startswith(c, F.lit(start)), F.substring(c, F.lit(len(start) + 1), F.length(c))).otherwise(c)


def _first_replaced(c: Column, old: str, new: str) -> Column:
    at = F.instr(c, F.lit(old))
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def member_candidates(layout: Layout) -> Column:
    """Names that a row's member may have in its archive: with and without the method's folder, folders of
    real sources renamed, a domain's folder dropped. A source path outside the layout is an error."""
    source = F.when(F.startswith("source_path", F.lit(layout.folder)) & ~unsafe_path(F.col("source_path")), _without(F.col("source_path"), layout.folder)).otherwise(
        _error("unknown source path: ", F.col("source_path")))
    real = F.when(F.col("source_domain") == "celeba", _without(source, layout.pools[-1])).otherwise(source)
    inner = _error("unknown pool of a fake's source path: ", F.col("source_path"))
    for pool in reversed(layout.pools):
        inner = F.when(F.startswith(source, F.lit(pool)), _without(source, pool)).otherwise(inner)
    names = F.array(inner, F.when(F.instr(inner, F.lit("/")) > 0, F.substring(inner, F.instr(inner, F.lit("/")) + 1, F.length(inner))).otherwise(""))
    for rules in (tuple(layout.renamed.items()), tuple((d, "/") for d in layout.dropped)):
        names = F.flatten(F.transform(names, lambda c: F.array(c, *(_first_replaced(c, old, new) for old, new in rules))))
    return F.when(F.col("label") == "REAL", F.array(real)).otherwise(F.array_distinct(F.filter(names, lambda c: c != "")))


#: What a row must tell to find its member.
RESOLVED = ("relative_path", "source_path", "split", "label", "fake_method", "source_domain")


def matched_members(rows: DataFrame, members: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Each row's path and archive with all members that it may mean: relative_path, archive, source_path,
    matches (array of members with path, size, crc, offset, packed, method)."""
    require_columns(rows, list(RESOLVED))
    asked = rows.select("relative_path", "source_path", archive_of(layout).alias("archive"), member_candidates(layout).alias("names"))
    met = asked.select("*", F.explode("names").alias("member")).join(members, ["archive", "member"])
    kinds = [f.split()[0] for f in _MEMBER.split(", ") if f.split()[0] != "archive"]
    found = met.groupBy("relative_path", "archive", "source_path").agg(F.array_sort(F.collect_set(F.struct("member", *(c for c in kinds if c != "member")))).alias("matches"))
    return asked.select("relative_path", "archive", "source_path").join(found, ["relative_path", "archive", "source_path"], "left").withColumn(
        "matches", F.coalesce("matches", F.array().cast(found.schema["matches"].dataType)))


def empty_members(rows: DataFrame, members: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(relative_path) of rows whose one member has no bytes; rows that match none or several aren't named."""
    return matched_members(rows, members, layout).where((F.size("matches") == 1) & (F.get("matches", F.lit(0))["size"] == 0)).select("relative_path").distinct()


def extraction_plan(rows: DataFrame, members: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """One checked row per file: relative_path, archive, path, member, size, crc, offset, packed, method.

    No rows, a destination that isn't below ``images/`` or that two rows have, a missing archive, no or
    several members, and an empty member are errors that name rows, before anything is written.
    """
    require_columns(rows, list(RESOLVED))
    path = F.col("relative_path")
    require_none(rows.where(unsafe_path(path) | ~F.startswith(path, F.lit("images/"))), "unsafe destinations", "relative_path")
    require_none(rows.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "destinations of several rows", "relative_path")
    matched = cut(matched_members(rows, members, layout))
    if matched.isEmpty():
        raise ConstraintError("there is nothing to extract")
    require_none(matched.join(members.select("archive").distinct(), "archive", "left_anti"), "missing archives", "archive")
    n = F.size("matches")
    require_none(matched.where(n != 1).withColumn("found", n), "rows without exactly one member", "archive", "source_path", "found")
    one = matched.select("relative_path", "archive", F.get("matches", F.lit(0)).alias("m")).select("relative_path", "archive", "m.*")
    require_none(one.where("size = 0"), "empty members", "archive", "member")
    require_none(one.where("method NOT IN (0, 8)"), "members of an unknown compression", "archive", "member")
    return one


def member_bytes(stream, offset: int, packed: int, method: int) -> Iterator[bytes]:
    """The content of the member whose local header is at ``offset``: stored (0) or deflated (8)."""
    stream.seek(offset)
    head = stream.read(30)
    if head[:4] != b"PK\x03\x04" or struct.unpack("<H", head[6:8])[0] & 1:
        raise ValueError(f"no readable member at {offset}")
    stream.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    if method == 0:
        yield from chunks(stream, packed)
        return
    unpack = zlib.decompressobj(-15)
    for piece in chunks(stream, packed):
        yield unpack.decompress(piece)
    yield unpack.flush()


def extract(plan: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Write a plan's members below ``root``: (archive, selected, written, reused, bytes_written).

    A file that is there with the member's size and CRC-32 is kept, another one is an error; files are
    written beside their place and renamed, so that a task may run again. Tasks get ranges of archives'
    bytes, in order. With ``dry_run`` nothing is written.
    """
    if dry_run:
        zero = F.lit(0).cast("long")
        return plan.groupBy("archive").agg(F.count(F.lit(1)).alias("selected")).select("archive", "selected", zero.alias("written"), zero.alias("reused"), zero.alias("bytes_written"))

    def one(stream, to: str, member: str, size: int, crc: int, offset: int, packed: int, method: int) -> int:
        there = file_crc(to)
        if there is not None:
            if there != (size, crc):
                raise RuntimeError(f"{to} is there with another content; it isn't overwritten")
            return -1

        def check(*found: int) -> None:
            if found != (size, crc):
                raise OSError(f"the archive's {member} is not what its directory says")

        return write_whole(to, member_bytes(stream, offset, packed, method), check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None
        for batch in batches:
            done: list[tuple[str, int]] = []
            for r in batch.to_pylist():
                if opened is None or opened[0] != r["path"]:
                    if opened:
                        opened[1].close()
                    store, at = place(r["path"])
                    opened = r["path"], store.open_input_file(at)
                done.append((r["archive"], one(opened[1], f"{root.rstrip('/')}/{r['relative_path']}", r["member"], r["size"], r["crc"], r["offset"], r["packed"], r["method"])))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["archive", "n"])
        if opened:
            opened[1].close()

    spread = max(1, plan.sparkSession.sparkContext.defaultParallelism * 4)
    dealt = plan.repartitionByRange(spread, "archive", "offset").sortWithinPartitions("archive", "offset")
    done = cut(dealt.mapInArrow(run, "archive string, n long"))
    return done.groupBy("archive").agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(F.col("n") >= 0).alias("written"), F.count_if(F.col("n") < 0).alias("reused"), F.sum(F.greatest("n", F.lit(0))).alias("bytes_written"))


def suffix_members(rows: DataFrame, name: str, members: DataFrame) -> DataFrame:
    """Rows with the one member whose path ends with ``name``, at a slash: the rows' columns, archive, path,
    member, size, crc, offset, packed, method. No or several members are an error.

    A member is known by each of its endings, so that rows meet it by equality.
    """
    parts = F.split("member", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    met = rows.withColumn("row_no", F.monotonically_increasing_id())
    met = cut(met).alias("r").join(members.select("*", F.explode(F.array_distinct(endings)).alias("ending")).alias("m"), F.col(f"r.{name}") == F.col("m.ending"), "left")
    counts = met.groupBy("r.row_no").agg(F.count("m.member").alias("found"), F.first(f"r.{name}").alias("wanted"))
    require_none(counts.where("found <> 1"), "rows without exactly one member", "wanted", "found")
    return met.select("r.*", *(f"m.{f.split()[0]}" for f in _MEMBER.split(", "))).drop("row_no")


def prepare_media(rows: DataFrame, name: str, members: DataFrame, root: str, split: str = "split") -> DataFrame:
    """(media_id, path) of the test rows, whose files are extracted below ``root`` where they aren't there yet.

    ``name`` is how a row's member ends in its archive; the member's own path is its place below ``root``.
    Two rows of one member are an error, as are those of ``suffix_members``.
    """
    found = suffix_members(rows.where(F.col(split) == "test"), name, members)
    require_none(found.groupBy("archive", "member").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "members of several rows", "archive", "member")
    require_none(found.where(unsafe_path(F.col("member"))), "unsafe members", "archive", "member")
    require_none(found.where("method NOT IN (0, 8)"), "members of an unknown compression", "archive", "member")
    plan = found.withColumn("relative_path", F.col("member"))
    require_none(plan.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "destinations of several rows", "relative_path")
    extract(plan, root).collect()  # a row for each archive
    return plan.select("media_id", F.concat(F.lit(root.rstrip("/") + "/"), "relative_path").alias("path"))

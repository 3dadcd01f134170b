"""Exports of predictions with their embeddings, joined by position and checked against each other.

An export of a split is ``<split>.jsonl``, ``<split>_metadata.json`` and ``<split>_embeddings.npz``, whose
rows are in the order of the lines. Positions are offsets: lines are counted by file split and numbered from
those counts, and rows of an uncompressed array lie at known bytes, so no task sees a whole file.
"""

from __future__ import annotations

import ast
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import text_of
from millrace.operators.constraints import ConstraintError, require_none
from millrace.plans.durable import cut
from millrace.sources.archives import member_bytes
from millrace.sources.readers import PREDICTION, numbered_lines
from millrace.sources.stores import file_digests, place

#: What an export's metadata must tell.
PROVENANCE = ("manifest_id", "manifest_sha256", "sample_preprocessing_id", "preprocessing_id", "checkpoint_file", "checkpoint_sha256")
#: Rows of an array that a task reads.
SLICE = 20_000


@dataclass(frozen=True)
class StoredArray:
    """An ``.npy`` member of an ``.npz``: where it lies, and the shape and type of its rows."""

    path: str
    offset: int
    packed: int
    method: int
    data: int
    dtype: str
    shape: tuple[int, ...]

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Rows ``lo`` up to ``hi``; of a compressed member all that lies before is unpacked and passed over."""
        store, at = place(self.path)
        first, last, held, seen = self.data + lo * self.row_bytes, self.data + hi * self.row_bytes, [], 0
        with store.open_input_file(at) as stream:
            if self.method == 0:
                stream.seek(self.offset + 26)
                stream.seek(self.offset + 30 + sum(struct.unpack("<HH", stream.read(4))) + first)
                body = stream.read(last - first)
            else:
                for piece in member_bytes(stream, self.offset, self.packed, self.method):
                    held.append(piece[max(0, first - seen) : max(0, last - seen)])
                    seen += len(piece)
                    if seen >= last:
                        break
                body = b"".join(held)
        if len(body) != last - first:
            raise ValueError(f"{self.path} ends before row {hi}")
        return np.frombuffer(body, self.dtype).reshape(hi - lo, *self.shape[1:])


def stored_arrays(path: str) -> dict[str, StoredArray]:
    """The arrays of an ``.npz`` by name; only headers are read. Objects and Fortran order are errors."""
    store, at = place(path)
    out = {}
    with store.open_input_file(at) as stream, zipfile.ZipFile(stream) as z:
        for m in z.infolist():
            with z.open(m) as member:
                start = member.read(8)
                if start[:6] != b"\x93NUMPY":
                    raise ConstraintError(f"{m.filename} in {path} is no array")
                width = "<H" if start[6] == 1 else "<I"
                size = struct.unpack(width, member.read(struct.calcsize(width)))[0]
                head = ast.literal_eval(member.read(size).decode("latin1"))
            if head["fortran_order"] and len(head["shape"]) > 1 or np.dtype(head["descr"]).hasobject:
                raise ConstraintError(f"{m.filename} in {path} can't be read by rows")
            out[m.filename.removesuffix(".npy")] = StoredArray(path, m.header_offset, m.compress_size, m.compress_type, 8 + struct.calcsize(width) + size, head["descr"], tuple(head["shape"]))
    return out


def read_embeddings(spark: SparkSession, path: str, ids: str = "sample_ids", vectors: str = "embeddings", rows: int = SLICE) -> DataFrame:
    """(position, sample_id, embedding) of an ``.npz`` with an array of ids and a matrix of any float type,
    widened to 32 bits. Each task reads its range of rows."""
    arrays = stored_arrays(path)
    if missing := [n for n in (ids, vectors) if n not in arrays]:
        raise ConstraintError(f"{path} lacks {', '.join(missing)}")
    names, matrix = arrays[ids], arrays[vectors]
    if len(matrix.shape) != 2 or len(names.shape) != 1 or names.shape[0] != matrix.shape[0] or np.dtype(matrix.dtype).kind != "f":
        raise ConstraintError(f"{path}: ids {names.shape} and embeddings {matrix.shape} of {matrix.dtype} don't pair")
    n, dim = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column("lo").to_pylist():
                hi = min(n, lo + rows)
                body = matrix.rows(lo, hi).astype(np.float32).reshape(-1)
                told = [x.decode() if isinstance(x, bytes) else str(x) for x in names.rows(lo, hi).tolist()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * dim, pa.int32()), pa.array(body))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi), pa.int64()), pa.array(told, pa.string()), lists], names=["position", "sample_id", "embedding"])

    starts = spark.range(0, n, rows).select(F.col("id").alias("lo")) if n else spark.createDataFrame([], "lo long")
    return starts.repartition(max(1, -(-n // rows)), "lo").mapInArrow(run, "position long, sample_id string, embedding array<float>")


def read_provenance(spark: SparkSession, folder: str, split: str) -> dict:
    """An export's metadata; a key of ``PROVENANCE`` that is missing or empty is an error."""
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/{split}_metadata.json", wholetext=True).collect())
    told = json.loads(text)
    if lacking := [k for k in PROVENANCE if not told.get(k)]:
        raise ConstraintError(f"{folder}/{split} doesn't tell {', '.join(lacking)}")
    return told


def read_export(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, dict]:
    """(prediction rows with position and embedding, metadata) of a split's export.

    These are errors: metadata without its provenance; no rows, an id twice, a row of another split;
    embeddings whose ids aren't those of the lines, in their order; a checkpoint whose path leaves the
    folder, that is missing, or whose SHA-256 isn't the metadata's.
    """
    told = read_provenance(spark, folder, split)
    rows = cut(numbered_lines(spark, f"{folder}/{split}.jsonl").select("position", F.from_json("value", PREDICTION, {"mode": "FAILFAST"}).alias("r")).select("position", "r.*").drop("embedding"))
    if rows.isEmpty():
        raise ConstraintError(f"{folder}/{split}.jsonl is empty")
    require_none(rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR sample_id IS NULL"), "repeated or missing sample ids", "sample_id")
    require_none(rows.where(text_of("split") != split), f"rows that aren't of {split}", "sample_id", "split")
    vectors = read_embeddings(spark, f"{folder}/{split}_embeddings.npz").withColumnRenamed("sample_id", "vector_id")
    met = cut(rows.join(vectors, "position", "full"))
    require_none(met.where(~F.col("sample_id").eqNullSafe(F.col("vector_id"))), "embeddings that aren't aligned with their rows", "position", "sample_id", "vector_id")
    require_checkpoint(spark, folder, told["checkpoint_file"], told["checkpoint_sha256"])
    return met.drop("vector_id"), told


def require_checkpoint(spark: SparkSession, folder: str, name: str, digest: str) -> None:
    """The file ``name`` lies in the folder and has the SHA-256 ``digest``; it is read in chunks by a task."""
    name = str(name)
    if name.startswith("/") or ".." in name.split("/"):
        raise ConstraintError(f"the checkpoint's path leaves the export: {name}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):
        raise ConstraintError(f"the checkpoint is missing: {name}")
    found = file_digests(spark.createDataFrame([(f"{folder}/{name}",)], "path string")).first()
    if found.sha256 != digest:
        raise ConstraintError(f"the checkpoint isn't the one that the metadata names: {name}")


def require_manifest(rows: DataFrame, told: dict, manifest_id: str, manifest_sha256: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """The rows of a manifest, if metadata names that manifest and its rows are of exactly these splits."""
    if (told.get("manifest_id"), told.get("manifest_sha256")) != (manifest_id, manifest_sha256):
        raise ConstraintError(f"another manifest: {told.get('manifest_id')}")
    found = sorted(r[0] for r in rows.select(text_of("split")).distinct().limit(len(splits) + 20).collect())
    if found != sorted(splits):
        raise ConstraintError(f"splits {', '.join(found)} instead of {', '.join(sorted(splits))}")
    return rows

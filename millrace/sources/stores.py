"""Files of any size read by ranges, hashed in chunks and written in one step, inside tasks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20
#: Rows of a listing that are handed on together.
LISTED = 10_000


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it. ``file:`` is every node's own or mounted disk."""
    if re.match(r"^(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def chunks(stream, size: int | None = None) -> Iterator[bytes]:
    """The rest of a stream, or ``size`` bytes of it, in pieces."""
    while size is None or size > 0:
        piece = stream.read(CHUNK if size is None else min(CHUNK, size))
        if not piece:
            return
        size = None if size is None else size - len(piece)
        yield piece


def file_crc(path: str) -> tuple[int, int] | None:
    """(size, CRC-32) of a file, or None where there is none."""
    store, at = place(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    size = crc = 0
    with store.open_input_stream(at) as stream:
        for piece in chunks(stream):
            size, crc = size + len(piece), zlib.crc32(piece, crc)
    return size, crc


def file_sha256(path: str) -> tuple[int, str]:
    """(size, SHA-256) of a file."""
    store, at = place(path)
    digest, size = sha256(), 0
    with store.open_input_stream(at) as stream:
        for piece in chunks(stream):
            digest.update(piece)
            size += len(piece)
    return size, digest.hexdigest()


def write_whole(path: str, pieces: Iterator[bytes], check: Callable[[int, int], None]) -> int:
    """Write a file beside its place, ``check`` its (size, CRC-32) and rename it; returns the size. A task
    that dies leaves a part file, never half a file."""
    store, at = place(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    part, size, crc = f"{folder}/.{name}.{uuid4().hex}.part", 0, 0
    try:
        with store.open_output_stream(part) as out:
            for piece in pieces:
                out.write(piece)
                size, crc = size + len(piece), zlib.crc32(piece, crc)
        check(size, crc)
        store.move(part, at)
    finally:
        if store.get_file_info(part).type == fs.FileType.File:
            store.delete_file(part)
    return size


def file_paths(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, size) of the files below a folder whose names fit the pattern, empty ones too; ``name`` is
    the path from the folder on. A task reads the listing, no file is opened."""
    top = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            store, at = place(top)
            found = [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and fnmatch(x.base_name, pattern)]
            for lo in range(0, len(found), LISTED):
                names = [x.path[len(at.rstrip("/")) + 1 :] for x in found[lo : lo + LISTED]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{top}/{n}" for n in names]), pa.array(names), pa.array([x.size for x in found[lo : lo + LISTED]], pa.int64())], names=["path", "name", "size"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "path string, name string, size long")


def file_digests(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files (path) of any size; each is read in chunks by one task, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                size, digest = file_sha256(path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([digest])], names=["path", "size", "sha256"])

    spread = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    return files.select("path").repartition(spread, "path").mapInArrow(run, "path string, size long, sha256 string")


def single_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The path of the one file below a folder whose name fits the pattern; none or several are an error."""
    found = [r.path for r in file_paths(spark, folder, pattern).limit(6).collect()]
    if len(found) != 1:
        raise ValueError(f"expected one file like {pattern} in {folder}, found {len(found) if len(found) < 6 else 'more'}")
    return found[0]

"""Exports: positions without an ordering task, arrays read by rows, and what is refused."""

import hashlib
import json

import numpy as np
import pytest

from millrace.operators.constraints import ConstraintError
from millrace.sources import exports

N = 500


def write(folder, n=N, order=None, kind=np.float16, compressed=False, told=None, spoil=lambda rows: rows):
    folder.mkdir(exist_ok=True)
    ids = [f"s{i:05}-é" for i in range(n)]
    rows = spoil([{"sample_id": s, "split": "test", "video_id": f"v{i // 3}", "source_domain": "ff", "fake_method": "", "lineage_video_ids": "x", "label": i % 2, "logit": i / 7, "score": 0.5} for i, s in enumerate(ids)])
    (folder / "test.jsonl").write_text("\n".join(json.dumps(r) + ("\n" if i % 50 == 0 else "") for i, r in enumerate(rows)) + "\n")
    vectors = (np.arange(n * 3).reshape(n, 3) / 8).astype(kind)
    (np.savez_compressed if compressed else np.savez)(folder / "test_embeddings.npz", sample_ids=np.array(ids)[order if order is not None else slice(None)], embeddings=vectors)
    (folder / "best.pt").write_bytes(b"weights" * 1000)
    meta = {k: "x" for k in exports.PROVENANCE} | {"checkpoint_file": "best.pt", "checkpoint_sha256": hashlib.sha256(b"weights" * 1000).hexdigest()}
    (folder / "test_metadata.json").write_text(json.dumps(meta | (told or {})))
    return str(folder)


def test_bad_lines_are_named(spark, tmp_path):
    from millrace.sources.readers import read_json_lines

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n[1]\n{"x": 2}\nnonsense\n')
    with pytest.raises(ConstraintError, match=r"a.jsonl, line 3: \[1\]; a.jsonl, line 5: nonsense"):
        read_json_lines(spark, str(tmp_path / "a.jsonl"))
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": null}\n')
    assert sorted(r.x for r in read_json_lines(spark, str(tmp_path / "a.jsonl")).collect()) == ["", "1"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    lines = [f"line {i} " + "x" * (i % 60) for i in range(3000)]
    path.write_text("\n".join(x + ("\n" if i % 11 == 0 else "") for i, x in enumerate(lines)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        df = exports.numbered_lines(spark, str(path))
        got = {r.position: r.value for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(lines))


@pytest.mark.parametrize("kind, compressed", [(np.float16, False), (np.float32, True), (np.float64, False)])
def test_an_export_is_joined_by_position(spark, tmp_path, monkeypatch, kind, compressed):
    monkeypatch.setattr(exports.read_embeddings, "__defaults__", ("sample_ids", "embeddings", 64))
    rows, told = exports.read_export(spark, write(tmp_path / "e", kind=kind, compressed=compressed), "test")
    got = sorted(rows.collect(), key=lambda r: r.position)
    assert told["manifest_id"] == "x" and rows.schema["embedding"].dataType.simpleString() == "array<float>"
    assert [(r.position, r.sample_id) for r in got] == [(i, f"s{i:05}-é") for i in range(N)]
    want = (np.arange(N * 3).reshape(N, 3) / 8).astype(kind).astype(np.float32)
    assert np.array_equal(np.array([r.embedding for r in got], np.float32), want) and got[9].logit == 9 / 7


@pytest.mark.parametrize("change, told", [
    ({"order": np.r_[1, 0, 2:N]}, "aren't aligned"), ({"spoil": lambda r: r[:-1]}, "aren't aligned"), ({"spoil": lambda r: r[:-1] + r[:1]}, "repeated or missing sample ids"),
    ({"spoil": lambda r: r[:-1] + [r[-1] | {"split": "train"}]}, "aren't of test"), ({"spoil": lambda r: []}, "is empty"), ({"told": {"manifest_id": ""}}, "doesn't tell manifest_id"),
    ({"told": {"checkpoint_sha256": "0"}}, "isn't the one"), ({"told": {"checkpoint_file": "../best.pt"}}, "leaves the export"), ({"told": {"checkpoint_file": "none.pt"}}, "missing"),
    ({"kind": np.int32}, "don't pair"),
])
def test_spoilt_exports_are_refused(spark, tmp_path, change, told):
    with pytest.raises(ConstraintError, match=told):
        exports.read_export(spark, write(tmp_path / "e", 40, **({k: v[v < 40] if k == "order" else v for k, v in change.items()})), "test")


def test_arrays_that_cant_be_read_by_rows(spark, tmp_path):
    np.savez(tmp_path / "a.npz", embeddings=np.asfortranarray(np.ones((3, 2))), sample_ids=np.array(["a", "b", "c"]))
    with pytest.raises(ConstraintError, match="can't be read by rows"):
        exports.read_embeddings(spark, str(tmp_path / "a.npz"))
    np.savez(tmp_path / "b.npz", embeddings=np.ones((0, 2), np.float32), sample_ids=np.array([], "U3"))
    assert exports.read_embeddings(spark, str(tmp_path / "b.npz")).count() == 0
    np.savez(tmp_path / "c.npz", embeddings=np.ones((2, 2), np.float32))
    with pytest.raises(ConstraintError, match="lacks sample_ids"):
        exports.read_embeddings(spark, str(tmp_path / "c.npz"))


def test_manifests_are_the_named_ones(spark):
    rows = spark.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    told = {"manifest_id": "m", "manifest_sha256": "h"}
    assert exports.require_manifest(rows, told, "m", "h").count() == 3
    with pytest.raises(ConstraintError, match="another manifest"):
        exports.require_manifest(rows, told, "m", "other")
    with pytest.raises(ConstraintError, match="splits test, train instead"):
        exports.require_manifest(rows.where("split <> 'validation'"), told, "m", "h")

"""Archives: listings, matches, plans that refuse before writing, and extraction that can run again."""

import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.operators.constraints import ConstraintError
from millrace.sources import archives, stores
from millrace.sources.readers import read_payloads, read_zip_listing

ROW = "relative_path string, source_path string, split string, label string, fake_method string, source_domain string, extra int"
TOP = "deepfakes_detection_datasets/"


def row(name, source, label="FAKE", method="simswap", domain="ff", split="train"):
    return f"images/{name}.png", TOP + source, split, label, method if label == "FAKE" else "", domain, 1


ROWS = [
    row("a", "DF40_train/simswap/frames/001/000.png"), row("b", "DF40/DiT/cdf/YouTube-real/00043/458.png", method="dit", domain="cdf", split="test"),
    row("c", "FaceForensics++/original_sequences/youtube/c23/frames/001/000.png", label="REAL"), row("d", "Celeb-DF-v2/YouTube-real/frames/00011/000.png", label="REAL", domain="cdf", split="test"),
    row("e", "DF40/starganv2/real/1007.jpg", label="REAL", domain="celeba", split="test"), row("f", "DF40/fomm/ff/frames/9/1.png", method="fomm", split="validation"),
]
MEMBERS = {
    "train/simswap.zip": {"simswap/frames/001/000.png": b"one" * 700_000, "simswap/frames/001/": b"", "other.png": b"x"},
    "test/DiT.zip": {"DiT/cdf/Fake_from_Youtube-real/00043/458.png": b"dit"}, "real/FaceForensics++_real_data_for_DF40.zip": {"FaceForensics++/original_sequences/youtube/c23/frames/001/000.png": b"ff"},
    "real/Celeb-DF-v2_real_data_for_DF40.zip": {"Celeb-DF-v2/YouTube-real/frames/00011/000.png": b"cdf"}, "test/starganv2.zip": {"starganv2/real/1007.jpg": b"celeba"},
    "test/fomm.zip": {"fomm/frames/9/1.png": b"dropped folders"},
}


@pytest.fixture
def downloads(tmp_path):
    for i, (name, members) in enumerate(MEMBERS.items()):
        path = tmp_path / "down" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if i % 2 == 0 else zipfile.ZIP_STORED) as z:
            for member, body in members.items():
                z.writestr(member, body)
    return tmp_path / "down"


def add(downloads, name, member, body):
    with zipfile.ZipFile(downloads / name, "a") as z:
        z.writestr(member, body)


def test_listing_reads_directories_only(spark, downloads):
    got = {(r.archive, r.member): (r.size, r.crc) for r in archives.read_archives(spark, str(downloads)).collect()}
    assert got == {(a, m): (len(b), zlib.crc32(b)) for a, members in MEMBERS.items() for m, b in members.items() if not m.endswith("/")}
    assert {r.member for r in read_zip_listing(spark, str(downloads / "train")).collect()} == {"simswap/frames/001/000.png", "other.png"}


def test_candidates_follow_the_layouts(spark):
    layout = archives.Layout()
    sources = [("FAKE", "cdf", "DF40/DiT/cdf/YouTube-real/x.png"), ("FAKE", "ff", "DF40_train/m/ff/1.png"), ("FAKE", "ff", "DF40/1.png"), ("REAL", "celeba", "DF40/starganv2/real/1.jpg"), ("REAL", "ff", "DF40/1.png")]
    df = spark.createDataFrame([(label, d, TOP + s) for label, d, s in sources], "label string, source_domain string, source_path string")
    got = [set(r[0]) for r in df.select(archives.member_candidates(layout)).collect()]
    assert got[0] == {"DiT/cdf/YouTube-real/x.png", "cdf/YouTube-real/x.png", "DiT/cdf/Fake_from_Youtube-real/x.png", "cdf/Fake_from_Youtube-real/x.png", "DiT/YouTube-real/x.png", "DiT/Fake_from_Youtube-real/x.png"}
    assert got[1] == {"m/ff/1.png", "ff/1.png", "m/1.png"} and got[2] == {"1.png"} and got[3] == {"starganv2/real/1.jpg"} and got[4] == {"DF40/1.png"}
    for bad in (("FAKE", "ff", "elsewhere/a/1.png"), ("FAKE", "ff", "DF40/../1.png")):
        with pytest.raises(Exception, match="unknown"):
            spark.createDataFrame([(bad[0], bad[1], TOP + bad[2])], df.schema).select(archives.member_candidates(layout)).collect()


def test_extracts_the_selected_and_reuses_what_is_there(spark, downloads, tmp_path):
    rows, members, root = spark.createDataFrame(ROWS, ROW), archives.read_archives(spark, str(downloads)), tmp_path / "data"
    plan = archives.extraction_plan(rows, members)
    assert {tuple(r)[1:] for r in archives.extract(plan, str(root), dry_run=True).collect()} == {(1, 0, 0, 0)} and not root.exists()
    done = {r.archive: (r.selected, r.written, r.reused, r.bytes_written) for r in archives.extract(plan, str(root)).collect()}
    assert done["train/simswap.zip"] == (1, 1, 0, 2_100_000) and len(done) == 6
    want = {"a": b"one" * 700_000, "b": b"dit", "c": b"ff", "d": b"cdf", "e": b"celeba", "f": b"dropped folders"}
    assert {p.stem: p.read_bytes() for p in (root / "images").iterdir()} == want
    before = {p: p.stat().st_mtime_ns for p in (root / "images").iterdir()}
    again = archives.extract(plan, str(root)).collect()
    assert all((r.written, r.reused, r.bytes_written) == (0, 1, 0) for r in again) and before == {p: p.stat().st_mtime_ns for p in (root / "images").iterdir()}
    (root / "images/b.png").write_bytes(b"dot")
    with pytest.raises(Exception, match="isn't overwritten"):
        archives.extract(plan, str(root)).collect()
    assert (root / "images/b.png").read_bytes() == b"dot"


def test_a_member_that_differs_from_its_directory_leaves_no_file(spark, downloads, tmp_path):
    members = archives.read_archives(spark, str(downloads))
    plan = archives.extraction_plan(spark.createDataFrame(ROWS[:1], ROW), members).withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="not what its directory says"):
        archives.extract(plan, str(tmp_path / "data")).collect()
    assert not [p for p in (tmp_path / "data").rglob("*") if p.is_file()]


@pytest.mark.parametrize("change, told", [
    (lambda r: [("images/../x.png", *r[0][1:])], "unsafe destinations"), (lambda r: [("other/x.png", *r[0][1:])], "unsafe destinations"),
    (lambda r: [r[0], r[0]], "destinations of several rows"), (lambda r: [], "nothing to extract"),
    (lambda r: [row("z", "DF40_train/blendface/1.png", method="blendface")], "missing archives"), (lambda r: [*r, row("z", "DF40_train/simswap/none.png")], "exactly one member"),
    (lambda r: [row("z", "DF40_train/nobody/1.png", method="nobody")], "no archive for method"), (lambda r: [row("z", "x.png", label="REAL", domain="web")], "no archive for real domain"),
    (lambda r: [row("z", "x.png", label="MAYBE")], "no archive for label"),
])
def test_plans_refuse_before_anything_is_written(spark, downloads, change, told):
    with pytest.raises(Exception, match=told):
        archives.extraction_plan(spark.createDataFrame(change(ROWS), ROW), archives.read_archives(spark, str(downloads)))


def test_empty_and_ambiguous_members(spark, downloads):
    add(downloads, "test/starganv2.zip", "starganv2/fake/779.jpg", b"")
    add(downloads, "train/simswap.zip", "frames/001/000.png", b"a second place")
    rows = spark.createDataFrame([*ROWS, row("empty", "DF40/starganv2/fake/779.jpg", method="starganv2", domain="celeba", split="test")], ROW)
    members = archives.read_archives(spark, str(downloads))
    assert [r[0] for r in archives.empty_members(rows, members).collect()] == ["images/empty.png"]
    with pytest.raises(ConstraintError, match="exactly one member.*simswap"):
        archives.extraction_plan(rows, members)
    with pytest.raises(ConstraintError, match="empty members: test/starganv2.zip"):
        archives.extraction_plan(rows.where("relative_path <> 'images/a.png'"), members)


def test_members_by_their_ending(spark, downloads):
    members = archives.read_archives(spark, str(downloads))
    df = spark.createDataFrame([("m1", "YouTube-real/frames/00011/000.png"), ("m2", "1007.jpg")], "media_id string, file string")
    assert {(r.media_id, r.member) for r in archives.suffix_members(df, "file", members).collect()} == {("m1", "Celeb-DF-v2/YouTube-real/frames/00011/000.png"), ("m2", "starganv2/real/1007.jpg")}
    for name in ("000.png", "07.jpg", None):
        with pytest.raises(ConstraintError, match="exactly one member"):
            archives.suffix_members(spark.createDataFrame([("m", name)], df.schema), "file", members)


def test_digests_of_files(spark, downloads):
    got = {r.path.rsplit("/", 1)[-1]: (r.size, r.sha256) for r in read_payloads(spark, str(downloads)).collect()}
    assert got == {p.name: stores.file_sha256(str(p)) for p in downloads.rglob("*.zip")}

"""Lists of digests: written once, and every kind of difference is named."""

import hashlib

import pytest

from millrace.operators.constraints import ConstraintError
from millrace.sources import sums


@pytest.fixture
def folder(tmp_path):
    for name, body in (("a.csv", b"1,2\n"), ("deep/er/b.bin", b"x" * 3_000_000), ("empty", b""), ("deep/c d.txt", "é".encode())):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    return tmp_path


def test_lists_are_written_once_and_verified(spark, folder):
    assert sums.write_sums(spark, str(folder)) == 4 == sums.write_sums(spark, str(folder))
    want = {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.rglob("*") if p.is_file() and p.name[0] not in "._" and p.name != sums.SUMS}
    assert (folder / sums.SUMS).read_text() == "".join(f"{want[n]}  {n}\n" for n in sorted(want))
    assert {r.name: r.sha256 for r in sums.require_sums(spark, str(folder)).collect()} == want
    whole = hashlib.sha256((folder / sums.SUMS).read_bytes()).hexdigest()
    assert sums.require_sums(spark, str(folder), whole).count() == 4
    with pytest.raises(ConstraintError, match="isn't the list"):
        sums.require_sums(spark, str(folder), "0" * 64)


def test_every_difference_is_named(spark, folder):
    sums.write_sums(spark, str(folder))
    body = bytearray((folder / "deep/er/b.bin").read_bytes())
    body[2_000_000] ^= 1
    (folder / "deep/er/b.bin").write_bytes(body)
    (folder / "a.csv").rename(folder / "wrong.csv")
    got = {tuple(r) for r in sums.sum_problems(spark, str(folder)).collect()}
    assert got == {("deep/er/b.bin", "changed"), ("a.csv", "missing"), ("wrong.csv", "not listed")}
    with pytest.raises(ConstraintError, match="was changed: a.csv missing; deep/er/b.bin changed; wrong.csv not listed"):
        sums.require_sums(spark, str(folder))
    with pytest.raises(ConstraintError, match="was changed"):
        sums.write_sums(spark, str(folder))


@pytest.mark.parametrize("text, told", [("nonsense\n", "no digest"), ("0" * 64 + "  a\n" + "1" * 64 + "  a\n", "listed twice")])
def test_lists_of_another_form_are_refused(spark, folder, text, told):
    (folder / sums.SUMS).write_text(text)
    with pytest.raises(ConstraintError, match=told):
        sums.require_sums(spark, str(folder))

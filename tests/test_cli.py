"""Commands from a catalog to extracted files."""

import json
import zipfile

from millrace import cli

TOP = "deepfakes_detection_datasets/"


def said(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_from_a_catalog_to_files(spark, tmp_path, capsys):
    lines = ["image_id,relative_path,source_path,label,split,fake_method,source_domain,video_id,frame_index"]
    (tmp_path / "down/train").mkdir(parents=True)
    (tmp_path / "down/real").mkdir()
    with zipfile.ZipFile(tmp_path / "down/train/simswap.zip", "w") as fake, zipfile.ZipFile(tmp_path / "down/real/FaceForensics++_real_data_for_DF40.zip", "w") as real:
        for i in range(24):
            v, k = divmod(i, 4)
            lines.append(f"f{i},images/f{i}.png,{TOP}DF40_train/simswap/frames/{v}/{k}.png,FAKE,train,simswap,ff,fv{v},{k}")
            lines.append(f"r{i},images/r{i}.png,{TOP}FaceForensics++/frames/{v}/{k}.png,REAL,train,,ff,rv{v},{k}")
            fake.writestr(f"simswap/frames/{v}/{k}.png", f"fake {i}")
            real.writestr(f"FaceForensics++/frames/{v}/{k}.png", f"real {i}")
    (tmp_path / "catalog.csv").write_text("\n".join(lines) + "\n")
    spec = {"seed": "s", "id": "image_id", "label": "label", "split": "split", "method": "fake_method", "domain": "source_domain", "group_columns": ["video_id"], "frame": "frame_index",
            "rules": {"train": {"methods": ["simswap"], "images": 6, "groups": 4, "frames": 2}}}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    call = [str(tmp_path / x) for x in ("catalog.csv", "spec.json", "out")]
    assert cli.main(["subset", *call], spark) == 0
    first = said(capsys)
    assert first["quota_shortfalls"] == [] and cli.main(["subset", *call], spark) == 0 and said(capsys)["id"] == first["id"]
    assert cli.main(["verify", first["path"]], spark) == 0 and cli.main(["sums", first["path"], "--verify"], spark) == 0
    capsys.readouterr()
    extraction = ["extract", first["path"], str(tmp_path / "down"), str(tmp_path / "data")]
    assert cli.main([*extraction, "--dry-run"], spark) == 0 and not (tmp_path / "data").exists()
    assert sum(a["selected"] for a in said(capsys)["archives"]) == 12
    assert cli.main(extraction, spark) == 0 and sum(a["written"] for a in said(capsys)["archives"]) == 12
    files = {p.stem: p.read_text() for p in (tmp_path / "data/images").iterdir()}
    assert len(files) == 12 and all(body == f"{'fake' if n[0] == 'f' else 'real'} {n[1:]}" for n, body in files.items())
    assert cli.main(extraction, spark) == 0 and sum(a["reused"] for a in said(capsys)["archives"]) == 12
    assert cli.main(["sums", str(tmp_path / "data")], spark) == 0 and said(capsys) == {"files": 12}
    next((tmp_path / "data/images").iterdir()).write_text("changed")
    assert cli.main(["sums", str(tmp_path / "data"), "--verify"], spark) == 2 and [p["problem"] for p in said(capsys)["problems"]] == ["changed"]
    next((tmp_path / "out").rglob("artifact.json")).write_text('{"digest": "0", "rows": 1}')
    assert cli.main(extraction, spark) == 2 and said(capsys)["ok"] is False

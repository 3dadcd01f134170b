"""Texts are picked by a broadcast of ids or, beyond ``FEW``, by a shuffle: the classes are the same."""

from millrace.llm import near_dups


def test_classes_whichever_way_texts_are_picked(spark, monkeypatch):
    base = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(8)]
    rows = [(n, base[n % 8] + (f" tail{n}" if n % 3 else "")) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for few in (near_dups.FEW, 0):
        monkeypatch.setattr(near_dups, "FEW", few)
        got.append(sorted(map(tuple, near_dups.near_duplicate_classes(docs).collect())))
    assert got[0] == got[1] and len({r[2] for r in got[0]}) == 8

"""What the stages of the pipeline hold in a Python worker: slices, and no other stage's cache."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, pieces, pii
from millrace.llm.tagger import trained

TEXTS = [None, "", "call +1 555 123 4567", *["some plain words"] * 1300, "a@b.example"]


@pytest.fixture
def task(spark, monkeypatch):
    """The function of an Arrow UDF, as a worker calls it."""
    made = []

    def kept(run, kind, make=F.arrow_udf):
        made.append(run)
        return make(run, kind)

    monkeypatch.setattr(F, "arrow_udf", kept)

    def of(column, *model):
        column(F.col("text"), *model)
        return made[-1]

    return of


def test_results_are_yielded_in_slices_of_a_batch(task):
    languages = langid.LanguageModel(("x", "y"), np.eye(2, 1024), langid.ProfileSettings())
    for run, kind in ((task(pii.redacted, trained()), pa.string()), (task(langid.predict_language, languages), None), (task(pieces.encoded, pieces.load_model()), None)):
        out = list(run(iter([pa.array(TEXTS), pa.array([], pa.string()), pa.array(TEXTS[:5])])))
        assert max(map(len, out)) <= 512 and sum(map(len, out)) == len(TEXTS) + 5
        whole = pa.concat_arrays(out).to_pylist()
        assert whole[: len(TEXTS)][:5] == whole[len(TEXTS) :]
        if kind:
            assert whole[:3] == [None, "", "call <PHONE>"] and whole[len(TEXTS) - 1] == "<EMAIL>"


def test_a_task_clears_the_cache_of_another_operator_but_not_its_own(task):
    pieces.codec.cache_clear()
    encode, redact = task(pieces.encoded, pieces.load_model()), task(pii.redacted, trained())
    for _ in range(2):
        list(encode(iter([pa.array(TEXTS[:9])])))
    assert pieces.codec.cache_info()[:2] == (1, 1) and pieces.codec.cache_info().currsize == 1
    list(redact(iter([pa.array(TEXTS[:9])])))
    assert pieces.codec.cache_info().currsize == 0

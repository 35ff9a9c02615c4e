import os

import corpus_pipeline
from wardflow.llm import linededup
from wardflow.llm.common import remove, scratch, stored


def there(df):
    return all(os.path.exists(path.removeprefix("file:").replace("//", "/")) for path in df.inputFiles())


def test_a_scratch_that_ends_empty_takes_no_other_away(spark):
    """Lists of nested scratches are equal while they are empty; what outlives the inner one goes with the outer ones in turn."""
    with scratch() as outer:
        with scratch() as middle:
            for _ in range(2):
                with scratch() as inner:
                    kept = stored(spark.range(3).toDF("x"), "common-kept", outlives=True)
                assert inner == []
            last = stored(spark.range(5).toDF("x"), "common-last", outlives=True)
        assert len(middle) == 2 and len(outer) == 1
        remove(spark, middle)
        assert not there(kept) and last.count() == 5
    remove(spark, outer)


def test_line_dedup_in_passes_as_the_first_stage(spark, small_docs, monkeypatch):
    """The stage begins with nothing stored, as on a new session; every pass ends with an empty scratch."""
    monkeypatch.setattr(linededup, "PASS_SETS", 0)
    monkeypatch.setattr("wardflow.llm.common._STORED", [[]])
    docs = small_docs.limit(60)
    plain = {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}
    monkeypatch.setattr("wardflow.llm.common._STORED", [[]])
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert {r.doc_id: r.text for r in out.collect()} == plain

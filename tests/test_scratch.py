from pathlib import Path

import pytest

from tablereview.functions.scratch import scratch_scope, store


def folder(df):
    return Path(df.inputFiles()[0].removeprefix("file:").replace("//", "")).parent


def test_a_scope_deletes_what_was_written_inside(spark):
    outside = store(spark.range(3), "outside")
    with scratch_scope(spark):
        first = store(spark.range(5), "first")
        with scratch_scope(spark):
            inner = store(spark.range(7), "inner")
            gone = folder(inner)
            assert gone.exists()
        assert not gone.exists() and first.count() == 5
        kept = folder(first)
    assert not kept.exists() and outside.count() == 3


def test_a_scope_deletes_after_an_error(spark):
    with pytest.raises(ValueError, match="no"), scratch_scope(spark):
        held = folder(store(spark.range(5), "first"))
        raise ValueError("no")
    assert not held.exists()

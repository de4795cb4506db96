import corpus_pipeline
import pytest

import __spark_entry__ as entry_module
from tablereview.functions.scratch import store
from tablereview.llm import queries

STAGE_MODULES = ["line_rules", "dedup", "secret_scan", "mixing", "packing"]


def stages(spark, docs, folder):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, folder), name)
        out.append(docs)
    return out


def test_stages(spark, documents, small):
    out = stages(spark, documents, small)
    assert all(x.columns == documents.columns and x.dtypes == documents.dtypes for x in out[:-1])
    kept, single, clean, mixed, packed = (x.collect() for x in out)
    failed = {r.doc_id for r in queries.op4_line_rules(spark, small).collect() if not r.kept}
    assert {r.doc_id for r in kept} == {r.doc_id for r in documents.collect()} - failed
    assert len(single) < len(kept) and len({r.doc_id for r in single}) == len(single)
    assert len(clean) == len(single)
    assert not any("password=" in r.text for r in clean)
    assert all(r.n_chars == len(r.text) for r in clean)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert len({r.row for r in packed}) == len(mixed)
    assert sum(r.n_words for r in packed) == sum(len(r.text.split()) for r in mixed)


def test_odd_rows_pass_through(spark, odd, none):
    assert stages(spark, odd, "")[0].count() == 5
    assert stages(spark, none, "")[-1].count() == 0


def test_all_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_answer_every_row(spark, small, name):
    table = "pages" if name.startswith("op9") else "documents"
    rows = spark.read.parquet(f"{small}/{table}.parquet").count()
    count = queries.QUERIES[name](spark, small).count()
    assert count == rows if name not in ("op1_best_fit_packing", "op10_mix_sources") else count > 0.5 * rows

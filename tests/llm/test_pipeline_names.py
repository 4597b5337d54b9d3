"""Rows keep their columns, whatever these are called."""

import pytest

import corpus_pipeline

BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources], ids=lambda f: f.__name__)
def test_clashing_and_dotted_names(spark, stage):
    names = ["_key", "key", "hash", "row", "number", "at", "rank", "own", "a.b", "kept", "component_id", "copies"]
    rows = [(i, f"text {i} of words that differ w{i} x{i} y{i} z{i} " * 3, "en", f"s{i % 2}", i, *[f"KEEP {i} {n}" for n in names]) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    got = stage(spark, docs, BASE)
    assert got.dtypes == docs.dtypes
    found = got.collect()
    assert found and {tuple(r) for r in found} <= set(rows)

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, found = spark.read.parquet(f"{BASE}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, BASE).write.parquet(out)
        found.append((docs, docs := spark.read.parquet(out)))
    return found


def test_columns(stages):
    for before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    kept = {r.doc_id for r in stages[0][1].select("doc_id").collect()}
    good = [k in kept for k, y in labels.items() if y == 1]
    bad = [k in kept for k, y in labels.items() if y == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / max(1, len(bad)) < 0.35


def test_copies_go(stages):
    from test_exact_dedup import brute as exact
    from test_near_dedup import brute as near

    for (before, after), keepers in ((stages[1], lambda rows: {k for _, k, _ in exact(rows)}), (stages[2], lambda rows: {c for _, c in near(rows).values()})):
        rows = [(r.doc_id, r.text) for r in before.collect()]
        assert Counter(r.doc_id for r in after.collect()) == Counter(keepers(rows))


def test_mix_and_packing(stages):
    before, after = stages[3]
    expected = Counter({r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies})
    assert Counter(r.doc_id for r in after.collect()) == expected
    docs, pieces = stages[4]
    tokens = sum(len(p.ids) // 4 for p in pieces.collect())
    assert tokens == sum(r.doc_tokens for r in pieces.where("start = 0").collect()) and docs.count() == pieces.where("start = 0").count()


def test_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[1:4]:
        for docs in (odd, empty):
            got = stage(spark, docs, BASE)
            assert got.columns == docs.columns, name
            got.collect()
    assert corpus_pipeline.filter_quality(spark, odd, BASE).columns == odd.columns
    assert corpus_pipeline.pack_sequences(spark, odd, BASE).count() >= odd.count()


def test_different_texts_of_one_id_stay(spark):
    words = [f"w{i}" for i in range(60)]
    one, other, third = " ".join(words), " ".join(reversed(words)), " ".join(w + "x" for w in words)
    rows = [(1, one), (1, other), (2, one + " more"), (3, other + " more"), (4, third), (4, third), (None, "a"), (None, "a"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.monotonically_increasing_id())
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, BASE).collect()))
    first = min(one, other, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    # of each group one text stays: that of the smallest number; the further text of id 1 comes after all ids
    expected = [(1, one), (3, other + " more")] if first == one else [(1, other), (2, one + " more")]
    assert got == sorted([(0, "a"), (0, "b"), (4, third), *expected])
    apart = spark.createDataFrame([(1, one), (1, other)], "doc_id long, text string")
    assert {r.text for r in corpus_pipeline.drop_near_copies(spark, apart, BASE).collect()} == {one, other}

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import fingerprints
from tessera.llm.queries import op5_fingerprints
from tessera.llm.shingles import shingle_sets


def test_query_against_brute_force(spark):
    base = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in op5_fingerprints(spark, base).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, following = shingle_sets([text.encode(), edited.encode(), after.encode()])
        assert r.fingerprint == fingerprints.encode(own[: fingerprints.K])
        for value, other in ((r.near_edited, changed), (r.near_next, following)):
            true = len(np.intersect1d(own, other)) / max(1, len(np.union1d(own, other)))
            assert abs(value - true) < 0.25
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_estimates_and_merging(spark):
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64))
    a, b = np.sort(rng.permutation(pool)[:4000]), np.sort(rng.permutation(pool)[:2000])
    sa, sb = a[: fingerprints.K], b[: fingerprints.K]
    union = np.union1d(a, b)
    assert (fingerprints.merge([sa, sb]) == union[: fingerprints.K]).all()
    assert abs(fingerprints.distinct(sa) / 4000 - 1) < 0.3
    assert abs(fingerprints.resemblance(sa, sb) - len(np.intersect1d(a, b)) / len(union)) < 0.15
    assert abs(fingerprints.containment(sb, sa) - len(np.intersect1d(a, b)) / len(b)) < 0.3
    frame = spark.createDataFrame([("k", fingerprints.encode(np.sort(part)[: fingerprints.K])) for part in np.array_split(rng.permutation(union), 9)], "k string, fingerprint string").repartition(4)
    merged = fingerprints.merge_fingerprints(frame, "k").collect()
    assert [r.fingerprint for r in merged] == [fingerprints.encode(union[: fingerprints.K])]


def test_odd_rows(odd, empty):
    got = fingerprints.compare_with_next(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].near_next == 1.0 and by_id[3].near_edited in (0.0, 1.0)
    assert by_id[10].edited == " \t"[:2] + "" or by_id[10].n_chars == 3
    assert fingerprints.compare_with_next(empty).count() == 0
    alone = fingerprints.compare_with_next(odd.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprints.fingerprint_documents(odd).where(F.col("n_shingles") == 0).count() == 4

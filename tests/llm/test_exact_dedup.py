import re
from collections import defaultdict

from hypothesis import given, settings, strategies as st
import pyarrow as pa
import pytest

from tessera.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key or 0, key))
    return {(r[3], min(g)[3], len(g)) for g in groups.values() for r in g}


@pytest.mark.parametrize("table_bytes", [200, 5_000, 48_000_000])
def test_against_brute_force(documents, table_bytes):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = exact_dedup.duplicate_classes(documents.repartition(3), table_bytes=table_bytes).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == brute(rows) and len(got) == len(rows)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = exact_dedup.duplicate_classes(odd).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == brute(rows) and len(got) == len(rows)
    kept = exact_dedup.survivors(odd)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 9, 10]  # ten has the most code points of the blank ones
    assert exact_dedup.duplicate_classes(empty).count() == 0 and exact_dedup.survivors(empty).count() == 0


def test_equal_hashes_are_told_apart():
    table = exact_dedup.ContentTable()
    numbers = [table.slot(7, c) for c in (b"a", b"b", b"a", b"c", b"b")]
    assert numbers == [0, 1, 0, 2, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.text(alphabet="ab \n", max_size=6)), max_size=60))
def test_recursion_keeps_the_best_row(rows):
    schema = pa.schema([("_id", pa.int64()), ("_n", pa.int64()), ("_text", pa.string()), ("_copies", pa.int64()), ("_hash", pa.int64())])
    got = list(exact_dedup.grace([(k, len(t), t, 1, signed(t)) for k, t in rows], schema, table_bytes=300))
    expected = {(keep, size) for _, keep, size in brute(rows)}
    assert sorted((r[0], r[3]) for r in got) == sorted((min(g)[2], len(g)) for g in _groups(rows)) and {(r[0], r[3]) for r in got} == expected


def signed(text):
    hashed = exact_dedup._hash(text)
    return hashed - 2**64 if hashed >= 2**63 else hashed


def _groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), False, key))
    return groups.values()

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import near_dedup, shingles
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def brute(rows):
    """Components by comparing all pairs that share a shingle."""
    sets, parent, holders = {k: shingle_set(t) for k, t in rows}, {k: k for k, _ in rows}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for other in {o for x in s for o in holders[x]}:
            shared = len(s & sets[other])
            if 100 * shared >= 75 * (len(s) + len(sets[other]) - shared):
                parent[find(k)] = find(other)
        for x in s:
            holders[x].append(k)
    least = defaultdict(list)
    for k in sets:
        least[find(k)].append(k)
    return {k: (len(sets[k]), min(g)) for g in least.values() for k in g}


def template(n, edits, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [24, 2])
def test_documents_against_brute_force(documents, small):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents, small=small).collect()}
    assert got == brute(rows)


def test_a_large_group_around_a_template(spark):
    rows = template(150, 9)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, small=8).collect()}
    expected = brute(rows)
    assert got == expected and len({c for _, c in expected.values()}) > 3


@pytest.mark.parametrize("hot_rows", [3, 20])
def test_hot_shingles_are_dealt_out(spark, monkeypatch, hot_rows):
    """A passage that all texts share, most of each text, with links here and there."""
    monkeypatch.setattr(near_dedup, "HOT_ROWS", hot_rows)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(120):
        own = [f"o{i % 60}x{k}" if rng.random() < 0.7 else f"r{rng.randrange(10**6)}" for k in range(rng.randrange(2, 18))]
        rows.append((i, " ".join(passage + own)))
    expected = brute(rows)
    assert len({c for _, c in expected.values()}) > 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=4).collect()}
    assert got == expected


def exploded_shingles(spark):
    """Rows that all plans so far made by listing sets, from the metrics of SQL executions."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for i in range(executions.size()):
        number = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name() == "Generate" and "explode(shingles" in node.desc():
                metrics = node.metrics()
                for metric in (metrics.apply(j) for j in range(metrics.size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        made += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return made


def test_sets_are_listed_once_with_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 4)
    rows = template(60, 12)
    before = exploded_shingles(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=4).collect()}
    assert got == brute(rows)
    assert 0 < exploded_shingles(spark) - before <= sum(len(shingle_set(t)) for _, t in rows)


def test_tiny_sets_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        words = [f"t{rng.randrange(60)}x{i // 6}" for _ in range(rng.randrange(1, 17))] if i % 6 == 0 else list(words)
        if i % 6:
            words[-1 if rng.random() < 0.5 else 0] = f"e{i}"
            if rng.random() < 0.5:
                words.append(f"f{i}")
        rows.append((i, " ".join(words)))
    expected = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and sum(k != c for k, (_, c) in expected.items()) > 300


def test_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[10].n_shingles == 0 and by_id[1].kept and by_id[2].kept
    assert by_id[4].component_id == 3 and by_id[8].component_id == 7 and by_id[5].n_shingles == 1
    assert by_id[None].component_id is None and by_id[None].kept
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for similarity in (0.3, 0.75, 0.9):
        estimates = []
        for _ in range(100):
            part = rng.permutation(pool)
            shared, rest = int(1000 * similarity), int(1000 * (1 - similarity) / 2)
            a, b = np.sort(part[: shared + rest]), np.sort(np.concatenate([part[:shared], part[shared + rest : shared + 2 * rest]]))
            ra, rb = near_dedup.sketches([a, b])
            both = near_dedup.sketches([np.union1d(a, b)])[0]
            assert (near_dedup.merge(ra, rb) == both).all()
            estimates.append(near_dedup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(estimates) - similarity) < 0.02


def test_shingles():
    texts = ["a b c d e f", "A  b\tc d E", "a b", "", "a b c d e a b c d e a"]
    assert [len(s) for s in shingles.shingle_sets([t.encode() for t in texts])] == [len(shingle_set(t)) for t in texts]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, None), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what lies above a limit is shared again until none is above."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300, "d": 0}, {"x": 7}, {"b": 1, "a": 1, "c": 1000}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got.keys() == sizes.keys() and all(abs(got[s] - t) < 1e-6 for s, t in brute_targets(sizes).items())


def brute_mix(rows, goals):
    """rows: (place, doc_id, source, size, hash). One queue a source, all turns sorted by finish time, taken while the budget lasts."""
    totals, turns = defaultdict(int), []
    for r in rows:
        totals[r[2]] += r[3]
    for source in totals:
        upto = 0
        for place, doc_id, _, size, hashed in sorted((r for r in rows if r[2] == source), key=lambda r: (r[0], r[1], r[4], r[3])):
            upto += size
            goal = goals[source]
            rounds = min(3, int(goal // totals[source]) + 1) if totals[source] else 1
            for k in range(rounds):
                turns.append(((upto + k * totals[source]) / goal if goal else 0.0, place, doc_id, hashed, size, source))
    taken, spent = defaultdict(int), 0
    for turn in sorted(turns):
        if spent + turn[4] > sum(goals.values()) + 0.5:
            break
        spent += turn[4]
        taken[turn[2]] += 1
    return taken


def test_against_one_queue(spark, documents):
    got = mixing.mix(documents, buckets=16).collect()
    again = {r.doc_id: r.copies for r in mixing.mix(documents.repartition(7), buckets=64).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    places = documents.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")).alias("p"))
    places = {r.doc_id: r.p for r in places.collect()}
    goals = {r.source: r.target for r in got}
    taken = brute_mix([(places[r.doc_id], r.doc_id, r.source, r["size"], r.text_hash) for r in got], goals)
    assert {r.doc_id: r.copies for r in got if r.copies} == dict(taken)
    by_source, largest = defaultdict(int), defaultdict(int)
    for r in got:
        by_source[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken <= 3 * r["size"]
    assert all(abs(by_source[s] - goals[s]) <= largest[s] for s in goals)


def test_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r["size"] for r in got} == {None: 0, 1: 0, 2: 0, 3: 2, 4: 2, 5: 30_000, 6: 1, 7: 10, 8: 11, 9: 8, 10: 0}
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(empty).count() == 0

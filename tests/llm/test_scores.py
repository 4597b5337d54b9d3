import collections
import math
import re
import zlib

import numpy as np

from tessera.llm import quality, toxicity
from tessera.llm.queries import op2_quality, op3_toxicity

BASE = "/root/testdata/sf0.1"


def held_out(spark, frame, label, parts, part):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    rows = [r for r in frame.collect()]
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in rows)
    own = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    return np.array(own)


def test_quality_on_held_out_rows(spark):
    own = held_out(spark, op2_quality(spark, BASE), "quality", 4, 2)
    assert (own[:, 0] == own[:, 1]).mean() > 0.97 and own[own[:, 0] == 1, 1].mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    own = held_out(spark, op3_toxicity(spark, BASE), "toxic", 5, 0)
    assert (own[:, 0] == own[:, 1]).mean() > 0.97 and own[own[:, 0] == 0, 1].mean() < 0.02


def test_the_score_is_made_of_normalised_differences(spark):
    """Sizes by the zstandard library's own calls, differences and calibration written out."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sample = [(t, int(i % 3 > 0)) for i, t in sorted(texts.items())]
    model = quality.fit(sample)
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    sides = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (model.good, model.bad)]
    for r in quality.score_documents(docs, model).collect():
        data, terms = texts[r.doc_id].encode(), [1.0]
        for block in (128, 512):
            cut = [data[i : i + block] for i in range(0, len(data), block)]
            good, bad = ([len(s.compress(c)) - 7 for c in cut] or [0] for s in sides)
            each = sorted((b - g) / (b + g + 24) for g, b in zip(good, bad))
            terms += [(sum(bad) - sum(good)) / (sum(bad) + sum(good) + 24), each[0], each[len(each) // 4], each[len(each) // 2], each[-1]]
        assert (r.good_bytes, r.bad_bytes) == (sum(good), sum(bad))
        z = sum((x - m) / s * w for x, m, s, w in zip(terms, model.mean, model.scale, model.weights))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_odd_rows(spark, odd, empty, documents):
    sample = [(i, f"good text number {i} of many", 1) for i in range(30)] + [(100 + i, "BAD!! WORD!! " * (i + 1), 0) for i in range(30)]
    model = quality.fit([(t, y) for _, t, y in sample])
    got = quality.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.score_documents(empty, model).count() == 0
    near = toxicity.fit(odd, [(i, t, 1 - y) for i, t, y in sample])
    got = toxicity.score_documents(odd, near).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.evidence for r in got}[1] == []
    assert toxicity.score_documents(empty, near).count() == 0


def test_samples_with_one_label_or_none(odd):
    for sample, expected in (([], 0.5), ([(1, "a", 1)], 1.0), ([(1, "a", 0)], 0.0)):
        assert abs(quality.fit([(t, y) for _, t, y in sample]).score(["x", ""])[0] - expected) < 1e-6
        assert abs(toxicity.fit(odd, sample).score([b"x"])[0][0] - expected) < 1e-5


def test_the_index_finds_what_full_comparison_finds():
    rng = np.random.default_rng(0)
    n, terms = 700, 60
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < 0.1)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    owner, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(owner, term, dense[owner, term], n, terms)
    for _ in range(150):
        query = rng.random(dense.shape[1]) * (rng.random(dense.shape[1]) < 0.15)
        own = np.flatnonzero(query)
        near, cosine = index.nearest(own, query[own], 15)
        full = np.sort(dense @ query)[::-1][:15]
        assert np.allclose(cosine, full[full > 1e-12])
        assert np.allclose((dense @ query)[near], cosine)


def test_terms_are_counted_in_whole_texts():
    counter = toxicity.TermCounter(["fool", "idio*", "idiot"])
    owner, term, times = counter.count([b"Idiot! you idiot-fool", b"", b"idiots foolish, fool"])
    got = {(int(o), counter.terms[t]): int(n) for o, t, n in zip(owner, term, times)}
    assert got == {(0, "idiot"): 2, (0, "idio*"): 2, (0, "fool"): 1, (2, "idio*"): 1, (2, "fool"): 1}
    assert [len(x) for x in counter.count([b"", b"none"])] == [0, 0, 0]


def test_rare_terms_and_balanced_samples_have_neighbours(spark, odd):
    for toxic in (30, 15):
        sample = [(i, f"good text number {i} of many", 0) for i in range(60 - toxic)] + [(100 + i, "BAD!! WORD!! " * (i + 1), 1) for i in range(toxic)]
        sample += [(500, "zanzibar quetzal", 1)]
        model = toxicity.fit(odd, sample)
        scores, evidence = model.score([b"quetzal", b"bad word", b"good text number 3 of many", b""])
        evidence = evidence.to_pylist()
        # a word of a single example is matched, and clean examples are neighbours
        assert [(e["example_id"], e["label"]) for e in evidence[0]] == [(500, 1)]
        assert {e["label"] for e in evidence[1]} == {1} and evidence[2][0]["example_id"] == 3 and evidence[2][0]["cosine"] > 1 - 1e-9
        assert evidence[3] == [] and scores[1] > 0.5 > scores[2]


def test_all_terms_of_the_examples_are_compared(odd):
    texts = [f"alpha beta w{i % 7} only{i} gamma{i % 3} " * (1 + i % 4) for i in range(200)]
    sample = [(i, t, int(i % 7 == 0)) for i, t in enumerate(texts)]
    model = toxicity.fit(odd, sample)
    owner, term, weight = toxicity.vectors(*model.counter().count([t.encode() for t in texts]), model.idf)
    dense = np.zeros((len(texts), len(model.terms)))
    dense[owner, term] = weight
    _, evidence = model.score([t.encode() for t in texts])
    for row, found in zip(dense @ dense.T, evidence.to_pylist()):
        assert np.allclose([e["cosine"] for e in found], np.sort(row)[::-1][: toxicity.NEIGHBOURS])
        assert np.allclose([row[e["example_id"]] for e in found], [e["cosine"] for e in found])


def brute_vectors(texts, examples, labels):
    """Weights of every term of the examples, and the vectors of all texts, written out with plain dictionaries."""

    def terms(text):
        found = collections.Counter()
        for word in re.findall(r"[^\W_]+", text.lower()):
            found.update([word, *[word[:size] + "*" for size in (4, 6) if len(word) > size]])
        return found

    counts = {i: terms(t) for i, t in texts.items()}
    df = collections.Counter(t for c in counts.values() for t in c)
    n, n1 = len(examples), sum(labels.values())
    weights = {}
    for term in {t for i in examples for t in counts[i]}:
        g = 0.0
        for label, of_label in ((1, n1), (0, n - n1)):
            for has in (True, False):
                holders = sum((term in counts[i]) == has for i in examples)
                seen = sum((term in counts[i]) == has and labels[i] == label for i in examples)
                g += 2 * seen * math.log(seen * n / (holders * of_label)) if seen else 0.0
        weights[term] = (math.log((1 + len(texts)) / (1 + df[term])) + 1) * (1 + max(g, 0.0))
    out = {}
    for i, c in counts.items():
        raw = {t: math.sqrt(k) * weights[t] for t, k in c.items() if t in weights}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[i] = {t: x / norm for t, x in raw.items()}
    return out


def test_toxicity_query_against_brute_force(spark):
    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    examples = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5 and i in texts and len(texts[i]) <= toxicity.FIT_CHARS)
    vectors = brute_vectors(texts, examples, {i: labels[i] for i in examples})
    rows = {r.doc_id: r for r in op3_toxicity(spark, base).collect()}
    assert rows.keys() == texts.keys()
    votes = []
    for i, row in rows.items():
        cosines = {e: sum(x * vectors[e].get(t, 0.0) for t, x in vectors[i].items()) for e in examples}
        best = sorted((c for c in cosines.values() if c > 0), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose([e.cosine for e in row.evidence], best)
        assert np.allclose([cosines[e.example_id] for e in row.evidence], best)
        assert all(e.label == labels[e.example_id] for e in row.evidence)
        weight = [c / (1.05 - min(c, 1.0)) for c in best]
        prior = sum(labels[e] for e in examples) / len(examples)
        if best:
            votes.append(((sum(w for w, e in zip(weight, row.evidence) if e.label) + 0.1 * prior) / (sum(weight) + 0.1), row.score))
    # the calibration is monotonic in the vote
    votes.sort()
    assert all(a[1] <= b[1] + 1e-6 for a, b in zip(votes, votes[1:]))

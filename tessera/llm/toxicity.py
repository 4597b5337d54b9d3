"""Toxicity by the nearest labelled examples.

A bounded sample of labelled texts is the set of examples. Terms are words and
the first four and six letters of longer words, which stand for their stems;
every term of an example is in the vocabulary. Their document frequencies are
counted over all documents, and a term that goes with either label in the
sample, by a G-squared test, weighs more. Every document is compared with all
examples by the cosine of these vectors: frequent terms as one matrix, all
others by an inverted index whose postings lie in blocks of examples and which
holds each term's largest weight in each block it occurs in, so that blocks
which can't hold one of the nearest are skipped; the result is that of comparing
with every example. The nearest ones vote, weighted by distance, and a logistic
curve makes the vote a probability. The curve is fitted on examples that had no
part in the weights and the index which they were compared by.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from .common import chunks
from .shingles import words

#: Bounds of the fit: labelled rows and their longest text.
FIT_ROWS = 6000
FIT_CHARS = 8000
NEIGHBOURS = 32
FOLDS = 5
BLOCK = 256
#: So many blocks are compared first; if more than as many still may hold a near example, all are.
FIRST_BLOCKS = 3
#: A text none of whose terms weighs more, of a vector of length one, is compared with all examples at once.
LIGHT = 0.4
#: Letters of the stems.
STEMS = (4, 6)
#: Terms in more than this share of the examples are compared as a matrix, for so many texts at once.
FREQUENT = 1 / 16
TOGETHER = 64
#: A worker counts the terms of about so many bytes of text at once.
TEXT_BYTES = 6_000_000
_NOT_WORD = re.compile(r"[^\w\n]+|_+")


def _lines(tokens: list[bytes]) -> list[str]:
    """The words of each token, with blanks between."""
    return _NOT_WORD.sub(" ", b"\n".join(tokens).decode("utf-8", "replace").lower()).split("\n")


def all_terms(texts: list[bytes]) -> list[str]:
    """Every term of the texts, in order; stems end with an asterisk."""
    found = set()
    for begin in range(0, len(texts), 256):
        for line in _lines(words(texts[begin : begin + 256])[0].unique().to_pylist()):
            for word in line.split():
                found.add(word)
                found.update(word[:size] + "*" for size in STEMS if len(word) > size)
    return sorted(found)


def association(owner: np.ndarray, term: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """G-squared of each term and the label, over examples; large for terms that go with either label."""
    n, n1 = len(labels), labels.sum()
    b = np.bincount(term, minlength=n_terms).astype(float)
    a = np.bincount(term, labels[owner], minlength=n_terms)

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    g2 = 2 * (part(a, b * n1 / n) + part(b - a, b * (n - n1) / n) + part(n1 - a, (n - b) * n1 / n) + part(n - n1 - b + a, (n - b) * (n - n1) / n))
    return np.maximum(g2, 0.0)


class TermCounter:
    """Counts the vocabulary's terms in whole texts."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        place = {t: i for i, t in enumerate(terms)}
        sides = [[t for t in terms if not t.endswith("*")], *([t for t in terms if t.endswith("*") and len(t) == size + 1] for size in STEMS)]
        self.sides = [(pa.array([t.rstrip("*") for t in own], pa.string()), np.array([place[t] for t in own], dtype=np.int64)) for own in sides]

    def _flat(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token's place, term) for each term of the tokens' words, by token."""
        found = pa.array(_NOT_WORD.sub(" ", b"\n".join(tokens).decode("utf-8", "replace").lower()).replace("\n", " * ").split(), pa.string())
        token = np.cumsum(pc.equal(found, "*").to_numpy(zero_copy_only=False))
        letters = pc.utf8_length(found).to_numpy()
        pairs = []
        for size, (own, places) in zip((0, *STEMS), self.sides):
            sought = pc.utf8_slice_codeunits(found, 0, size) if size else found
            at = pc.fill_null(pc.index_in(sought, value_set=own), -1).to_numpy()
            known = (at >= 0) & (letters > size)
            pairs.append((token[known], places[at[known]]))
        token, term = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(token, kind="stable")
        return token[order], term[order]

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's place, term, times) for every term of every text, by text and term."""
        found, begins = words(texts)
        coded = found.dictionary_encode()
        n_tokens = len(coded.dictionary)
        token, flat = self._flat(coded.dictionary.to_pylist()) if n_tokens else (np.zeros(0, dtype=np.int64),) * 2
        per_token = np.bincount(token, minlength=n_tokens)
        first = np.cumsum(per_token) - per_token
        used = coded.indices.to_numpy()
        size = per_token[used]
        owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(begins)), size)
        at = np.repeat(first[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys, times = np.unique(owner * max(len(self.terms), 1) + flat[at], return_counts=True)
        return keys // max(len(self.terms), 1), keys % max(len(self.terms), 1), times


def vectors(owner: np.ndarray, term: np.ndarray, times: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The L2-normalised TF-IDF vectors of counted texts, as (owner, term, weight) by owner.

    tf is the root of the term's count. Terms that no example has match nothing
    and are left out of the norm too. A text without any term of the vocabulary
    has no vector.
    """
    weight = np.sqrt(times) * idf[term]
    norm = np.sqrt(np.bincount(owner, weight * weight))
    return owner, term, weight / norm[owner] if len(owner) else weight


class BlockMaxIndex:
    """An inverted index of example vectors in blocks.

    A term has a cell for each block that it occurs in, with its largest weight
    there and its postings.
    """

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, block: int = BLOCK):
        self.block, self.n, self.n_blocks = block, n, max(1, -(-n // block))
        order = np.lexsort((owner, term))
        owner, term = owner[order].astype(np.int32), term[order].astype(np.int32)
        self.example, self.weight = owner, weight[order]
        in_block = owner // block
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (in_block[1:] != in_block[:-1])
        first = np.flatnonzero(new).astype(np.int32)
        self.cell_block = in_block[first].astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.cell_first = np.append(first, np.int32(len(owner)))
        self.term_first = np.searchsorted(term[first], np.arange(n_terms + 1)).astype(np.int32)
        self.list_first = self.cell_first[self.term_first]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine, by cosine and then place, and the cosines.

        ``given`` is what terms outside of the index add to each example's cosine.
        """
        start = np.zeros(self.n) if given is None else given

        def whole() -> np.ndarray:
            at, by = _spread(self.list_first, term, weight)
            return start + np.bincount(self.example[at], self.weight[at] * by, minlength=self.n)

        # where no term is heavy the bounds would tell nothing apart, and whole lists are read faster than cells
        if len(term) and weight.max() <= LIGHT:
            return _best(whole(), np.arange(self.n), k)
        cells, factor = _spread(self.term_first, term, weight)
        place = self.cell_block[cells]
        bounds = np.bincount(place, self.cell_most[cells] * factor, minlength=self.n_blocks)
        if given is not None:
            bounds = bounds + np.maximum.reduceat(start, np.arange(0, self.n, self.block))
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        score, least, done, found = start.copy(), 0.0, 0, np.zeros(0, dtype=np.int64)
        while done < len(order) and bounds[order[done]] >= least - 1e-9:
            left = order[done:][bounds[order[done:]] >= least - 1e-9]
            if done and len(left) > FIRST_BLOCKS:  # nor do they here
                return _best(whole(), np.arange(self.n), k)
            own = left[:FIRST_BLOCKS]
            chosen = np.zeros(self.n_blocks, dtype=bool)
            chosen[own] = True
            picked = chosen[place]
            at, by = _spread(self.cell_first, cells[picked], factor[picked])
            score += np.bincount(self.example[at], self.weight[at] * by, minlength=self.n)
            found = np.concatenate([found, (own[:, None] * self.block + np.arange(self.block)[None, :]).ravel()])
            found = found[found < self.n]
            done += len(own)
            if len(found) >= k:
                least = max(0.0, np.partition(score[found], len(found) - k)[len(found) - k])
        return _best(score, found, k)


def _best(score: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k places among ``found`` of the largest positive score, by score and then place, and the scores."""
    found = found[score[found] > 0]
    if len(found) > 4 * k:
        found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
    best = found[np.lexsort((found, -score[found]))][:k]
    return best, score[best]


def _spread(firsts: np.ndarray, which: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places firsts[w] to firsts[w + 1] of each w of which, and its value for each of them."""
    begin = firsts[which].astype(np.int64)
    sizes = firsts[which + 1] - begin
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), np.repeat(value, sizes)


class ExampleIndex:
    """All terms of the examples: the frequent ones as a matrix, the others in a block-max index."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        frequent = np.bincount(term, minlength=n_terms) > max(1.0, n * FREQUENT)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        self.dense = np.zeros((int(frequent.sum()), n))
        common = frequent[term]
        self.dense[self.row[term[common]], owner[common]] = weight[common]
        rare = ~common
        self.index = BlockMaxIndex(owner[rare], term[rare], weight[rare], n, n_terms)

    def nearest(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int):
        """(text's place, nearest examples, cosines) of each text with a vector."""
        places, firsts = np.unique(owner, return_index=True)
        firsts = np.append(firsts, len(owner))
        for begin in range(0, len(places), TOGETHER):
            end = min(begin + TOGETHER, len(places))
            a, b = firsts[begin], firsts[end]
            row = self.row[term[a:b]]
            # of one size always, so that a text's products don't depend on its neighbours
            queries = np.zeros((TOGETHER, len(self.dense)))
            queries[np.repeat(np.arange(end - begin), np.diff(firsts[begin : end + 1]))[row >= 0], row[row >= 0]] = weight[a:b][row >= 0]
            given = queries @ self.dense
            for i in range(begin, end):
                own = slice(firsts[i], firsts[i + 1])
                rare = self.row[term[own]] < 0
                yield int(places[i]), *self.index.nearest(term[own][rare], weight[own][rare], k, given[i - begin])


@dataclasses.dataclass
class NearestExamples:
    terms: list[str]
    idf: np.ndarray
    index: ExampleIndex | None
    labels: np.ndarray
    ids: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    #: The share of label 1 among examples without any term of the vocabulary.
    prior_without: float = 0.5

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """The share of label 1 among neighbours, weighted by distance; the prior has a small weight."""
        weight = cosine / (1.05 - np.minimum(cosine, 1.0))
        return float((weight @ self.labels[near] + 0.1 * self.prior) / (weight.sum() + 0.1))

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        vote = np.clip(vote, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.shift)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_counter"}

    def counter(self) -> TermCounter:
        if "_counter" not in self.__dict__:
            self._counter = TermCounter(self.terms)
        return self._counter

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """Scores, and each text's neighbours as evidence (example_id, label, cosine)."""
        votes, counts = np.full(len(texts), self.prior_without), np.zeros(len(texts) + 1, dtype=np.int32)
        nears, cosines = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        if self.index is not None:
            for i, near, cosine in self.index.nearest(*vectors(*self.counter().count(texts), self.idf), NEIGHBOURS):
                if len(near):
                    votes[i], counts[i + 1] = self.vote(near, cosine), len(near)
                    nears.append(near)
                    cosines.append(cosine)
        near = np.concatenate(nears)
        flat = pa.StructArray.from_arrays([pa.array(self.ids[near]), pa.array(self.labels[near].astype(np.int32)), pa.array(np.concatenate(cosines))], ["example_id", "label", "cosine"])
        return self.calibrated(votes), pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), flat)


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each term; each task sends a row for each term it met."""
    slim = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        counter, total, df = TermCounter(terms), 0, np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                _, term, _ = counter.count([t.encode() for t in part.column(0).to_pylist()])
                df += np.bincount(term, minlength=len(terms))
                total += part.num_rows
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1), pa.int64()), pa.array(np.append(df[met], total), pa.int64())], ["term", "n"])

    counted = slim.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term, and the total at -1
    df = np.zeros(len(terms) + 1, dtype=np.int64)
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return int(df[-1]), df[:-1]


def fit(docs: DataFrame, sample: list[tuple[int, str, int]]) -> NearestExamples:
    """Fits on a sample of (id, text, label); frequencies come from all of docs.

    Without both labels in the sample the score is constant: the only label, or one half.
    """
    ids, texts, labels = np.array([s[0] for s in sample], dtype=np.int64), [s[1] for s in sample], np.array([s[2] for s in sample], dtype=float)
    prior = float(labels.mean()) if len(labels) else 0.5
    blank = NearestExamples([], np.zeros(0), None, labels, ids, prior, prior_without=prior)
    if len(set(labels.tolist())) < 2:
        return blank
    own = [t.encode("utf-8", "replace") for t in texts]
    if not (terms := all_terms(own)):
        return blank
    total, df = document_frequencies(docs, terms)
    idf = np.log((1 + total) / (1 + df)) + 1
    counter, parts = TermCounter(terms), []
    for begin in range(0, len(own), 256):
        owner, term, times = counter.count(own[begin : begin + 256])
        parts.append(((owner + begin).astype(np.int32), term.astype(np.int32), times.astype(np.int32)))
    counted = tuple(np.concatenate(p) for p in zip(*parts))
    bare = np.ones(len(own), dtype=bool)
    bare[counted[0]] = False
    without = float((labels[bare].sum() + prior) / (bare.sum() + 1))

    def model_of(chosen: np.ndarray) -> NearestExamples:
        """The uncalibrated model whose weights and index come from the chosen examples."""
        places = np.flatnonzero(chosen)
        taken = chosen[counted[0]]
        owner, term, times = (np.searchsorted(places, counted[0][taken]), counted[1][taken], counted[2][taken])
        weighed = idf * (1 + association(owner, term, labels[places], len(terms)))
        owner, term, weight = vectors(owner, term, times, weighed)
        # examples that share their heaviest term lie together, which keeps the blocks' bounds low
        lead = np.full(len(places), len(terms))
        heaviest = np.lexsort((weight, owner))
        lead[owner[heaviest]] = term[heaviest]
        order = np.lexsort((ids[places], lead))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        index = ExampleIndex(rank[owner], term, weight, len(places), len(terms))
        return dataclasses.replace(blank, terms=terms, idf=weighed, index=index, labels=labels[places][order], ids=ids[places][order], prior_without=without)

    votes, fold = np.full(len(own), without), np.arange(len(own)) % FOLDS

    def vote_on(k: int) -> None:
        part, asked = model_of(fold != k), (fold == k)[counted[0]]
        for i, near, cosine in part.index.nearest(*vectors(*(c[asked] for c in counted), part.idf), NEIGHBOURS):
            votes[i] = part.vote(near, cosine) if len(near) else without

    for k in range(FOLDS):
        vote_on(k)
    from .quality import _logistic

    logit = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / np.clip(1 - votes, 1e-6, 1 - 1e-6))
    mean, scale, w = _logistic(np.column_stack([np.ones(len(logit)), logit]), labels)
    return dataclasses.replace(model_of(np.ones(len(own), dtype=bool)), slope=float(max(w[1] / scale[1], 1e-3)), shift=float(w[0] - w[1] * mean[1] / scale[1]))


def score_documents(docs: DataFrame, model: NearestExamples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (the probability of label 1) and evidence (the nearest examples, their labels and cosines).

    Whole texts are scored; a null or empty text, or one without any term of the
    vocabulary, gets the examples' share for that case and no evidence. Equal
    cosines come in the index's order. Repeated rows are scored alike, a null id stays null, other
    columns are left out, and an empty table has no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    example = StructType().add("example_id", LongType()).add("label", IntegerType()).add("cosine", DoubleType())
    out = StructType([slim.schema["doc_id"]]).add("score", DoubleType()).add("evidence", ArrayType(example))
    schema = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                score, evidence = model.score([t.encode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), pa.array(score), evidence.cast(schema.field(2).type)], schema=schema)

    return slim.mapInArrow(run, out)

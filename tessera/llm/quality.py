"""A quality classifier that compares compressed sizes.

Two zstandard dictionaries are built, from good and from bad labelled texts. A
text is cut into blocks, and every block is compressed with either dictionary.
A text that the good one shortens more is likely good. The evidence is the
normalised difference of the two sizes, and nothing else: that of the whole
text, and the least, the lower quartile's, the median's and the largest of its
blocks, for small and for larger blocks. A logistic calibration makes a
probability of them.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks

#: Bounds of the fitting sample: labelled rows, and the longest text among them.
FIT_ROWS = 6000
FIT_CHARS = 10_000
DICTIONARY_BYTES, LEAST_DICTIONARY = 112_640, 2048
#: Texts are cut into blocks of either size.
BLOCK_BYTES = (128, 512)
N_TERMS = 1 + 5 * len(BLOCK_BYTES)
LEVEL = 3
FOLDS = 5
#: Bytes of a frame that no content causes, and what is added to the denominator, which matters for short texts.
FRAME_BYTES, DAMPING = 7, 24


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int = FIT_ROWS, longest: int = FIT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int]]:
    """(id, text, label) of at most ``rows`` labelled documents of at most ``longest`` code points.

    The rows are chosen by a hash of their id, so reruns agree. ``usable`` is a
    condition on the id. Null labels, and ids labelled both ways, are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(usable)
    known = known.groupBy(id_col).agg(F.min(label).alias("_label"), F.max(label).alias("_other")).where("_label = _other")
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(F.col(id_col).alias("_id"), "_label")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).where(F.length("_text") <= longest)
    found = texts.join(F.broadcast(chosen), "_id")  # at most ``rows`` ids
    found = found.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))
    return [(r["_id"], r["_text"], int(r["_label"])) for r in found.orderBy("_id").collect()]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes; texts too few to train one are its raw content."""
    import zstandard

    blocks = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(t[:1500] for t in texts)[:size] or b"\n" * 8


@dataclasses.dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._open = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def _compressors(self):
        if self._open is None:
            import zstandard

            plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._open = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (self.good, self.bad)]
        return self._open

    def sizes(self, text: str, block: int = BLOCK_BYTES[-1]) -> tuple[np.ndarray, np.ndarray]:
        """Compressed sizes of the text's blocks, in order, with the good and with the bad dictionary; an empty text is one block of none."""
        data = text.encode("utf-8", "surrogatepass")
        blocks = [data[i : i + block] for i in range(0, len(data), block)]
        good, bad = ([len(c.compress(b)) - FRAME_BYTES for b in blocks] or [0] for c in self._compressors())
        return np.array(good, dtype=float), np.array(bad, dtype=float)

    def terms(self, text: str) -> tuple[list[float], int, int]:
        """A constant and the normalised differences, and the text's sizes with the good and the bad dictionary."""
        out = [1.0]
        for block in BLOCK_BYTES:
            good, bad = self.sizes(text, block)
            by_block = np.sort((bad - good) / (bad + good + DAMPING))
            good, bad = good.sum(), bad.sum()
            out += [(bad - good) / (bad + good + DAMPING), by_block[0], by_block[len(by_block) // 4], by_block[len(by_block) // 2], by_block[-1]]
        return out, int(good), int(bad)

    def probability(self, terms) -> np.ndarray:
        z = (np.asarray(terms, dtype=float) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        return self.probability([self.terms(t)[0] for t in texts]) if texts else np.zeros(0)


def _logistic(terms: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a ridge logistic regression; the first term is the constant."""
    mean, scale = terms.mean(0), terms.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, w = (terms - mean) / scale, np.zeros(terms.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, z.T @ (p - labels) / len(z) + ridge * w)
    return mean, scale, w


def fit(sample: list[tuple[str, int]]) -> CompressionClassifier:
    """Dictionaries from the whole sample, calibrated on texts that the dictionaries used for them have not seen.

    A sample with one label, or none, gives a constant score: that label, or one half.
    """
    constant = np.zeros(N_TERMS)
    constant[0] = 30.0 if sample and sample[0][1] else -30.0 if sample else 0.0
    blank = CompressionClassifier(b"\n" * 8, b"\n" * 8, np.zeros(N_TERMS), np.ones(N_TERMS), constant)
    if len({y for _, y in sample}) < 2:
        return blank

    def dictionaries(rows):
        sides = [[t.encode("utf-8", "surrogatepass") for t, y in rows if y == label] for label in (1, 0)]
        # of one size, which the scarcer label's texts must fill twice, so that neither side knows more
        size = max(LEAST_DICTIONARY, min(DICTIONARY_BYTES, min(sum(map(len, side)) for side in sides) // 2))
        return dataclasses.replace(blank, good=_dictionary(sides[0], size), bad=_dictionary(sides[1], size))

    terms, labels = [], []
    for fold in range(FOLDS):
        seen = dictionaries([r for i, r in enumerate(sample) if i % FOLDS != fold])
        for text, y in sample[fold::FOLDS]:
            terms.append(seen.terms(text)[0])
            labels.append(y)
    mean, scale, weights = _logistic(np.array(terms), np.array(labels, dtype=float))
    return dataclasses.replace(dictionaries(sample), mean=mean, scale=scale, weights=weights)


def score_documents(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (the probability of label 1), and the compressed sizes good_bytes and bad_bytes.

    Whole texts are scored; null counts as empty, and an empty text gets what
    the calibration gives for no content. Repeated rows are scored alike, a
    null id stays null, other columns are left out, and an empty table has no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    from pyspark.sql.types import DoubleType, LongType, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([slim.schema["doc_id"]]).add("score", DoubleType()).add("good_bytes", LongType()).add("bad_bytes", LongType())
    schema = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                terms, good, bad = zip(*(model.terms(t) for t in part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), pa.array(model.probability(terms)), pa.array(good, pa.int64()), pa.array(bad, pa.int64())], schema=schema)

    return slim.mapInArrow(run, out)


def keep_good(docs: DataFrame, model: CompressionClassifier, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                good = model.score([t or "" for t in part.column(at).to_pylist()]) >= threshold
                yield part.filter(pa.array(good)).cast(schema)

    return docs.mapInArrow(run, docs.schema)

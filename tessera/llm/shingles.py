"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE_WORDS = 5
_SPACES = bytes([9, 10, 11, 12, 13, 32])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = bytes(0 if b in _SPACES else 1 for b in range(256))
_U = np.uint64
#: Odd multipliers of the words' places in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and where each text's words begin (one entry more than texts)."""
    data = b"\n".join(texts).translate(_LOWER)
    is_word = np.frombuffer(data.translate(_IS_WORD), dtype=np.uint8)
    edges = np.diff(is_word, prepend=np.uint8(0), append=np.uint8(0))  # 1 where a word begins, 255 after its end
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == 255)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = np.frombuffer(data, dtype=np.uint8)[is_word.astype(bool)]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return found, np.searchsorted(starts, begins)


def word_hashes(found: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = found.dictionary_encode()
    distinct = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=_U)
    return distinct[coded.indices.to_numpy()] if len(found) else distinct


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending.

    A shingle is five words in a row; a text with one to four words has its
    whole sequence as the only shingle, a text without words has none.
    """
    found, begins = words(texts)
    hashes = word_hashes(found)
    n = len(hashes)
    rolled = np.zeros(max(n - SHINGLE_WORDS + 1, 0), dtype=_U)
    for place, factor in enumerate(_PLACES):
        rolled += hashes[place : place + len(rolled)] * factor
    rolled = mix(rolled)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        count = b - a
        if count >= SHINGLE_WORDS:
            own = np.sort(rolled[a : b - SHINGLE_WORDS + 1])
            if count > SHINGLE_WORDS:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif count:
            own = mix((hashes[a:b] * _PLACES[:count]).sum(dtype=_U, keepdims=True) + _U(count))
        else:
            own = rolled[:0]
        out.append(own)
    return out

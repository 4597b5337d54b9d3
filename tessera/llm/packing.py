"""Online packing of token sequences into windows by the sum-of-squares rule.

Each map task packs its own documents as they stream by, so nothing is
shuffled and the memory a task needs does not depend on how many documents it
reads. A document's full windows are cut off first; what is left, shorter than
a window, is placed whole into the fill level at which the sum over all levels
of (number of windows partially filled to that level) squared becomes least.
The counts stand in an array with one entry per level. Windows that are still
partially filled when ``open_limit`` of them have gathered, or when the input
ends, are emptied and their pieces dealt out again, cut where needed: into full
windows, and the last tokens into windows whose sizes are powers of two, which
need no padding.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks

WINDOW = 2048
END_ID = 1
#: At most so many partially filled windows wait in a task (about 32 MB of ids); then all are emptied as at the end.
OPEN_LIMIT = 4096
#: A task numbers its sequences from its partition's number times this.
SEQUENCES_PER_TASK = 1 << 36
#: Longer texts are given to the file's own tokenizer; the fast one's pattern runs out of stack on millions of blanks. Ids are the same.
FAST_CHARS = 1_000_000


@functools.lru_cache(maxsize=2)
def _encoders(path: str):
    """A fast encoder with the vocabulary of a byte-level BPE file, and the file's own tokenizer.

    In such files an id is also the merge's rank, which is all the fast one needs.
    The file's added tokens, where a text spells them, keep their own ids.
    """
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printable}
    spelled |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    added = spec.get("added_tokens", [])
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
        raise ValueError("added tokens that look at their surroundings are not supported")
    special = {x["content"]: x["id"] for x in added}
    ranks = {bytes(spelled[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), Tokenizer.from_file(path)


def token_ids(text: str, path: str) -> np.ndarray:
    """The text's ids, as the file's tokenizer gives them without adding any: a special token's string is that token."""
    fast, slow = _encoders(path)
    if len(text) <= FAST_CHARS:
        return np.array(fast.encode(text, allowed_special="all"), dtype="<u4")
    return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


class SquaresPacker:
    """Packs (key, ids) one after the other; pieces come out as (key, start, ids, total, sequence, offset)."""

    def __init__(self, window: int = WINDOW, open_limit: int = OPEN_LIMIT, first_sequence: int = 0):
        self.window, self.open_limit, self.next_sequence = window, open_limit, first_sequence
        self.levels = np.zeros(window + 1, dtype=np.int64)  # windows partially filled to each level
        self.waiting: list[list[list]] = [[] for _ in range(window + 1)]  # their pieces
        self.n_open = 0

    def _sequence(self, pieces):
        number, offset = self.next_sequence, 0
        self.next_sequence += 1
        for key, start, ids, total in pieces:
            yield key, start, ids, total, number, offset
            offset += len(ids)

    def add(self, key, ids: np.ndarray):
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield from self._sequence([(key, start, ids[start : start + self.window], len(ids))])
        if size := len(ids) - whole:
            yield from self._place((key, whole, ids[whole:], len(ids)), size)

    def _best_level(self, size: int) -> int:
        """The level whose use leaves the least sum of squares; 0 opens a window. Of equals, the fullest."""
        levels = np.flatnonzero(self.levels[1 : self.window - size + 1]) + 1
        if not len(levels):
            return 0
        after = np.where(levels + size == self.window, -1, self.levels[np.minimum(levels + size, self.window)])
        gain = 2 * (after - self.levels[levels]) + 2
        gain[levels + size == self.window] = 1 - 2 * self.levels[self.window - size]
        best = len(gain) - 1 - int(np.argmin(gain[::-1]))
        return int(levels[best]) if gain[best] <= 2 * self.levels[size] + 1 else 0

    def _place(self, piece, size: int):
        level = self._best_level(size)
        pieces = []
        if level:
            pieces = self.waiting[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + size == self.window:
            yield from self._sequence(pieces)
            return
        self.waiting[level + size].append(pieces)
        self.levels[level + size] += 1
        self.n_open += 1
        if self.n_open > self.open_limit:
            yield from self.drain()

    def drain(self):
        """Deals the waiting pieces into full windows, then into powers of two."""
        pieces = [p for level in reversed(self.waiting) for own in level for p in own]
        left = sum(len(p[2]) for p in pieces)
        self.levels[:] = 0
        self.waiting, self.n_open = [[] for _ in range(self.window + 1)], 0
        room, own = min(self.window, 1 << max(left.bit_length() - 1, 0)), []
        for key, start, ids, total in pieces:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                own.append((key, start, part, total))
                start, room, left = start + len(part), room - len(part), left - len(part)
                if not room:
                    yield from self._sequence(own)
                    room, own = min(self.window, 1 << max(left.bit_length() - 1, 0)), []


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, open_limit: int = OPEN_LIMIT) -> DataFrame:
    """The pieces of all documents, with their token ids.

    Returns doc_id, start, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset. A null or empty text has end_id alone;
    a null id stays null; repeated rows are packed once each. Very long texts
    fill windows of their own. An empty table has no rows. Other columns are
    left out. Sequence ids are unique, not dense. ``window`` must be a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        packer = SquaresPacker(window, open_limit, TaskContext.get().partitionId() * SEQUENCES_PER_TASK)
        rows, size = [], 0

        def flush():
            columns = list(zip(*rows))
            columns = [columns[0], columns[1], [x.tobytes() for x in columns[2]], *columns[3:]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def documents():
            end = np.array([end_id], dtype="<u4")
            for batch in batches:
                for part in chunks(batch, "text"):
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        yield from packer.add(key, np.concatenate([token_ids(text or "", tokenizer_path), end]))
            yield from packer.drain()

        for row in documents():
            rows.append(row)
            size += len(row[2])
            if size > 1_000_000 or len(rows) > 20_000:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    slim = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    return slim.mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")

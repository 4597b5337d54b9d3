"""Exact deduplication by Grace hashing over complete content.

The rows of a map task are first folded by content in tables of bounded size,
so that of a group of copies, however large, each task sends on one row per
table. The rows are then dealt out by their content's hash. Each task
partitions its share into spill files, again and again by further bits of the
hash, until a bucket fits an open-addressing table, which compares complete
contents and keeps the best row of each.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SPACES = bytes([9, 10, 11, 12, 13, 32])
#: Bytes of content that a table may hold.
TABLE_BYTES = 48_000_000
FAN_OUT = 16


class ContentTable:
    """An open-addressing table from content to a slot; equal hashes are told apart by the content itself."""

    def __init__(self):
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def slot(self, hashed: int, content: bytes) -> int:
        """The content's number; a new content gets the next one."""
        mask, at = len(self.slots) - 1, hashed & (len(self.slots) - 1)
        while (found := int(self.slots[at])) >= 0:
            if self.hashes[found] == hashed and self.contents[found] == content:
                return found
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = np.full(mask + 1, -1, dtype=np.int64)
        for number, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def _normal(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACES)


def _order(n_chars: int, key: int | None) -> tuple:
    """Least for the row that stays: most code points, then the smallest id, null last."""
    return -n_chars, key is None, key or 0


def _hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(_normal(text))


class Folder:
    """Folds rows (id, n_chars, text, copies, content's hash, ...) that have equal contents."""

    def __init__(self):
        self.table, self.best, self.copies, self.bytes = ContentTable(), [], [], 0

    def add(self, row) -> None:
        content = _normal(row[2])
        number = self.table.slot(row[4] % 2**64, content)
        if number == len(self.best):
            self.best.append(row)
            self.copies.append(row[3])
            self.bytes += 2 * len(content) + 200
        else:
            self.copies[number] += row[3]
            if _order(row[1], row[0]) < _order(self.best[number][1], self.best[number][0]):
                self.best[number] = row

    def rows(self):
        for row, copies in zip(self.best, self.copies):
            yield (*row[:3], copies, *row[4:])


def _batches(rows, schema: pa.Schema, limit: int = 4_000_000):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 4 * len(row[2] or "") + 100
        if size > limit:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def grace(rows, schema: pa.Schema, table_bytes: int, depth: int = 0):
    """One row for each content among rows, by Grace hashing.

    Rows go into one table while it fits. When it doesn't, the table's rows and
    all that follow are partitioned into spill files by four bits of the hash,
    and each file is handled alike with the next four. The files belong to this
    task alone and vanish with it, as Spark's own spills do; a lost task starts
    again from its shuffle input.
    """
    folder = Folder()
    rows = iter(rows)
    for row in rows:
        folder.add(row)
        if folder.bytes > table_bytes and len(folder.best) > 1 and depth < 15:
            break
    else:
        yield from folder.rows()
        return
    files = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
    writers = [pa.ipc.new_stream(f, schema) for f in files]

    def every():
        yield from folder.rows()
        yield from rows

    held, sizes = [[] for _ in files], [0] * FAN_OUT
    for row in every():
        k = (row[4] % 2**64 >> (60 - 4 * depth)) % FAN_OUT
        held[k].append(row)
        sizes[k] += 4 * len(row[2] or "") + 100
        if sizes[k] > 1_000_000:
            writers[k].write_batch(next(_batches(held[k], schema, 1 << 62)))
            held[k], sizes[k] = [], 0
    del folder
    for k, (file, writer) in enumerate(zip(files, writers)):
        for batch in _batches(held[k], schema, 1 << 62):
            writer.write_batch(batch)
        held[k] = []
        writer.close()
        file.seek(0)
        yield from grace(_rows(pa.ipc.open_stream(file)), schema, table_bytes, depth + 1)
        file.close()


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, with_copies: bool = False) -> DataFrame:
    """The row that stays of each content, with all columns of docs.

    Texts are equal when identical without white space; null counts as empty.
    Of equal texts the row with the most code points stays, then the one with
    the smallest id (null last); of rows equal in both, any one. Very long texts are
    compared whole. An empty table gives an empty one. Columns of docs keep
    their names and types; with_copies appends ``_copies``, the group's size, and ``_sha256``, the content's digest.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("long").alias("_n"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.lit(1).cast("long").alias("_copies"),
        F.lit(0).cast("long").alias("_hash"),
        *([F.lit("").alias("_sha256")] if with_copies else []),
        *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []),
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(packed.schema)

    def fold(batches):
        folder = Folder()
        for row in _rows(batches):
            hashed = _hash(row[2])
            folder.add((*row[:4], hashed - 2**64 if hashed >= 2**63 else hashed, *row[5:]))
            if folder.bytes > table_bytes:
                yield from _batches(folder.rows(), schema)
                folder = Folder()
        yield from _batches(folder.rows(), schema)

    def finish(batches):
        kept = grace(_rows(batches), schema, table_bytes)
        if with_copies:
            kept = ((*row[:5], hashlib.sha256(_normal(row[2])).hexdigest(), *row[6:]) for row in kept)
        yield from _batches(kept, schema)

    folded = packed.mapInArrow(fold, packed.schema)
    done = folded.repartition("_hash").mapInArrow(finish, packed.schema)
    named = {id_col: F.col("_id").cast(docs.schema[id_col].dataType), text_col: F.col("_text")}
    return done.select(*[named[c].alias(c) if c in named else F.col("_rest")[c].alias(c) for c in docs.columns], *([F.col("_copies"), F.col("_sha256")] if with_copies else []))


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Each row's group: doc_id, keep_id, group_size, kept, text_sha256; see survivors() for the rules.

    The groups are formed on complete contents; the rows then find theirs by the
    content's SHA-256. A hot group's rows are split by the join's skew handling.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def digests(batches):
        for batch in batches:
            found = [hashlib.sha256((t or b"").translate(None, SPACES)).hexdigest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text_sha256"])

    kept = survivors(slim, table_bytes=table_bytes, with_copies=True)
    groups = kept.select(F.col("_sha256").alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.col("_copies").alias("group_size"))
    members = slim.select("doc_id", F.col("text").cast("binary")).mapInArrow(digests, "doc_id long, text_sha256 string")
    found = members.join(groups, "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_the_tokenizers(text):
    assert packing.token_ids(text, PATH).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_ids_of_real_texts(documents):
    t = tokenizer()
    for row in documents.limit(60).collect():
        assert packing.token_ids(row.text, PATH).tolist() == t.encode(row.text, add_special_tokens=False).ids


def test_special_tokens_and_long_texts(monkeypatch):
    texts = ["hi <|endoftext|> there", "<|endoftext|><|endoftext|>", "<|endoftext|", "a  <|endoftext|>  b", "<|ENDOFTEXT|>", "\n<|endoftext|>\n"]
    texts.append("word <|endoftext|> " * 60_000)
    t = tokenizer()
    for text in texts:
        assert packing.token_ids(text, PATH).tolist() == t.encode(text, add_special_tokens=False).ids
    assert packing.token_ids(texts[0], PATH).tolist() == [5303, 220, 50256, 612]
    monkeypatch.setattr(packing, "FAST_CHARS", 0)
    for text in texts:
        assert packing.token_ids(text, PATH).tolist() == t.encode(text, add_special_tokens=False).ids


def squares(packer):
    return int((packer.levels**2).sum())


def test_a_piece_goes_where_the_sum_of_squares_is_least():
    rng = np.random.default_rng(1)
    packer = packing.SquaresPacker(window=32, open_limit=10**6)
    for n in range(400):
        size = int(rng.integers(1, 32))
        before = packer.levels.copy()
        options = []
        for level in [0, *np.flatnonzero(before[: 33 - size]).tolist()]:
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            options.append(int((after**2).sum()))
        list(packer.add(n, np.arange(size, dtype="<u4")))
        assert squares(packer) == min(options)


def check_round_trip(pieces, sizes, window):
    by_doc, by_sequence = {}, {}
    for key, start, ids, total, sequence, offset in pieces:
        by_doc.setdefault(key, []).append((start, ids, total))
        by_sequence.setdefault(sequence, []).append((offset, len(ids)))
    for key, size in sizes.items():
        own = sorted(by_doc[key], key=lambda p: p[0])
        assert np.concatenate([p[1] for p in own]).tolist() == list(range(size))
        assert [p[0] for p in own] == np.cumsum([0, *[len(p[1]) for p in own[:-1]]]).tolist()
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()
        total = sum(n for _, n in own)
        assert total <= window and total & (total - 1) == 0  # full, or a power of two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=80), st.integers(1, 20))
def test_every_id_lies_in_one_piece(sizes, limit):
    packer = packing.SquaresPacker(window=64, open_limit=limit)
    pieces = [p for k, n in enumerate(sizes) for p in packer.add(k, np.arange(n, dtype="<u4"))] + list(packer.drain())
    check_round_trip(pieces, dict(enumerate(sizes)), 64)


def test_odd_rows(odd, empty):
    rows = packing.pack(odd, PATH).collect()
    totals = {}
    for r in rows:
        totals.setdefault(r.doc_id, set()).add(r.doc_tokens)
    assert totals[1] == {1} and totals[2] == {1} and totals[None] == {1}
    assert sum(len(r.ids) // 4 for r in rows if r.doc_id == 3) == 2 * 3  # a repeated row is packed twice
    sizes = [sum(len(x.ids) // 4 for x in rows if x.sequence_id == s) for s in {r.sequence_id for r in rows}]
    assert all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack(empty, PATH).count() == 0


def test_query(spark):
    from tessera.llm.queries import op1_packing

    base, tok = "/root/testdata/sf0.001", tokenizer()
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    pieces, ends = {}, {}
    for r in op1_packing(spark, base).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(own.tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for key, own in pieces.items():  # each id lies in exactly one piece
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(own[-1]) == len(ids[key])
    for own in ends.values():  # pieces stand side by side; a sequence is full or needs no padding
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()
        used = sum(own[-1])
        assert used <= 2048 and used & (used - 1) == 0

import bisect
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from entitylink.llm.packing import CapacityTree, pack_documents, packed_ids, plan
from entitylink.llm.tokens import WordEncoder, default_tokenizer

from .helpers import documents, odd_rows


def best_fit_decreasing(lengths, capacity):
    open_bins = []
    bins = 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(open_bins, n)
        if at == len(open_bins):
            bins, left = bins + 1, capacity
        else:
            left = open_bins.pop(at)
        bisect.insort(open_bins, left - n)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(50, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = plan(counts, capacity)
    assert bins == best_fit_decreasing(lengths, capacity)
    inside = {}
    for length, _, pieces, fit, first, offset in runs.tolist():
        for k in range(pieces):
            inside.setdefault(first + k // fit, []).append((offset + k % fit * length, length))
    assert len(inside) == bins
    for places in inside.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity


def test_plan_refuses_long_pieces():
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


def test_tree_finds_the_tightest():
    tree = CapacityTree(20)
    for c in (3, 9, 17):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 9, 10, 17, 18)] == [3, 3, 9, 9, 17, 17, None]
    tree.set(9, False)
    assert tree.tightest(4) == 17


def test_words_have_the_ids_of_whole_texts():
    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = [t for _, t in odd_rows() if t] + ["I'LL we've x's! a,b,,c. ,. ÉTÉ İx   y 中文 words", "<|ENDOFTEXT|>"]
    ids, each = WordEncoder(default_tokenizer(), table_words=50).encode([t.encode() for t in texts])
    for text, own in zip(texts, np.split(ids, np.cumsum(each)[:-1]), strict=True):
        assert tokenizer.encode(text, add_special_tokens=False).ids == own.tolist()


def test_pack_whole(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    placed = pack_documents(docs, capacity=256).collect()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for p, start in enumerate(range(0, len(ids), 256)):
            piece = np.array(ids[start : start + 256], "<u4")
            want.append((i, p, start, len(piece), zlib.crc32(piece.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r.sequence_id for r in placed}) == best_fit_decreasing([r.length for r in placed], 256)
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, [(i, f"some words number {i} " * (i + 1)) for i in range(30)])
    placed = pack_documents(docs, capacity=64)
    pieces = {(r.sequence_id, r.offset): r for r in placed.collect()}
    for r in packed_ids(docs, placed, capacity=64).collect():
        own = sorted((p for s, p in pieces if s == r.sequence_id))
        for at in own:
            p = pieces[r.sequence_id, at]
            assert zlib.crc32(np.array(r.ids[at : at + p.length], "<u4").tobytes()) == p.ids_crc32


def test_empty(spark):
    assert pack_documents(documents(spark, [])).count() == 0

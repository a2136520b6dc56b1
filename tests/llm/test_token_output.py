import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from entitylink.llm import simple8b
from entitylink.llm.token_output import read_tokens, write_tokens
from entitylink.llm.tokens import WordEncoder, default_tokenizer

from .helpers import documents, odd_rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.just(1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=2500))
def test_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, starts = simple8b.encode(ids)
    assert (simple8b.decode(words, starts, len(ids)) == ids).all()


def test_frames_decode_alone():
    ids = np.random.default_rng(0).integers(0, 50_000, 5000).astype(np.uint64)
    words, starts = simple8b.encode(ids)
    for k, start in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(words)
        own = ids[k * simple8b.FRAME : (k + 1) * simple8b.FRAME]
        assert (simple8b.decode(words[start:end], np.zeros(1, np.int64), len(own)) == own).all()


def test_small_ids_take_little_room():
    words, _ = simple8b.encode(np.zeros(1024, np.uint64))
    assert len(words) <= 10


def test_files_whole(spark, tmp_path):
    rows = odd_rows()
    path = str(tmp_path / "tokens")
    write_tokens(documents(spark, rows), path, end_id=1)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    assert [r.doc_id for r in got[:2]] == [None, None]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = {i: t for i, t in rows if i is not None}
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id is not None:
            assert r.ids == [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    write_tokens(documents(spark, []), path)
    assert read_tokens(spark, path).count() == 0


def test_tokenizers_that_do_not_cut_words(spark, tmp_path):
    """Ids are those of the library for a vocabulary that keeps case and blanks, too."""
    import public_tokenizers

    name = public_tokenizers.path("byte_bpe_50k.json")
    assert not WordEncoder(name).by_words and WordEncoder(default_tokenizer()).by_words
    rows = [(i, t) for i, t in odd_rows() if i != 8]
    path = str(tmp_path / "bytes")
    write_tokens(documents(spark, rows), path, tokenizer=name, end_id=50256)
    tokenizer = Tokenizer.from_file(name)
    got = {r.doc_id: r.ids for r in read_tokens(spark, path).collect() if r.doc_id is not None}
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 50256] for i, t in rows if i is not None}


def test_reading_moves_no_blocks(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(documents(spark, odd_rows()), path)
    plan = read_tokens(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from agendum.llm import packing
from agendum.llm.wordhash import slices
from tests.llm.helpers import docs_of, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(text):
    tok, _ = packing.tokenizer(PATH)
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, expected):
    """Every id in exactly one piece, sequences gapless, full or a power of two."""
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert set(got) == set(expected)
    for d, ids in expected.items():
        at = 0
        for p in sorted(got[d], key=lambda p: p.start):
            part = np.array(ids[p.start:p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(ids)
            assert p.ids is None or p.ids == part
            at += p.length
        assert at == len(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0 and {p.sequence_length for p in ps} == {at}


def test_odd_texts_round_trip(spark):
    texts = odd_texts()
    pieces = packing.pack(docs_of(spark, texts, clash=True), PATH).collect()
    check(pieces, {i: reference_ids(t) for i, t in enumerate(texts)})


def test_repeated_rows_are_packed_as_often(spark):
    pieces = packing.pack(docs_of(spark, [(1, "a b c"), (1, "a b c"), (None, "d")]), PATH).collect()
    assert sum(p.length for p in pieces) == 2 * len(reference_ids("a b c")) + len(reference_ids("d"))
    assert {p.doc_id for p in pieces} == {1, None}


def test_empty_table(spark):
    assert packing.pack(docs_of(spark, []), PATH).count() == 0


def test_neighbours_on_the_curve_share_sequences(spark):
    a, b = "the cat sat on the mat " * 8, "numpy arrays of floating numbers " * 8
    docs = docs_of(spark, [a if i % 2 else b for i in range(400)])
    pieces = packing.pack(docs.repartition(4), PATH).collect()
    kinds = {}
    for p in pieces:
        kinds.setdefault(p.sequence_id, set()).add(p.doc_id % 2)
    assert sum(len(k) > 1 for k in kinds.values()) <= 2


def test_hilbert_neighbours_are_adjacent():
    cells = np.array([[x, y] for x in range(16) for y in range(16)])
    order = cells[np.argsort(packing.hilbert_key(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sdI’é 　a1-"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_chunked_ids_equal_whole_text_ids(texts):
    import pyarrow as pa
    import pyarrow.compute as pc
    tok, cache = packing.tokenizer(PATH)
    col = pa.array(texts, pa.large_string())
    whole = pc.match_substring_regex(col, packing._WIDE_SPACE).to_numpy(zero_copy_only=False)
    for i, j, data, off in slices(col):
        ids, counts = packing.encode_slice(tok, cache, data, off, whole[i:j])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [tok.encode(t, add_special_tokens=False).ids for t in texts[i:j]]


@pytest.mark.parametrize("filled", [1, 1023, 1024, 1025, 5000])
def test_last_sequences_take_no_padding(spark, filled):
    docs = docs_of(spark, ["a " * (filled - 1)])
    pieces = packing.pack(docs, PATH).collect()
    check(pieces, {0: reference_ids("a " * (filled - 1))})


def test_chunks_are_forgotten_and_encoded_again(monkeypatch):
    """More distinct chunks than a worker remembers, some of them in every slice."""
    monkeypatch.setattr(packing, "CACHE", 60)
    tok, _ = packing.tokenizer(PATH)
    known, most = packing.Known(), 0
    for turn in range(30):
        texts = [f"always here {turn % 7} word{turn * 40 + k} x{k}" for k in range(40)]
        (_, _, data, off), = slices(pa.array(texts))
        ids, counts = packing.encode_slice(tok, known, data, off, np.zeros(len(texts), bool))
        assert ids.tolist() == [i for t in texts for i in reference_ids(t)[:-1]]
        assert counts.tolist() == [len(reference_ids(t)) - 1 for t in texts]
        assert (np.diff(known.key) > 0).all() and len(known.ids) == known.size.sum()
        most = max(most, len(known.key))
    assert most < 300


def test_a_remembered_chunk_takes_few_bytes():
    """The remembered chunks stay in an idle worker: they took some 200 bytes each."""
    known = packing.Known()
    keys = np.arange(50_000, dtype=np.uint64) * np.uint64(7919)
    assert not known.holds(keys).any()
    known.add(keys, [[1, 2, 3]] * len(keys))
    assert known.holds(keys).all()
    assert sum(x.nbytes for x in (known.key, known.base, known.size, known.seen, known.ids)) <= 40 * len(keys)

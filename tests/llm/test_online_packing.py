"""Online packing: every id in one piece, padding bounded whatever the input."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeforge.llm import online_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, capacity):
    tok = Tokenizer.from_file(PATH)
    want = {}
    for doc, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.setdefault(doc, []).append(ids)
    for doc in {d for d, n in want.items() if len(n) == 1}:
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        ids, at = want[doc][0], 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)
    assert sum(r.length for r in got) == sum(len(i) // 4 for n in want.values() for i in n)
    fills = {}
    for r in got:
        fills.setdefault(r.sequence_id, []).append(r)
    short = []
    for seq in fills.values():
        seq.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in seq]).tolist()
        assert [r.offset for r in seq] == [0, *ends[:-1]] and ends[-1] <= capacity
        if ends[-1] < capacity:
            short.append(ends[-1])
    assert all(s & (s - 1) == 0 for s in short) and len(short) == len(set(short))  # no padding at all


@pytest.mark.parametrize("most, merged", [(2, 2), (online_packing.OPEN, online_packing.MERGED)])
def test_every_id_has_one_place(spark, docs_of, most, merged):
    rnd = random.Random(31)
    rows = [(i, "ha " * rnd.choice([0, 1, 3, 40, 90, 260])) for i in range(300)]
    rows += [(500, "ha ha"), (500, "ha ha"), (None, None), (None, "ho"), (501, "long " * 20_000), (502, "")]
    docs = docs_of(rows).repartition(9)
    got = online_packing.pack(docs, PATH, 2, capacity=128, most=most, merged=merged)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(rows, got.collect(), 128)


def test_nothing_and_one(docs_of):
    assert online_packing.pack(docs_of([]), PATH, 2).count() == 0
    one = online_packing.pack(docs_of([None]), PATH, 2).collect()
    assert [(r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(0, 1, 1, 0)]


def test_windows_stay_bounded_and_best_fit():
    w = online_packing.Windows(10, 2)
    piece = lambda n: online_packing.Piece(n, 0, b"abcd" * n, n)
    assert not list(w.place(piece(6))) and not list(w.place(piece(7)))
    assert not list(w.place(piece(2))) and sorted(room for room, _ in w.held) == [1, 4]  # the fuller one that fits
    full = list(w.place(piece(5)))  # fits nowhere: the fullest is topped up with one, four go where they just fit
    assert [[len(p) for p in s] for s in full] == [[7, 2, 1], [6, 4]] and not w.held
    assert [[len(p) for p in s] for s in w.place(piece(25))] == [[10], [10]] and len(w.held) == 1

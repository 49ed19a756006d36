import itertools
import zlib

import numpy as np
import pytest

from loanscope.llm import packing
from llm_edges import TEXTS, empty, frame


def optimum(sizes, capacity):
    best = len(sizes)
    for parts in itertools.product(range(len(sizes)), repeat=len(sizes)):
        fill = np.bincount(parts, weights=sizes)
        if fill.max() <= capacity:
            best = min(best, int((fill > 0).sum()))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_bound_below_optimum_below_best_fit(seed):
    sizes = np.random.default_rng(seed).integers(1, 21, 6)
    seq, off = packing.best_fit_decreasing(sizes, 20)
    best = optimum(sizes, 20)
    assert packing.lower_bound(sizes, 20) <= best <= seq.max() + 1
    for b in range(seq.max() + 1):
        own = sorted(zip(off[seq == b], sizes[seq == b]))
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 20


def test_dual_feasible_bounds_beat_the_sum():
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3
    assert packing.lower_bound(np.array([7] * 6), 20) >= 3
    assert packing.lower_bound(np.array([20, 20]), 20) == 2
    assert packing.lower_bound(np.zeros(0, np.int64), 20) == 0


def test_bound_over_counted_lengths():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 100, rng.integers(1, 200))
        assert packing.lower_bound(*np.unique(sizes, return_counts=True)[:1], 100, np.unique(sizes, return_counts=True)[1]) == packing.lower_bound(sizes, 100)


def test_certified_total_ends_exchanges(spark, monkeypatch):
    """Pieces that cannot share a sequence: the plain sum would ask for an exchange, the bound does not."""
    df = spark.createDataFrame([(i, 0, 0, 600, 0) for i in range(120)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    names, write = [], packing.staged
    monkeypatch.setattr(packing, "staged", lambda d, name: names.append(name) or write(d, name))
    assert len({r.sequence_id for r in packing.pack(df, 1000, partition_pieces=40).collect()}) == 120
    assert names == ["pieces", "packed-0"]


def test_exchanges_close_gaps(spark):
    """Many partitions of few pieces each leave one loose sequence apiece."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 300, 900))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    total = sum(r[3] for r in rows)
    alone = {(r.sequence_id) for r in packing.pack(df, 1000, partition_pieces=40, rounds=0).collect()}
    got = packing.pack(df, 1000, partition_pieces=40).collect()
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in fill.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(n for _, n in v) <= 1000
    assert sorted(r.doc_id for r in got) == list(range(900))
    assert -(-total // 1000) <= len(fill) < len(alone)


def test_pieces_and_edges(spark):
    df = frame(spark)
    parts = packing.pieces(df, "doc_id", "text", length=64)
    rows = packing.pack(parts, 64).collect()
    encode = packing.id_bytes(packing.WORD_BPE, 1)
    want = []
    for i, raw in enumerate(encode(TEXTS + [TEXTS[1]])):
        name = None if i == 5 else 1 if i == len(TEXTS) else i
        want += [(name, k, at // 4, len(raw[at:at + 256]) // 4, zlib.crc32(raw[at:at + 256])) for k, at in enumerate(range(0, len(raw), 256))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    assert packing.pack(packing.pieces(empty(spark), "doc_id", "text")).collect() == []


def test_spellings_and_marks_of_a_word_are_one_string():
    import inspect

    import public_tokenizers
    from tokenizers import Tokenizer
    texts = ["Word, word. WORD! word### ÉTÉ été;", "a<|endoftext|>B, <|ENDOFTEXT|>", "T̈, x≮ it's, a-'s K. ſ,", "a\xa0B\tc\r\nd"]
    encode = packing.id_bytes(packing.WORD_BPE, 1)
    library = Tokenizer.from_file(public_tokenizers.path(packing.WORD_BPE))
    assert encode(texts) == [b"".join(i.to_bytes(4, "little") for i in [*e.ids, 1]) for e in library.encode_batch(texts, add_special_tokens=False)]
    encode = packing.id_bytes(packing.WORD_BPE, 1)
    encode(texts[:1])
    assert set(inspect.getclosurevars(encode).nonlocals["known"]) <= {"", "word", "été", ",", ".", "!", "###", ";"}

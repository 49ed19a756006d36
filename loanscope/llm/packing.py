"""Operator 3: bound-certified best-fit packing.

Documents become token pieces of at most ``length`` ids.  Pieces are dealt to
partitions of a bounded number of pieces and each partition packs its own by
best-fit decreasing.  A lower bound from dual feasible functions certifies the
partition: no packing of these pieces needs fewer sequences.  Partitions with a
gap, and the least filled sequence of every certified one, hand their pieces to
an exchange: they are dealt anew (to other partitions) and packed again, until the
sum meets the same bound over all pieces (it needs how many there are of each length,
no more) or a round gains nothing.  An exchange whose
result is not better is not taken over, so rounds never lose.

Null text is the empty document (its one id is the end id); repeated rows are
separate documents; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

from .common import REMEMBERED, map_arrow, slices, staged, table

WORD_BPE = "word_bpe_49k.json"
LENGTH = 4096
#: Pieces one task packs.
PARTITION_PIECES = 40_000
#: Strings whose ids a worker remembers from task to task (some 130 bytes each); only a
#: matter of speed.
KNOWN_WORDS = 1_000_000
#: The worker's encoders, kept while it works for this operator.
_ENCODERS: dict = {}


def forget() -> None:
    _ENCODERS.clear()


REMEMBERED.append(forget)


def id_bytes(vocabulary: str, end_id: int):
    """text -> its ids as little-endian unsigned 32-bit numbers, the end id last.

    No pre-token spans white space, so a text's ids are those of the strings
    between its blanks, each put to the library once and remembered by its place in one
    table of ids.  Arrow cuts the texts and finds their distinct strings; only these are
    looked up one by one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    # Lower-case words of Latin letters pass its normalizer and pattern unchanged: they can
    # go straight to the merges.  So texts of Latin-1 alone without special strings, which
    # it composes no further, are put in lower case first, and ASCII marks behind a letter
    # (but the apostrophe), always a pre-token of their own, behind a blank.
    merges = Tokenizer(tok.model)
    merges.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
    special = "".join(f"|(?i:{re.escape(t.content)})" for t in tok.get_added_tokens_decoder().values())
    other = f"[^\\x00-\\x{{ff}}]{special}"
    pieces_of, suffix = tok.get_vocab(), tok.model.end_of_word_suffix
    last = np.zeros(1 + max(pieces_of.values(), default=0), bool)
    last[[i for p, i in pieces_of.items() if suffix and p.endswith(suffix)]] = True
    letter, mark = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[!-&(-/:-@\\[-`{-~]"
    latin = re.compile(f"^{letter}+$", re.M)
    end = struct.pack("<I", end_id)
    known: dict[str, int] = {}  # a string between blanks -> its number
    table, till = array("I"), array("q")  # ids of all numbers, and where each one's end

    def add(words: list[str], encodings) -> None:
        first = len(till)
        for e in encodings:
            table.extend(e.ids)
            till.append(len(table))
        known.update(zip(words, range(first, len(till))))

    def empty() -> None:
        known.clear()
        del table[:], till[:]
        till.append(0)
        known[""] = 0

    def learn(words: list[str]) -> None:
        """Strings not met before."""
        plain = latin.findall("\n".join(words))
        lower = "\n".join(plain).lower().split("\n") if plain else []
        missing = list(set(lower).difference(known))
        # Many words a call, as each call has a price: the vocabulary marks a word's last piece.
        groups = [missing[i:i + 100] for i in range(0, len(missing), 100)]
        for g, e in zip(groups, merges.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(last[ids]) + 1
            if len(stops) != len(g):  # a vocabulary without such marks
                add(g, merges.encode_batch_fast(g, add_special_tokens=False))
                continue
            known.update(zip(g, range(len(till), len(till) + len(g))))
            till.extend((len(table) + stops).tolist())
            table.frombytes(ids.tobytes())
        known.update([(w, known[c]) for w, c in zip(plain, lower) if w != c])
        if len(plain) < len(words):
            rest = [w for w in words if w not in known]
            add(rest, tok.encode_batch_fast(rest, add_special_tokens=False))

    def encode(texts: list) -> list[bytes]:
        if len(known) > KNOWN_WORDS:
            empty()
        col = pc.replace_substring(pa.array([t or "" for t in texts], pa.large_string()), "\n", " ")
        eased = pc.replace_substring_regex(pc.utf8_lower(col), f"({letter})({mark})", r"\1 \2")
        parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(col, other), col, eased), " ")
        words = parts.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if new := [w for w in names if w not in known]:
            learn(new)
        number = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        stop = np.frombuffer(till, np.int64)
        first = stop[np.maximum(number - 1, 0)]
        no = words.indices.to_numpy()
        size = (stop[number] - first)[no]
        place = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(table, np.uint32)[np.arange(place[-1]) + np.repeat(first[no] - place[:-1], size)].astype("<u4").tobytes()
        bounds = (4 * place[parts.offsets.to_numpy()]).tolist()
        return [raw[a:b] + end for a, b in zip(bounds, bounds[1:])]

    empty()
    return encode


PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, vocabulary: str = WORD_BPE,
           end_id: int = 1) -> DataFrame:
    """Token pieces of each document, in order."""
    kind = dict(df.dtypes)[id_col]

    def build():
        encode = _ENCODERS.get((vocabulary, end_id)) or _ENCODERS.setdefault((vocabulary, end_id), id_bytes(vocabulary, end_id))

        def step(b):
            for first, texts in slices(b, 1):
                rows, no, start, size, crc = [], [], [], [], []
                for i, ids in enumerate(encode(texts)):
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at:at + 4 * length]
                        rows.append(first + i)
                        no.append(k)
                        start.append(at // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        return step

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), build, PIECE.format(kind=kind), keep=forget)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: largest first, into the fullest
    sequence with room.  Open sequences are kept by free space, so each piece
    costs a look at the next occupied free space only."""
    seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: dict[int, list[int]] = {}
    spaces: list[int] = []  # sorted free spaces in use
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(spaces, s)
        if k < len(spaces):
            space = spaces[k]
            b = free[space].pop()
            if not free[space]:
                del free[space]
                del spaces[k]
        else:
            space, b = capacity, made
            made += 1
        seq[i], off[i] = b, capacity - space
        if left := space - s:
            if left not in free:
                bisect.insort(spaces, left)
                free[left] = []
            free[left].append(b)
    return seq, off


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Largest bound of two families of dual feasible functions (and the mere
    sum): ``u_k`` rounds sizes to multiples of capacity / (k + 1), ``v_e`` counts
    pieces above capacity - e as whole and those below e as nothing.
    ``times``: how often each of the (then distinct, rising) sizes occurs."""
    if not len(sizes):
        return 0
    values, counts = np.unique(sizes.astype(np.int64), return_counts=True) if times is None else (sizes, times)
    best = -(-int(values @ counts) // capacity)
    for k in range(1, 21):
        x = (k + 1) * values
        scaled = np.where(x % capacity == 0, k * x // (k + 1), (x // capacity) * capacity)  # k * capacity is one sequence
        best = max(best, -(-int(scaled @ counts) // (k * capacity)))
    total, heads = np.cumsum(values * counts), np.cumsum(counts)
    for e in np.unique(np.minimum(values, capacity - values)):
        if 0 < e <= capacity // 2:
            small = np.searchsorted(values, e)            # below e: nothing
            large = np.searchsorted(values, capacity - e, side="right")  # above capacity - e: whole
            middle = (total[large - 1] if large else 0) - (total[small - 1] if small else 0)
            whole = int(heads[-1] - (heads[large - 1] if large else 0))
            best = max(best, whole - (-max(0, int(middle)) // capacity))
    return int(best)


_ROUND = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, _row long, _group long, _seq long, offset long, _fill long, _gap long, _open boolean"


def _packed(df: DataFrame, kind: str, capacity: int) -> DataFrame:
    """One round: every ``_group`` packed; ``_gap`` its sequences above the bound,
    ``_open`` the pieces that may still be exchanged."""
    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_row", kind="stable")
        sizes = g["length"].to_numpy()
        seq, off = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(seq, weights=sizes).astype(np.int64)
        gap = len(fill) - lower_bound(sizes, capacity)
        least = fill == fill.min() if gap == 0 else fill < capacity
        least &= fill < capacity
        if gap == 0:
            least &= np.arange(len(fill)) == int(np.argmin(fill))
        return g.assign(_seq=seq, offset=off, _fill=fill[seq], _gap=gap, _open=least[seq])

    return df.groupBy("_group").applyInPandas(pack, _ROUND.format(kind=kind))


def pack(parts: DataFrame, capacity: int = LENGTH, partition_pieces: int = PARTITION_PIECES, rounds: int | None = None) -> DataFrame:
    """``parts`` (see :func:`pieces`) with ``sequence_id`` and ``offset``; ``rounds``:
    exchanges to stop after, by default not before they stop to gain."""
    kind = dict(parts.dtypes)["doc_id"]
    cols = [c for c in parts.columns]
    src = staged(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    lengths = np.array(src.groupBy("length").count().orderBy("length").collect(), np.int64).reshape(-1, 2)  # ``capacity`` rows at most
    n, bound = int(lengths[:, 1].sum()), lower_bound(lengths[:, 0], capacity, lengths[:, 1])
    groups = max(1, -(-n // partition_pieces))
    deal = lambda r, k: F.pmod(F.xxhash64(F.lit(r), "_row"), F.lit(k)).cast("long")
    now = staged(_packed(src.withColumn("_group", deal(0, groups)), kind, capacity), "packed-0")
    # Sequence numbers: groups counted over all rounds, then the place in the group.
    done, first, r = [], 0, 0
    final = lambda d, at: d.select(*cols, (F.shiftleft(F.col("_group") + F.lit(at), 28) + F.col("_seq")).alias("sequence_id"), "offset")
    count = lambda d: d.select("_group", "_seq").distinct().count()
    total = count(now)
    while total > bound and r != rounds:
        # Sequences only: the pieces of open ones are dealt anew.
        moving, r = now.where("_open"), r + 1
        held, before = moving.count(), count(moving)
        if before < 2:
            break
        again = max(1, -(-held // partition_pieces))
        packed = staged(_packed(moving.select(*cols, "_row").withColumn("_group", deal(r, again)), kind, capacity), f"packed-{r}")
        after = count(packed)
        if after >= before:
            break
        done.append(final(now.where("not _open"), first))
        total, now, first, groups = total - before + after, packed, first + groups, again
    done.append(final(now, first))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces in as few sequences of 4096 tokens as found."""
    return pack(pieces(table(spark, sf_dir, "documents"), "doc_id", "text"))

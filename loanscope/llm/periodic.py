"""Operator 11: periodic runs of words by suffix-tree common extensions.

A run is a stretch of words with smallest period q, no shorter than ``least`` words and
``times`` periods, that no neighbouring word extends.  Every run holds, in one of the two
orders of the alphabet, a Lyndon root that is the longest Lyndon word at its place, so
the candidates are at most two for each word: the place of the next smaller suffix in
that order.  A candidate is extended in both directions by longest common extensions:
to the right in Ukkonen's suffix tree of the document, to the left in that of its
reversal, each answered in constant time as the depth of a lowest common ancestor, a
range minimum over the tree's Euler tour.  A Lyndon word has no shorter period, so the
root's length is the run's smallest period.

Trees cost some microseconds a word, so they are built only where a run can be.  Inside
a run of period q all but the last q words come again within q words, and there are
``times - 1`` periods of them.  For each power of two, stretches of words that come again
within so many words and are long enough for a period of that size are marked, with as
many words behind them; a document's tree is that of its marked stretches, set apart by
words of their own.  Every run lies in one stretch whole, so this loses none and no run
changes; a stretch without one costs time only.

One map over the scan, no shuffle: a document is one row, whole, and memory is bounded
by one slice of texts or one longer text (some 400 bytes a word of its marked
stretches).  Words are maximal stretches of ``[^\\x20\\x09-\\x0D]``.  Null, empty and
blank texts have no words, no runs and an empty collapsed text; repeated rows are worked
off each; an empty table gives no rows; a null id is passed on; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

BLANKS = "\t\n\v\f\r"
BLOCK = 32


class SuffixTree:
    """Ukkonen's tree of a list of symbols (1 and up), with constant-time common
    extensions of its suffixes.  ``rank``: place of each suffix in lexicographic order."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]  # the end is the smallest symbol
        n, width = len(text), max(text) + 1
        start, stop, link, leaves, edges = [0], [0], [0], [], {}
        node = length = at = left = 0
        for i, c in enumerate(text):
            left += 1
            last = 0
            while left:
                if not length:
                    at = i
                key = node * width + text[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[child]
                    edge = stop[child] - begin
                    if length >= edge:
                        node = child
                        length -= edge
                        at += edge
                        continue
                    if text[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    inner = len(start)
                    edges[key] = inner
                    edges[inner * width + c] = inner + 1
                    edges[inner * width + text[begin + length]] = child
                    leaves.append(inner + 1)
                    start += (begin, i)
                    stop += (begin + length, n)
                    link += (0, 0)
                    start[child] = begin + length
                    if last:
                        link[last] = inner
                    last = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - left + 1
        self._tour(edges, width, np.array(stop) - np.array(start), np.array(leaves))

    def _tour(self, edges: dict, width: int, lengths: np.ndarray, leaves: np.ndarray) -> None:
        """Euler tour in order of symbols, its depths, and minima of blocks of it."""
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        kids = np.fromiter(edges.values(), np.int64, len(edges))[order]
        parents = keys[order] // width
        above = np.zeros(len(lengths), np.int64)
        above[kids] = parents
        first = np.searchsorted(parents, np.arange(len(lengths) + 1)).tolist()
        turn, kids = first[:-1], kids.tolist()
        path, tour = [0], []
        while path:
            v = path[-1]
            tour.append(v)
            k = turn[v]
            if k < first[v + 1]:
                turn[v] = k + 1
                path.append(kids[k])
            else:
                path.pop()
        tour = np.array(tour)
        here, there = tour[:-1], tour[1:]
        down = (there != 0) & (above[there] == here)
        depths = np.concatenate([[0], np.cumsum(np.where(down, lengths[there], -lengths[here]))]).astype(np.int32)
        place = np.empty(len(lengths), np.int64)
        place[tour] = np.arange(len(tour))
        self.place = place[leaves]  # a leaf is visited once
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[np.argsort(self.place)] = np.arange(len(leaves))
        pad = -len(depths) % BLOCK
        self.depths = np.concatenate([depths, np.full(pad, np.iinfo(np.int32).max, np.int32)])
        blocks = self.depths.reshape(-1, BLOCK)
        self.prefix = np.minimum.accumulate(blocks, axis=1).ravel()
        self.suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.powers = [blocks.min(axis=1)]
        while 2 << (len(self.powers) - 1) <= len(blocks):
            row, step = self.powers[-1], 1 << (len(self.powers) - 1)
            self.powers.append(np.minimum(row[:-step], row[step:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at ``a`` and at ``b`` (a != b)."""
        lo, hi = self.place[a], self.place[b]
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        out = np.minimum(self.suffix[lo], self.prefix[hi])
        low, high = lo // BLOCK + 1, hi // BLOCK
        far = np.flatnonzero(high > low)
        if len(far):
            level = np.frexp((high - low)[far])[1] - 1  # floor of the binary logarithm
            for k in np.unique(level):
                some = far[level == k]
                row = self.powers[k]
                out[some] = np.minimum(out[some], np.minimum(row[low[some]], row[high[some] - (1 << k)]))
        near = np.flatnonzero(high < low)  # both in one block
        if len(near):
            cells = lo[near, None] + np.arange(BLOCK)
            inside = np.where(cells <= hi[near, None], self.depths[np.minimum(cells, len(self.depths) - 1)], np.iinfo(np.int32).max)
            out[near] = inside.min(axis=1)
        return out


def _next(rank: list[int], smaller: bool) -> np.ndarray:
    """Place of the next smaller (larger) rank behind each, -1 if there is none."""
    out, waiting = [-1] * len(rank), []
    for i, r in enumerate(rank):
        while waiting and (rank[waiting[-1]] > r) == smaller:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out)


def runs(symbols: list[int], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of symbols (1 and up), sorted."""
    n = len(symbols)
    if n < max(least, 2):
        return []
    tree = SuffixTree(symbols)
    rank = tree.rank.tolist()
    places = np.arange(n)
    follows = [_next(rank, smaller)[:n] for smaller in (True, False)]  # the Lyndon word at i ends before it
    at = np.concatenate([places[f >= 0] for f in follows])
    period = np.concatenate([f[f >= 0] for f in follows]) - at
    inside = at + period < n
    at, period = at[inside], period[inside]
    ahead = tree.extension(at, at + period)
    # A run's root can be taken from its first two periods, and so has the others ahead.
    good = (ahead >= (times - 2) * period) & (ahead + at + period >= least)
    at, period, ahead = at[good], period[good], ahead[good]
    if not len(at):
        return []
    back = np.zeros(len(at), np.int64)
    left = at > 0
    if left.any():
        mirror = SuffixTree(symbols[::-1])
        back[left] = mirror.extension(n - at[left], n - at[left] - period[left])
    length = period + ahead + back
    good = (length >= least) & (length >= times * period)
    return sorted(set(zip((at - back)[good].tolist(), length[good].tolist(), period[good].tolist())), key=lambda r: (r[0], r[2]))


def marked(ids: np.ndarray, ends: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches that hold all runs, disjoint and in order.  ``ids``: words of
    texts one after the other, alike only inside a text; ``ends``: for each word, its text's end."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n + 1)
    alike = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][alike]] = (order[1:] - order[:-1])[alike]
    found, k = [], 0
    longest = int((ends - np.arange(n)).max(initial=0))
    while k == 0 or times * ((1 << (k - 1)) + 1) <= longest:
        most, fewest = 1 << k, (1 << k) // 2 + 1  # periods of this size
        edges = np.flatnonzero(np.diff(again <= most, prepend=False, append=False))
        begin, end = edges[::2], edges[1::2]
        keep = end - begin >= max((times - 1) * fewest, least - most)
        begin, end = begin[keep], end[keep]
        found.append(np.stack([begin, np.minimum(end + most, ends[begin])], axis=1))
        k += 1
    found = np.concatenate(found)
    out: list[tuple[int, int]] = []
    for a, b in found[np.argsort(found[:, 0], kind="stable")].tolist():
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of_texts(texts: list[list[str]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words."""
    sizes = [len(t) for t in texts]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list] = [[] for _ in texts]
    n = int(begins[-1])
    if not n:
        return out
    words = np.empty(n, object)
    words[:] = [w for t in texts for w in t]
    codes, names = pd.factorize(words)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ids = codes.astype(np.int64) * len(texts) + owner
    parts: dict[int, list] = {}
    for a, b in marked(ids, begins[owner + 1], least, times):
        parts.setdefault(int(owner[a]), []).append((a, b))
    for d, stretches in parts.items():
        places = np.concatenate([np.arange(a, b + 1) for a, b in stretches])[:-1]  # b stands for the word that sets them apart
        apart = np.cumsum([b - a + 1 for a, b in stretches])[:-1] - 1
        _, symbols = np.unique(codes[np.minimum(places, n - 1)], return_inverse=True)
        symbols = symbols + 1
        symbols[apart] = symbols.max() + 1 + np.arange(len(apart))
        out[d] = sorted(((int(places[s] - begins[d]), m, p) for s, m, p in runs(symbols.tolist(), least, times)), key=lambda r: (r[0], r[2]))
    return out


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    for c in BLANKS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words no run holds behind its first period, joined by blanks."""
    if not found:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return " ".join([w for w, k in zip(words, keep.tolist()) if k])


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(df: DataFrame, id_col: str, text_col: str, least: int = 6, times: int = 4,
                  altered: Callable[[list, object], list] | None = None) -> DataFrame:
    """``id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and the
    ``collapsed`` text of every row.  ``altered(words, id)`` may change the words first."""
    kind = dict(df.dtypes)[id_col]

    def build():
        def step(b):
            for first, texts in slices(b, 1):
                ids = b.column(0).slice(first, len(texts))
                words = [words_of(t) for t in texts]
                if altered is not None:
                    words = [altered(w, i) for w, i in zip(words, ids.to_pylist())]
                found = runs_of_texts(words, least, times)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(w) for w in words], pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], _RUN),
                     pa.array([collapsed(w, f) for w, f in zip(words, found)], pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])
        return step

    out = map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), build,
                    f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def planted(words: list[str], doc_id) -> list[str]:
    """The contract's words: a tenth of the documents, by their number's crc32, end periodically."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of six words and four periods or more in every document, and digests of them
    and of the text without their repeats."""
    found = periodic_runs(table(spark, sf_dir, "documents"), "doc_id", "text", altered=planted)
    # The first of the greatest length / period, compared by cross-multiplication.
    best = F.expr("aggregate(runs, runs[0], (a, r) -> if(r.length * a.period > a.length * r.period, r, a))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("_best"),
                         F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
                 .select("doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
                         F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))

"""Operator 8: language identification by prediction by partial matching.

Each language has a byte context tree: for contexts of 0 to ``ORDER`` bytes, how
often each byte followed.  A byte's code length is ``-log2`` of its frequency in
the longest context seen, ``n(byte) / (n + d)``; a context that never saw the byte
costs the escape ``d / (n + d)`` (``d`` distinct followers) and the next shorter one
is asked; below order 0 every byte has 1/256.  The statistics are frozen after
training, so a code length is a function of context and byte alone.  Texts are
coded as lower-case words (runs of letters, each between blanks); a context reaches
back to the blank before its word.  The language with the shortest code wins; the
score is its posterior probability under equal priors.

Training uses at most ``SAMPLE`` labelled rows of each language, chosen by a hash (a
documented bound; whole texts); every label is learnt, and where labels are many each
brings fewer rows, so that about ``ROWS`` reach the driver, but one at least.  The frozen
tables are then a few MB, are merged over languages (one look-up gives all code lengths)
and go to the tasks.  Prediction is one map over the scan: no shuffle, whole texts.

Null texts and texts without letters are ``und`` with score 0; ties go to the
smaller language name; with no training rows every text is ``und``; null labels do
not train; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import lookup
from .common import fresh, map_arrow, slices, staged, table

ORDER = 4
#: Training rows of each language at most.
SAMPLE = 300
#: Training rows of all languages, as long as one of each is no more.
ROWS = 150_000
#: Mean bits a byte above which a text is in none of the languages learnt.
REJECT_BITS = 6.5
UNKNOWN = "und"
#: Words whose bits are computed at once: each of their bytes takes some 40 bytes a language.
WORDS = 1 << 14
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: Counter, order: int) -> Counter:
    """(context + byte) -> occurrences, contexts of exactly ``order`` bytes."""
    out: Counter = Counter()
    for w, n in words.items():
        b = b" " + w.encode() + b" "
        for i in range(max(1, order), len(b)):
            out[b[i - order:i + 1]] += n
    return out


def _pack(grams: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(g, "big") for g in grams], np.int64)


class Model:
    """Frozen code lengths.  For each order: sorted packed grams with bits per
    language, and sorted packed contexts with escape bits per language."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs = sorted(texts)
        self.order = order
        words = {k: Counter(w for t in v for w in words_of(t)) for k, v in texts.items()}
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        for o in range(order + 1):
            found = {k: _grams(words[k], o) for k in self.langs}
            totals = {k: Counter() for k in self.langs}
            kinds = {k: Counter() for k in self.langs}
            for k in self.langs:
                for g, n in found[k].items():
                    totals[k][g[:-1]] += n
                    kinds[k][g[:-1]] += 1
            grams = sorted(set().union(*found.values())) if found else []
            contexts = sorted(set().union(*totals.values())) if found else []
            escape = np.zeros((len(contexts), len(self.langs)))
            for j, k in enumerate(self.langs):
                for i, c in enumerate(contexts):
                    if d := kinds[k][c]:
                        escape[i, j] = -np.log2(d / (totals[k][c] + d))
            packed = _pack(grams)
            # What a language that never saw the gram pays: escape, then the shorter context.
            lower = self._bits(packed & ((1 << 8 * o) - 1), o - 1) if len(packed) else np.zeros((0, len(self.langs)))
            at = np.searchsorted(_pack(contexts), packed >> 8) if len(packed) else np.zeros(0, np.int64)
            bits = lower + escape[at]
            for j, k in enumerate(self.langs):
                for i, g in enumerate(grams):
                    if n := found[k][g]:
                        bits[i, j] = -np.log2(n / (totals[k][g[:-1]] + kinds[k][g[:-1]]))
            self.grams.append(packed)
            self.bits.append(bits)
            self.contexts.append(_pack(contexts))
            self.escapes.append(escape)

    def _bits(self, packed: np.ndarray, order: int, left: np.ndarray | None = None) -> np.ndarray:
        """Bits per language of packed grams of ``order`` + 1 bytes."""
        out = np.full((len(packed), len(self.langs)), 8.0)
        if order < 0 or not len(packed):
            return out
        at = np.searchsorted(self.grams[order], packed)
        hit = at < len(self.grams[order])
        hit[hit] = self.grams[order][at[hit]] == packed[hit]
        out[hit] = self.bits[order][at[hit]]
        if not hit.all():
            miss = packed[~hit]
            cost = self._bits(miss & ((1 << 8 * order) - 1), order - 1)
            c = np.searchsorted(self.contexts[order], miss >> 8)
            known = c < len(self.contexts[order])
            known[known] = self.contexts[order][c[known]] == (miss >> 8)[known]
            cost[known] += self.escapes[order][c[known]]
            out[~hit] = cost
        return out

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Code length of each word, blank after it included, per language."""
        if len(words) > WORDS:
            return np.concatenate([self.word_bits(words[i:i + WORDS]) for i in range(0, len(words), WORDS)])
        coded = [b" " + w.encode() + b" " for w in words]
        size = np.array([len(b) for b in coded], np.int64)
        if not len(size):
            return np.zeros((0, len(self.langs)))
        flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        start = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(flat)) - start
        total = np.zeros((len(flat), len(self.langs)))
        packed, done = flat.copy(), flat.copy()
        for o in range(1, self.order + 1):
            done = np.concatenate([[0], done[:-1]]) if o == 1 else np.concatenate([np.zeros(1, np.int64), done[:-1]])
            packed |= np.where(place >= o, done << (8 * o), 0)
        for o in range(1, self.order + 1):  # a byte's context: back to the blank, ORDER at most
            own = place == o if o < self.order else place >= o
            total[own] = self._bits(packed[own], o)
        ends = np.cumsum(size)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(total, axis=0)])
        return sums[ends] - sums[ends - size]


def scorer(model: Model):
    """texts -> (language, score, bits a byte) of each."""
    def score(texts: list) -> list[tuple[str, float, float]]:
        place: dict[str, int] = {}
        found = [[place.setdefault(w, len(place)) for w in words_of(t)] if t else [] for t in texts]
        if not model.langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        bits = model.word_bits(list(place))
        size = np.array([len(w.encode()) + 1 for w in place], np.int64)
        out = []
        for ids in found:
            if not ids:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            total = bits[ids].sum(axis=0)
            best = int(np.argmin(total))
            odds = np.exp2(np.maximum(total[best] - total, -1000.0))
            out.append((model.langs[best], float(1.0 / odds.sum()), float(total[best] / size[ids].sum())))
        return out

    return score


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, total: int = ROWS) -> Model:
    """A model of at most ``sample`` rows of each label, ``total`` shared out where
    labels are many: those with the smallest hash of id and text.  The label's row count
    leaves about twice as many rows before any is moved, however many tasks read
    the table; the bound holds for what reaches the driver too."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_h"))
    rows = rows.where("lang is not null and text is not null")
    labels = staged(rows.groupBy("lang").agg(F.count("*").alias("_c"), F.min("_h").alias("_m")), "labels")
    sample = max(1, min(sample, total // max(1, labels.count())))
    place = F.pmod("_h", "_c")
    # (The smallest hash besides: a label whose rows are all alike has but one place.)
    rows = rows.join(lookup(labels), "lang").where((place < 2 * sample) | (F.col("_h") == F.col("_m")))
    w = Window.partitionBy("lang").orderBy(place, "_h", "text")
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample).select("lang", "text")
    texts: dict[str, list[str]] = {}
    for lang, text in rows.collect():
        texts.setdefault(lang, []).append(text)
    return Model({k: v for k, v in texts.items() if any(map(words_of, v))})


def identify(df: DataFrame, model: Model, text_col: str, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (by default all; a text not among them is read and not sent
    back) with ``lang_pred``, ``score`` and ``bits`` (per byte) appended."""
    kept = model
    back = [f for f in df.schema.fields if columns is None or f.name in columns]

    def build():
        score = scorer(kept)

        def step(b):
            at = b.schema.get_field_index(carried)
            for first, texts in slices(b, at):
                part = b.slice(first, len(texts))
                lang, prob, bits = zip(*score(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in back), pa.array(lang, pa.string()), pa.array(prob, pa.float64()),
                                                  pa.array(bits, pa.float64())], names=[f.name for f in out.fields])
        return step

    from pyspark.sql.types import DoubleType, StringType, StructType
    carried = text_col
    out = StructType(list(back))
    for name, kind in ((fresh(df, "lang_pred"), StringType()), (fresh(df, "score"), DoubleType()), (fresh(df, "bits"), DoubleType())):
        out = out.add(name, kind)
    return map_arrow(df, build, out)


def held_out(id_col: Column | str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents")
    test = F.coalesce(held_out("doc_id"), F.lit(False))
    model = train(docs.where(~test), "doc_id", "text", "lang")
    return identify(docs.select("doc_id", test.alias("held_out"), "text"), model, "text", ["doc_id", "held_out"])

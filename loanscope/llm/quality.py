"""Operator 10: quality rules with compression bands.

Base rules count words, symbols, repeated lines and words inside 3-word windows
that occur twice.  The verdict comes from zstandard: a text is compressed whole and
in fixed chunks (a remainder in a last one that ends at the text's end), and each ratio (bytes / compressed bytes) must lie in a band that
depends on the length compressed, since a longer text offers more to refer back to.
Above the band the text repeats itself, below it is noise (keys, encoded binaries).
The bands are fixed parameters, not learnt from the table: base64 and the like stay
below 8 / 6 at any length, and further below it under 500 bytes, where the code's own
table weighs; running prose gives 1.5 to 3 and more the longer it is.  Under 256 bytes
the two overlap and noise passes.

One map over the scan, no shuffle; whole texts; memory bounded by one batch.
Null and empty texts have no words, fail the base rules and are not kept; repeated
rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

#: (bytes from, least ratio, largest ratio) for whole documents.
BANDS = ((0, 0.0, 3.0), (256, 1.25, 3.0), (512, 1.35, 4.0), (2048, 1.4, 5.0), (16384, 1.5, 6.0))
#: Fixed chunks: their bytes, the band of one chunk, and the share of a text's
#: chunks that may lie outside it.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 2048, (1.35, 4.5), 0.25
LEVEL = 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


def band(n_bytes: int) -> tuple[float, float]:
    return next((lo, hi) for at, lo, hi in reversed(BANDS) if n_bytes >= at)


def repeated_window_words(words: list[str], k: int = 3) -> int:
    """Words covered by ``k``-word windows that occur at least twice."""
    n = len(words)
    if n <= k:
        return 0
    seen: dict[str, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    ids = codes[:n - k + 1]
    for j in range(1, k):  # the id of the longer window: one number again after each step
        _, ids = np.unique(ids * len(seen) + codes[j:n - k + 1 + j], return_inverse=True)
    twice = np.bincount(ids)[ids] > 1
    covered = np.zeros(n, bool)
    for j in range(k):
        covered[j:n - k + 1 + j] |= twice
    return int(covered.sum())


def judge(text: str | None, pack: zstandard.ZstdCompressor) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio,
    chunks outside their band, chunks, in band)."""
    if not text:
        return 0, 0, 0, 0, 0, None, 0, 0, False
    flat = text
    for c in BLANKS[1:]:
        flat = flat.replace(c, " ")
    words = [w for w in flat.split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    raw = text.encode("utf-8", "surrogatepass")
    ratio = len(raw) / len(pack.compress(raw))
    lo, hi = band(len(raw))
    cuts = list(range(0, len(raw) - CHUNK + 1, CHUNK))
    if cuts and len(raw) % CHUNK:
        cuts.append(len(raw) - CHUNK)  # ends at the text's end
    out = sum(not CHUNK_BAND[0] <= CHUNK / len(pack.compress(raw[at:at + CHUNK])) <= CHUNK_BAND[1] for at in cuts)
    fits = lo <= ratio <= hi and out <= CHUNK_SHARE * len(cuts)
    return (len(words), len(flat) - flat.count(" "), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_window_words(words), ratio, out, len(cuts), fits)


_FIELDS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
           ("n_repeat_words", "long"), ("ratio", "double"), ("chunks_outside", "long"), ("chunks", "long"),
           ("in_band", "boolean"))
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def quality(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` for each row."""
    kind = dict(df.dtypes)[id_col]

    def build():
        pack = zstandard.ZstdCompressor(level=LEVEL)

        def step(b):
            for first, texts in slices(b, 1):
                cols = list(zip(*(judge(t, pack) for t in texts)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), *[pa.array(c, _ARROW[k]) for c, (_, k) in zip(cols, _FIELDS)]],
                    names=["id", *[n for n, _ in _FIELDS]])
        return step

    out = map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), build,
                    f"id {kind}, " + ", ".join(f"{n} {k}" for n, k in _FIELDS))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), *[n for n, _ in _FIELDS[:5]], failed.alias("base_failed"),
                      (~failed & F.col("in_band")).alias("kept"), "ratio", "chunks_outside", "chunks")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Base rules and compression bands for every document."""
    return quality(table(spark, sf_dir, "documents"), "doc_id", "text")

"""Operator 5: token counts by the whole-token shortcut.

Offline, every vocabulary string of a byte-level BPE file is put to the library
alone; those that come back as one token are *whole*.  A text is cut into
pre-tokens with the tokenizer's own pattern, its special strings counted as one
token each as the library does by default.  A pre-token that is whole counts 1;
only the others are merged, by the library, once per distinct string and task (up to
``KNOWN`` of them are remembered).
So a text has (pre-tokens) + sum(merged length - 1 over the rest) tokens.

The whole-token table has at most as many entries as the vocabulary.  Work is one
map over the scan: no shuffle, whole texts, memory bounded by one batch.

Null and empty texts have 0 tokens and 0 bytes.  Repeated rows are counted each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_arrow, slices, table

BYTE_BPE = "byte_bpe_50k.json"


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level vocabulary -> byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def prepared(path: str):
    """(library tokenizer, pre-token pattern, special strings, whole tokens)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    alphabet, words = _byte_alphabet(), []
    for piece in tok.get_vocab():
        if piece in special:
            continue
        try:
            words.append(bytes(alphabet[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    pattern = regex.compile(public_tokenizers.PATTERN)
    # A string is whole if it is one pre-token and the merges end in one token.
    whole = {w for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False))
             if len(e.ids) == 1 and pattern.fullmatch(w) and pattern.findall(w) == [w]}
    return tok, pattern, special, whole


def _differs(path: str, c: str) -> bool:
    """Whether the two Unicode tables class a character differently: the library's
    regular expressions know another version."""
    tok, pattern, _, _ = prepared(path)
    return len(tok.pre_tokenizer.pre_tokenize_str(f"a{c}1{c} {c}{c}!")) != len(pattern.findall(f"a{c}1{c} {c}{c}!"))


@lru_cache(maxsize=2)
def disputed(path: str) -> str:
    """All such characters.  Planes 0 to 3 and 14; no other has any."""
    return "".join(filter(lambda c: _differs(path, c), map(chr, (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)))))


#: Merged pre-tokens a task remembers from slice to slice; only a matter of speed.
KNOWN = 400_000


def counter(path: str, odd: str | None = None):
    """texts -> token counts.  Texts with a character of another class in the library are
    cut into pre-tokens by the library; ``odd`` lists these characters, by default each
    one is judged when it first comes up."""
    tok, pattern, special, whole = prepared(path)
    judged, strange = set(), set(odd or ())
    extra: dict[str, int] = {}

    def is_strange(text: str) -> bool:
        chars = set(text)
        if odd is None:
            for c in chars - judged:
                judged.add(c)
                if not c.isascii() and _differs(path, c):
                    strange.add(c)
        return not strange.isdisjoint(chars)

    def pre_tokens(text: str) -> list[str]:
        if not text.isascii() and is_strange(text):
            return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]
        return pattern.findall(text)

    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(texts: list) -> list[int]:
        sums, rests, wanted = [], [], set()
        if len(extra) > KNOWN:
            extra.clear()
        for t in texts:
            n, rest = 0, []
            if t:
                parts = [t]
                if cut is not None and any(s in t for s in special):
                    parts = cut.split(t)
                    n += len(parts) - 1
                for part in parts:
                    pre = pre_tokens(part)
                    n += len(pre)
                    rest += [p for p in pre if p not in whole]
            sums.append(n)
            rests.append(rest)
            wanted.update(rest)
        words = [w for w in wanted if w not in extra]
        extra.update((w, len(e.ids) - 1) for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False)))
        return [n + sum(map(extra.__getitem__, rest)) for n, rest in zip(sums, rests)]

    return count


def token_counts(df: DataFrame, id_col: str, text_col: str, limit: int = 1024,
                 vocabulary: str = BYTE_BPE) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row."""
    path = public_tokenizers.path(vocabulary)
    kind = dict(df.dtypes)[id_col]

    def build():
        count = counter(path)

        def step(b):
            for first, texts in slices(b, 2):
                n = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([n.column(0), n.column(1), pa.array(count(texts), pa.int64())],
                                                 names=["id", "n_bytes", "n_tokens"])
        return step

    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                    F.col(text_col).alias("text"))
    out = map_arrow(src, build, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")

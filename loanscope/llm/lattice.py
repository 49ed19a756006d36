"""Operator 2: SentencePiece encoding and decoding over a relational lattice.

The escaped text (blanks as U+2581, one put in front) is cut into *words*: between two
characters that stand side by side in no piece no piece can ever lie, so a word's
pieces do not depend on its surroundings.  Over the distinct words of the table, long ones
carried by a digest so that a run of a hundred thousand blanks is not copied with each of
its substrings:

1. explode the substrings of up to the longest piece's length,
2. equi-join them to the piece table (bounded by the vocabulary, broadcast): the
   matches, and the characters that are no piece, are the edges of the word's lattice,
3. group the edges by word,
4. fold.  A unigram model folds Viterbi with Spark's higher-order ``aggregate`` over
   the word's end positions and a second one back along the best path.  A BPE model
   does not choose the path of the largest sum, so Viterbi would not give the
   library's ids: over the same edges it folds the merges, best score first.

Characters that are no piece become their byte pieces, or the unknown piece.

Texts travel as compressed blocks (``BLOCK_CHARS`` characters or one text): the block's
distinct words and its texts as numbers of them.  Blocks are dealt once, and both sides
read that exchange: one lists the words, by the partition their checksum names, where they
stay through substrings, edges and folds; the ids go back, many words a row, to the blocks
that hold them and each block puts its own texts together.  A frequent word is one
word in each block, whatever the number of its occurrences.  The ids of a text are
decoded again and compared with it: ``round_trip``.

Null and empty texts have no pieces; repeated rows are encoded each; an empty table
gives no rows; other columns are ignored.  Texts that are not valid UTF-8 when
decoded do not occur: ids that do not form it decode to U+FFFD as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, release, slices, table

MODEL = "piece_bpe_32k.model"
BLOCK_CHARS = 8 << 20
#: Characters cut at once by the numpy kernel.
CUT_CHARS = 1 << 20
#: Longer words are carried by their digest (which is longer still, so it is never a word).
KEY_CHARS = 32
BLANK = "▁"


class Vocabulary:
    """Pieces of a model file: what encoding and decoding have to know."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.unigram = proto.trainer_spec.model_type == 1
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        own = proto.SentencePiece
        self.pieces = [(p.piece, i, float(p.score)) for i, p in enumerate(proto.pieces) if p.type in (own.NORMAL, own.USER_DEFINED)]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == own.BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == own.UNKNOWN)
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.least = min(s for _, _, s in self.pieces)
        self.length = np.zeros(len(proto.pieces), np.int64)
        self.score = [0.0] * len(proto.pieces)
        for p, i, score in self.pieces:
            self.length[i], self.score[i] = len(p), score
        # A number for each character of a pair that stands in a piece (0: any other), and
        # a bit for each such pair.
        beside = sorted({(ord(a), ord(b)) for p, _, _ in self.pieces for a, b in zip(p, p[1:])})
        self.kind = np.zeros(0x110000, np.int32)
        found = sorted({c for pair in beside for c in pair})
        self.kind[found] = np.arange(1, len(found) + 1)
        self.pairs = np.zeros((len(found) + 1, len(found) // 8 + 1), np.uint8)
        for a, b in beside:
            self.pairs[self.kind[a], self.kind[b] >> 3] |= 1 << (self.kind[b] & 7)
        self.shown = [b""] * len(proto.pieces)
        for p, i, _ in self.pieces:
            self.shown[i] = p.replace(BLANK, " ").encode()
        for b, i in self.bytes.items():
            self.shown[i] = bytes([b])
        self.shown[self.unknown] = " ⁇ ".encode()

    def escaped(self, text: str) -> str:
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK) if text else ""

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Words of escaped texts, cut before blanks and where no piece can span, and
        how many each text has."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        raw = np.frombuffer(joined.encode(), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        kinds, blank = self.kind[codes], codes == ord(BLANK)
        begins = np.ones(len(codes) + 1, bool)
        a, b = kinds[:-1], kinds[1:]
        begins[1:-1] = (self.pairs[a, b >> 3] >> (b & 7).astype(np.uint8) & 1 == 0) | (blank[1:] & ~blank[:-1])
        begins[ends] = True
        at = np.flatnonzero(begins)
        places = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[at]
        words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw))
        return words, np.diff(np.searchsorted(at, ends))

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        ids = [self.bytes.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in ids else ids

    def decode(self, ids) -> str:
        raw = b"".join(map(self.shown.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


KEY = ["bucket", "name"]


def lattice(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(bucket, name, word, holders) -> (bucket, name, at, len, id, score, char, holders): the
    edges, places counted from 1; id -1: the character ``char`` is no piece.  The holders
    go with the first character only.
    A word is carried by its name; its characters are an array, so a place is found at once."""
    spark = words.sparkSession
    pieces = spark.createDataFrame(vocab.pieces, "piece string, id int, score float")
    chars = words.select(*KEY, "holders", F.split("word", "").alias("chars"))
    starts = chars.select(*KEY, "holders", "chars", F.explode(F.sequence(F.lit(1), F.size("chars"))).alias("at"))
    tails = starts.select(*KEY, "at", F.when(F.col("at") == 1, F.col("holders")).alias("holders"),
                          F.expr(f"array_join(slice(chars, at, {vocab.longest}), '')").alias("tail"))
    parts = tails.select(*KEY, "at", "holders", "tail", F.explode(F.sequence(F.lit(1), F.char_length("tail"))).alias("len"))
    parts = parts.select(*KEY, "at", "len", F.when(F.col("len") == 1, F.col("holders")).alias("holders"), F.expr("substring(tail, 1, len)").alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where("id is not null or len = 1")  # vocabulary-sized
    return edges.select(*KEY, "at", "len", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(vocab.least - 10).cast("float")).alias("score"),
                        F.when(F.col("id").isNull(), F.col("piece")).alias("char"), "holders")


def viterbi(edges: DataFrame) -> DataFrame:
    """Best paths of a unigram model: (holders, missing, path), an id and a length each step;
    id -1: a character that is no piece, in ``missing`` by its place."""
    ends = edges.groupBy(*KEY, (F.col("at") + F.col("len") - 1).alias("end")).agg(
        F.collect_list(F.struct("len", "id", "score")).alias("into"), F.first("holders", True).alias("holders"), no_pieces())
    ends = ends.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("end", "into"))).alias("ends"), F.first("holders", True).alias("holders"),
                                  F.flatten(F.collect_list("missing")).alias("missing"))
    return ends.selectExpr("holders", "missing", """
        aggregate(ends, array(named_struct('best', cast(0 as float), 'len', 0, 'id', 0)), (path, e) -> array_append(path,
          aggregate(e.into, named_struct('best', cast('-infinity' as float), 'len', 0, 'id', 0),
            (m, x) -> if(path[e.end - x.len].best + x.score > m.best,
                         named_struct('best', cast(path[e.end - x.len].best + x.score as float), 'len', x.len, 'id', x.id), m)))) as path
        """).selectExpr("holders", "missing", """
        aggregate(path, named_struct('at', size(path) - 1, 'out', cast(array() as array<struct<id: int, len: int>>)),
          (s, x) -> if(s.at <= 0, s, named_struct('at', s.at - path[s.at].len,
                       'out', array_prepend(s.out, named_struct('id', path[s.at].id, 'len', path[s.at].len))))).out as path""")


def no_pieces() -> Column:
    return F.collect_list(F.when(F.col("id") < 0, F.struct("at", "char"))).alias("missing")


def merged(n: int, edges: dict) -> list[tuple[int, int]]:
    """(place, length) of the symbols left of n characters when the merges of a BPE model are
    done: the best score first, then the leftmost.  ``edges``: (place, length) -> score."""
    size, left, right = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (s := edges.get((i, size[i] + size[j]))) is not None:
            heapq.heappush(heap, (-s, i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if size[i] == a else n
        if j >= n or size[j] != b or not a:
            continue
        size[i], size[j], right[i] = a + b, 0, right[j]
        if right[i] < n:
            left[right[i]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [(i, size[i]) for i in range(n) if size[i]]


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(bucket, name, word, holders), each word once -> ``inside``, ``packed``: numbers and ids of
    words of a block."""
    vocab = vocabulary(path)
    edges = lattice(words, vocab)
    if vocab.unigram:
        folded = viterbi(edges)
    else:
        place = F.shiftleft(F.col("at").cast("long"), 32) + F.col("id") + 1  # length and score are the piece's
        folded = edges.withColumn("edge", place).groupBy(*KEY).agg(F.first("holders", True).alias("holders"), no_pieces(), F.collect_list("edge").alias("edges"))
        folded = folded.select("holders", "missing", "edges")

    def build():
        v = vocabulary(path)

        def path_ids(steps, missing) -> list[int]:
            at, ids = 1, []
            for s in steps:
                ids += [s["id"]] if s["id"] >= 0 else v.spelled(missing[at])
                at += s["len"]
            return ids

        def merged_ids(at, size, ids, missing) -> list[int]:
            number = dict(zip(zip(at, size), ids))
            out: list[int] = []
            for p in merged(max(at) + 1, {k: v.score[i] for k, i in number.items() if i >= 0}):
                i = number[p]
                out += [i] if i >= 0 else v.spelled(missing[p[0] + 1])
            return out

        def step(b):
            if not b.num_rows:
                return
            lost = [{m["at"]: m["char"] for m in x} for x in b.column(1).to_pylist()]
            if v.unigram:
                rows = [path_ids(s, m) for s, m in zip(b.column(2).to_pylist(), lost)]
            else:
                edges, bounds = b.column(2).values.to_numpy(), b.column(2).offsets.to_pylist()
                ids = (edges & 0xFFFFFFFF) - 1
                size = np.where(ids < 0, 1, v.length[ids]).tolist()
                at, ids = ((edges >> 32) - 1).tolist(), ids.tolist()
                rows = [merged_ids(at[i:j], size[i:j], ids[i:j], m) for i, j, m in zip(bounds, bounds[1:], lost)]
            count = np.fromiter(map(len, rows), np.int64, len(rows))
            flat, till = np.fromiter((i for r in rows for i in r), np.int64, count.sum()), np.cumsum(count)
            holders = b.column(0)
            word = np.repeat(np.arange(len(rows)), np.diff(holders.offsets.to_numpy()))
            held = holders.flatten()
            inside, no = held.field("inside").to_numpy(), held.field("no").to_numpy()
            order = np.lexsort((no, inside))
            starts = np.flatnonzero(np.append(True, np.diff(inside[order]) != 0))
            packed = []
            for own in np.split(order, starts[1:]):
                w = word[own]
                packed.append(_packed(no[own], count[w], flat[_spans(till[w] - count[w], count[w])]))
            yield pa.RecordBatch.from_arrays([pa.array(inside[order[starts]], pa.int64()), pa.array(packed, pa.binary())], names=["inside", "packed"])
        return step

    return map_arrow(folded, build, "inside long, packed binary")


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all spans, one after the other."""
    till = np.cumsum(size)
    return np.arange(till[-1] if len(till) else 0) + np.repeat(first - (till - size), size)


def _planes(numbers) -> bytes:
    """Numbers with their lowest bytes first, then the next ones: high bytes compress to nothing."""
    return np.ascontiguousarray(np.asarray(numbers, "<u4").reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _packed(no, size, ids) -> bytes:
    """Words of a block: their numbers, how many ids each has, and the ids."""
    raw = len(no).to_bytes(4, "little") + _planes(np.diff(no, prepend=0)) + _planes(size) + _planes(ids)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(packed))
    n = 4 * int.from_bytes(raw[:4], "little")
    return np.cumsum(_numbers(raw[4:4 + n])), _numbers(raw[4 + n:4 + 2 * n]), _numbers(raw[4 + 2 * n:])


def _block(v: Vocabulary, ids: list, texts: list, buckets: int) -> bytes:
    """A block of texts, compressed: the ids of its rows, how many words each one has and which,
    the texts that escaping does not keep, and its distinct words by bucket."""
    words, counts, run, size = [], [], [], 0
    for t in [*map(v.escaped, (t or "" for t in texts)), None]:
        if t is None or run and size + len(t) > CUT_CHARS:
            found, n = v.cut(run)
            words.append(found)
            counts.append(n)
            run, size = [], 0
        if t is not None:
            run.append(t)
            size += len(t)
    coded = pa.concat_arrays(words).dictionary_encode()
    own = coded.dictionary
    bucket = np.fromiter(map(zlib.crc32, own.cast(pa.large_binary()).to_pylist()), np.int64, len(own)) % buckets
    order = pc.sort_indices(pa.table({"bucket": bucket, "word": own}), [("bucket", "ascending"), ("word", "ascending")]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = own.take(pa.array(order))
    lossy = {i: t for i, t in enumerate(texts) if t and BLANK in t}
    parts = (ids, _planes(np.concatenate(counts)), _planes(rank[coded.indices.to_numpy()]), lossy, *_string_parts(own), _planes(np.bincount(bucket, minlength=buckets)))
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(parts))


def _string_parts(words: pa.LargeStringArray) -> tuple[bytes, bytes]:
    raw = "".join(words.to_pylist()).encode()
    return raw, _planes(pc.binary_length(words).to_numpy())


def _opened(packed: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def _blocks(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """(id, text) -> blocks, named by their content: a task that cuts other blocks when it runs
    again is found out."""
    def build():
        v = vocabulary(path)

        def step(b):
            for first, texts in slices(b, 1, BLOCK_CHARS):
                packed = _block(v, b.column(0).slice(first, len(texts)).to_pylist(), texts, buckets)
                name = int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([packed], pa.binary())], names=["block", "packed"])
        return step

    return map_arrow(df, build, "block long, packed binary")


def _words(blocks: DataFrame) -> DataFrame:
    """(block, packed) -> a row for each block and bucket: its distinct words, and the number of the first."""
    def build():
        def step(b):
            for block, packed in zip(b.column(0).to_pylist(), b.column(1)):
                *_, raw, sizes, counts = _opened(packed.as_py())
                till, bounds = np.cumsum(_numbers(sizes)), np.concatenate([[0], np.cumsum(_numbers(counts))])
                words = pa.StringArray.from_buffers(len(till), pa.py_buffer(np.concatenate([[0], till]).astype(np.int32)), pa.py_buffer(raw))
                full = np.flatnonzero(np.diff(bounds))
                lists = pa.ListArray.from_arrays(pa.array(np.append(bounds[full], bounds[-1]), pa.int32()), words)
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), block), pa.int64()), pa.array(bounds[full], pa.int32()), lists],
                                                 names=["bucket", "inside", "first", "words"])
        return step

    return map_arrow(blocks, build, "bucket int, inside long, first int, words array<string>")


def encode(df: DataFrame, id_col: str, text_col: str, model: str = MODEL) -> DataFrame:
    """``id``, ``ids``, ``n_pieces`` and ``round_trip`` for each row."""
    path = public_tokenizers.path(model) if "/" not in model else model
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["id"]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt once; the words and the texts are both read from this exchange.
    blocks = _blocks(src, path, tasks).repartition(tasks, "block")
    # A word grows into dozens of substrings: its place is dealt by number, not by bytes.
    dealt = _words(blocks).repartitionById(tasks, F.col("bucket"))
    listed = dealt.select("bucket", "inside", "first", F.posexplode("words").alias("pos", "word"))
    long = F.char_length("word") > KEY_CHARS
    name = F.when(long, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word")).alias("name")
    listed = listed.select("bucket", name, F.when(long, F.col("word")).alias("whole"), F.struct("inside", (F.col("first") + F.col("pos")).alias("no")).alias("holder"))
    # Distinct words stay where they were dealt: substrings, edges and folds never move.
    words = listed.groupBy(*KEY).agg(F.first("whole", True).alias("whole"), F.collect_list("holder").alias("holders"))
    known = encoded_words(words.select(*KEY, F.coalesce("whole", "name").alias("word"), "holders"), path)
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        release()  # what the block before took
        v = vocabulary(path)
        blocks = left.column("packed").to_pylist()  # more than one: the same rows again
        if len(set(blocks)) != 1:
            raise RuntimeError("words without their block, or two blocks of one name")
        rows, counts, numbers, lossy, raw, lengths, _ = _opened(blocks[0])
        counts, numbers, lengths = _numbers(counts), _numbers(numbers), _numbers(lengths)
        parts = [_unpacked(x.as_py()) for x in right.column("packed")]
        size, first = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
        flat = np.concatenate([p[2] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
        at = 0
        for no, n, own in parts:
            size[no], first[no] = n, at + np.cumsum(n) - n
            at += len(own)
        if (size < 0).any():
            raise RuntimeError("a block without some of its words")
        # Words whose ids decode to them.
        shown = [b"".join(map(v.shown.__getitem__, flat[a:a + n].tolist())) for a, n in zip(first.tolist(), size.tolist())]
        bounds = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        same = np.fromiter((raw[a:b].replace(BLANK.encode(), b" ") == x for a, b, x in zip(bounds, bounds[1:], shown)), bool, len(shown))
        till = np.concatenate([[0], np.cumsum(counts)])
        wrong = np.concatenate([[0], np.cumsum(~same[numbers])])
        trip = wrong[till[1:]] == wrong[till[:-1]]
        ids = flat[_spans(first[numbers], size[numbers])]
        offsets = np.concatenate([[0], np.cumsum(size[numbers])])[till]
        for i in {*np.flatnonzero(~trip).tolist(), *lossy}:  # the whole text decides
            text = b"".join(raw[bounds[w]:bounds[w + 1]] for w in numbers[till[i]:till[i + 1]].tolist()).decode()
            text = lossy.get(i, text[v.prefix:].replace(BLANK, " "))
            trip[i] = v.decode(ids[offsets[i]:offsets[i + 1]].tolist()) == text
        out = pa.table({"id": pa.array(rows, arrow_id), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                        "n_pieces": pa.array(np.diff(offsets), pa.int64()), "round_trip": pa.array(trip, pa.bool_())})
        return pa.concat_tables([out] * len(blocks))

    out = blocks.groupBy("block").cogroup(known.groupBy("inside")).applyInArrow(
        put_together, f"id {kind}, ids array<int>, n_pieces long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, ids_col: str, out_col: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the text of its ids; null ids give null."""
    path = public_tokenizers.path(model) if "/" not in model else model

    @F.pandas_udf("string")
    def text(ids):
        v = vocabulary(path)
        return ids.map(lambda x: None if x is None else v.decode(x.tolist()))

    return df.withColumn(out_col, text(F.col(ids_col)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to it."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")

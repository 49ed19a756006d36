"""Operator 6: removal of repeated byte strings with a hash-compared suffix sort.

A byte goes if it lies in a ``SPAN``-byte string that also starts anywhere else.

*Anchors.*  Sorting every suffix of the corpus is not needed: a string that occurs
twice brings its own landmarks.  Among the grams of a quarter of that length that start inside a
``SPAN``-byte window the ones of least hash are anchors, chosen by content alone, so
both copies of a string have the same anchors at the same place.  Only anchors whose
gram occurs twice go on, each with its context: the bytes before it and the bytes
from it on, as far as a window holding it can reach.

*Suffix sort.*  All contexts with the same gram meet.  The bytes from the anchor on
are sorted as suffixes, the bytes before it as reversed prefixes, both by a
vectorised mergesort.  Two of them are compared through prefix polynomial hashes:
binary search over hashed blocks finds their common extension in logarithmic time,
one block of bytes settles the order.  Neighbours are then verified byte by byte; a
collision (verified extension unlike the hashed one) has the rows sorted again by
their bytes.  With both orders and their common extensions, the window reaching
``l`` bytes back is repeated exactly if another anchor shares at least ``l`` bytes
before and ``SPAN - l`` from there on; equal class numbers in both orders tell.

*Hot groups.*  Equal contexts travel once per batch with their count, and only the
narrow member rows join back.  Anchors with equal contexts inside one text (runs of
one word) are settled where they are found.  A gram with more than ``GROUP``
different contexts is not sorted in one task: its windows are hashed (128 bits) and
counted by a distributed aggregate instead.  Texts that occur twice as a whole need
no sort at all.  Matches never cross texts, and strings are judged on the input.

Null texts are empty; texts below ``SPAN`` bytes keep all; repeated rows are copies
of each other and go wholly from ``SPAN`` bytes on; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, map_arrow, screened, slices, staged, table, text_key

SPAN = 400
#: Different contexts of one gram sorted in one task.
GROUP = 1 << 16
#: Anchors whose contexts a task holds at once.
CONTEXTS = 20_000
#: Rows sorted at once.
ROWS = 1 << 13
#: Characters hashed at once, and bytes hashed as one block in comparisons.
HASHED, BLOCK = 1 << 18, 16



def gram_of(span: int) -> int:
    """Bytes of an anchor's gram; a window holds its anchor's gram whole."""
    return span // 4


def back_of(span: int) -> int:
    """Bytes a window can reach back from its anchor."""
    return span - gram_of(span)


_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}
REMEMBERED.append(_powers.clear)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = 1 << max(18, int(n - 1).bit_length())
        for name, base in (("up", _B), ("down", _BI)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of the gram starting at each place, mixed."""
    up, down = _power(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    h = (prefix[gram:] - prefix[:-gram]) * down[:len(data) - gram + 1]
    h *= _MIX
    h ^= h >> np.uint64(31)
    h *= np.uint64(_B)
    return h ^ (h >> np.uint64(29))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of ``w``."""
    top = np.iinfo(np.uint64).max
    padded = np.concatenate([x, np.full(-len(x) % w, top, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def anchors(raws: list[bytes], span: int = SPAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, gram hashes) of each text's anchors."""
    size = np.array([len(r) for r in raws], np.int64)
    start = np.cumsum(size) - size
    gram = gram_of(span)
    w = span - gram + 1
    data = np.frombuffer(b"".join(raws), np.uint8)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(data) < span:
        return [none] * len(raws)
    h = _gram_hashes(data, gram)
    least = _window_min(h, w)
    # Windows that reach over the end of a text are none.
    inside = np.arange(len(least)) + span <= np.repeat(start + size, size)[:len(least)]
    picked = np.zeros(len(h), bool)
    # A place is an anchor if some window holding it has its hash as the least.
    least = np.where(inside, least, np.uint64(0))
    reach = ~_window_min(~np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w)  # the largest least
    picked = (h == reach[:len(h)]) & (reach[:len(h)] > 0)
    at = np.flatnonzero(picked)
    which = np.searchsorted(start, at, side="right") - 1
    cut = np.searchsorted(which, np.arange(len(raws) + 1))
    return [(at[a:b] - s, h[at[a:b]]) if b > a else none for a, b, s in zip(cut, cut[1:], start.tolist())]


def context(raw: bytes, at: int, span: int = SPAN) -> tuple[bytes, bytes]:
    """Bytes before (nearest first) and from the anchor on."""
    return raw[max(0, at - back_of(span)):at][::-1], raw[at:at + span]


def _settled(raw: bytes, at: np.ndarray, h: np.ndarray, span: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Anchors to send (one of equal contexts), and spans that equal contexts
    inside the text settle."""
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    if (counts == 1).all():
        return np.ones(len(at), bool), []
    send, spans, seen = np.ones(len(at), bool), [], {}
    for i in np.flatnonzero(counts[inverse] > 1).tolist():
        key = context(raw, int(at[i]), span)
        if key in seen:
            send[i] = False
            if len(key[0]) + len(key[1]) >= span:
                spans += [(int(p) - len(key[0]), int(p) + len(key[1])) for p in (at[i], at[seen[key]])]
        else:
            seen[key] = i
    return send, merged(spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _found(df: DataFrame, span: int) -> DataFrame:
    """(_t1, _t2, text) -> anchors (_t1, _t2, at, h) and, with ``till``, settled spans."""
    def build():
        def step(b):
            for first, texts in slices(b, 2, HASHED):
                raws = [t.encode("utf-8", "surrogatepass") for t in texts]
                rows, places, hashes, till = [], [], [], []
                for i, (raw, (at, h)) in enumerate(zip(raws, anchors(raws, span))):
                    if len(at):
                        send, spans = _settled(raw, at, h, span)
                        at, h = at[send], h[send]
                        rows += [first + i] * (len(at) + len(spans))
                        places += at.tolist() + [a for a, _ in spans]
                        hashes += h.view(np.int64).tolist() + [0] * len(spans)
                        till += [-1] * len(at) + [e for _, e in spans]
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(places, pa.int32()),
                                                  pa.array(hashes, pa.int64()), pa.array(till, pa.int32())],
                                                 names=["_t1", "_t2", "at", "h", "till"])
        return step

    return map_arrow(df, build, "_t1 long, _t2 long, at int, h long, till int")


def _contexts(df: DataFrame, span: int) -> DataFrame:
    """(_t1, _t2, text, marks) -> a row for each anchor with the 128-bit name of its
    context; the first of a batch also has the context and how many share it."""
    schema = "_t1 long, _t2 long, at int, h long, f1 long, f2 long, n int, before binary, after binary"

    def build():
        def packed(rows):
            a, c, at, h, names, n, back, ahead = zip(*rows)
            pair = np.frombuffer(b"".join(names), ">i8").reshape(-1, 2).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(at, pa.int32()), pa.array(h, pa.int64()),
                 pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(n, pa.int32()), pa.array(back, pa.binary()), pa.array(ahead, pa.binary())],
                names=["_t1", "_t2", "at", "h", "f1", "f2", "n", "before", "after"])

        def step(b):
            t1, t2, text, marks = (b.column(i) for i in range(4))
            rows, first = [], {}
            for i in range(b.num_rows):
                raw, key = text[i].as_py().encode("utf-8", "surrogatepass"), (t1[i].as_py(), t2[i].as_py())
                for m in marks[i].as_py():
                    back, ahead = context(raw, m["at"], span)
                    name = xxhash.xxh3_128_digest(len(back).to_bytes(2, "big") + m["h"].to_bytes(8, "big", signed=True) + back + ahead)
                    if name in first:
                        rows[first[name]][5] += 1
                        rows.append([*key, m["at"], m["h"], name, 0, None, None])
                    else:
                        first[name] = len(rows)
                        rows.append([*key, m["at"], m["h"], name, 1, back, ahead])
                if len(rows) > CONTEXTS:
                    yield packed(rows)
                    rows, first = [], {}
            if rows:
                yield packed(rows)
        return step

    return map_arrow(df, build, schema)


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8)
    return flat.reshape(len(parts), width), size


class Suffixes:
    """Rows of bytes, compared by common extension."""

    def __init__(self, parts: list[bytes], width: int):
        width = -(-width // BLOCK) * BLOCK
        self.bytes, self.size = _matrix(parts, width)
        blocks = width // BLOCK
        power = np.array([pow(_B, i, 1 << 64) for i in range(BLOCK)], np.uint64)
        own = ((self.bytes.reshape(len(parts), blocks, BLOCK).astype(np.uint64) + np.uint64(1)) * power).sum(axis=2, dtype=np.uint64)
        self.prefix = np.zeros((len(parts), blocks + 1), np.uint64)  # hash of the first blocks
        for i in range(blocks):
            self.prefix[:, i + 1] = self.prefix[:, i] * np.uint64(pow(_B, BLOCK, 1 << 64)) + own[:, i]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that rows ``i`` and ``j`` have in common from their start."""
        blocks = self.prefix.shape[1] - 1
        low, high = np.zeros(len(i), np.int64), np.full(len(i), blocks, np.int64)
        while True:  # largest number of leading blocks with equal hash
            open_ = low < high
            if not open_.any():
                break
            mid = (low + high + 1) // 2
            same = self.prefix[i, mid] == self.prefix[j, mid]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        at = np.minimum(low, blocks - 1)
        place = at[:, None] * BLOCK + np.arange(BLOCK)
        differ = self.bytes[i[:, None], place] != self.bytes[j[:, None], place]
        inside = np.where(differ.any(axis=1), differ.argmax(axis=1), BLOCK)
        return np.minimum(np.minimum(low * BLOCK + np.where(low < blocks, inside, 0), self.size[i]), self.size[j])

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        e = self.extension(i, j)
        end = (e >= self.size[i]) | (e >= self.size[j])
        at = np.minimum(e, self.bytes.shape[1] - 1)
        return np.where(end, self.size[i] < self.size[j], self.bytes[i, at] < self.bytes[j, at])

    def order(self, group: np.ndarray) -> np.ndarray:
        """Rows sorted within runs of equal ``group``: bottom-up mergesort, each
        element placed by binary search in the sibling run."""
        n = len(group)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, n))
        start, length = np.repeat(first, size), np.repeat(size, size)
        order, place, width = np.arange(n), np.arange(n) - start, 1
        while width < size.max(initial=1):
            run = place // width
            low = (run ^ 1) * width                       # the sibling run, within the group
            high = np.minimum(low + width, length)
            active = low < length
            low, floor = np.where(active, low, 0), np.where(active, low, 0)
            high = np.where(active, high, 0)
            while True:
                open_ = low < high
                if not open_.any():
                    break
                at = np.flatnonzero(open_)
                mid = (low[at] + high[at]) // 2
                me, you = order[at], order[start[at] + mid]
                # Equal rows of the left run come first.
                before = np.where(run[at] & 1, ~self.less(me, you), self.less(you, me))
                low[at], high[at] = np.where(before, mid + 1, low[at]), np.where(before, high[at], mid)
            target = start + np.where(active, (run & ~1) * width + place % width + (low - floor), place)
            new = np.empty(n, np.int64)
            new[target] = order
            order, width = new, width * 2
        return order

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, bytes each row shares with the one before; -1 for another group)."""
        order = self.order(group)
        a, b = order[:-1], order[1:]
        claimed = self.extension(a, b) if len(a) else np.zeros(0, np.int64)
        true = np.empty(len(a), np.int64)
        for at in range(0, len(a), ROWS):
            x, y = a[at:at + ROWS], b[at:at + ROWS]
            differ = self.bytes[x] != self.bytes[y]
            shared = np.where(differ.any(axis=1), differ.argmax(axis=1), self.bytes.shape[1])
            true[at:at + ROWS] = np.minimum(np.minimum(shared, self.size[x]), self.size[y])
        if (claimed != true).any():  # hashes collided: the order is not to be trusted
            keys = [self.bytes[i, :self.size[i]].tobytes() for i in range(len(group))]
            order = np.array(sorted(range(len(group)), key=lambda i: (group[i], keys[i])), np.int64)
            a, b = order[:-1], order[1:]
            true = np.array([next((k for k, (p, q) in enumerate(zip(keys[i], keys[j])) if p != q), min(len(keys[i]), len(keys[j])))
                             for i, j in zip(a, b)], np.int64)
        true[group[a] != group[b]] = -1
        return order, np.concatenate([[-1], true])


def reaches(group: np.ndarray, before: list[bytes], after: list[bytes], n: np.ndarray,
            span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For each context (rows sorted by ``group``, contexts of a group different):
    how many bytes before and from the anchor on lie in repeated strings; -1: none."""
    back = back_of(span)
    left, right = Suffixes(before, back), Suffixes(after, span)
    lo, hi = np.full(len(group), -1, np.int64), np.full(len(group), -1, np.int64)
    full = (n > 1) & (left.size + right.size >= span)
    lo[full], hi[full] = left.size[full], right.size[full]
    size = np.unique(group, return_inverse=True, return_counts=True)
    shared = size[2][size[1]] > 1
    if not shared.any():
        return lo, hi
    lorder, lcommon = left.sorted(group)
    rorder, rcommon = right.sorted(group)
    lclass, rclass = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for l in range(min(back, int(left.size.max())) + 1):
        able = shared & (left.size >= l) & (right.size >= span - l)
        if not able.any():
            continue
        lclass[lorder] = np.cumsum(lcommon < l)
        rclass[rorder] = np.cumsum(rcommon < span - l)
        rows = np.flatnonzero(able)
        key = lclass[rows] * (len(group) + 1) + rclass[rows]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        twice = rows[by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        lo[twice] = np.maximum(lo[twice], l)
        hi[twice] = np.maximum(hi[twice], span - l)
    return lo, hi


def _solved(df: DataFrame, span: int) -> DataFrame:
    """Contexts sorted by (h, f1, f2) in each task -> (f1, f2, lo, hi)."""
    def run(it):
        held: list[tuple] = []  # h, f1, f2, n, before, after

        def solve(rows):
            if not rows:
                return
            h = np.array([r[0] for r in rows], np.int64)
            lo, hi = reaches(h, [r[4] for r in rows], [r[5] for r in rows], np.array([r[3] for r in rows], np.int64), span)
            ok = np.flatnonzero(lo >= 0)
            if len(ok):
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in ok], pa.int64()), pa.array([rows[i][2] for i in ok], pa.int64()),
                                                  pa.array(lo[ok], pa.int32()), pa.array(hi[ok], pa.int32())], names=["f1", "f2", "lo", "hi"])

        for b in it:
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                if held and held[-1][:3] == r[:3]:
                    held[-1] = (*r[:3], held[-1][3] + r[3], *r[4:])
                    continue
                if len(held) >= ROWS and held[-1][0] != r[0]:
                    yield from solve(held)
                    held = []
                held.append(r)
        yield from solve(held)

    return df.mapInArrow(run, "f1 long, f2 long, lo int, hi int")


def _windows(df: DataFrame, span: int) -> DataFrame:
    """Every window of contexts too many for one sort: (f1, f2, n, l, w1, w2)."""
    def build():
        def step(b):
            out: list[tuple] = []
            for h, f1, f2, n, before, after in zip(*(b.column(i).to_pylist() for i in range(6))):
                raw, place = before[::-1] + after, len(before)
                for l in range(max(0, span - len(after)), place + 1):
                    w = xxhash.xxh3_128_digest(raw[place - l:place - l + span], seed=l)
                    out.append((h, f1, f2, n, l, int.from_bytes(w[:8], "big", signed=True), int.from_bytes(w[8:], "big", signed=True)))
                if len(out) > 50_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

        def pack(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                              names=["h", "f1", "f2", "n", "l", "w1", "w2"])
        return step

    return map_arrow(df, build, "h long, f1 long, f2 long, n int, l int, w1 long, w2 long")


def _counted(contexts: DataFrame, span: int) -> DataFrame:
    """What :func:`_solved` gives, by counting windows."""
    names = ["h", "f1", "f2"]
    one = contexts.groupBy(*names).agg(F.sum("n").cast("int").alias("n"), F.first("before").alias("before"), F.first("after").alias("after"))
    w = _windows(one, span)
    twice = w.groupBy("h", "l", "w1", "w2").agg(F.sum("n").alias("c")).where("c > 1").drop("c")
    return (w.join(twice, ["h", "l", "w1", "w2"], "left_semi").groupBy("f1", "f2")
             .agg(F.max("l").alias("lo"), (span - F.min("l")).alias("hi")))


def repeated_spans(df: DataFrame, text_col: str, group: int = GROUP, span: int = SPAN) -> DataFrame:
    """(_t1, _t2, spans): byte spans to remove from each different text."""
    docs = df.select(*text_key(text_col), F.col(text_col).alias("text")).where(F.octet_length("text") >= span)
    t = ["_t1", "_t2"]
    found = staged(_found(docs, span), "anchors")
    at = found.where("till < 0")
    # A gram counts as repeated if two different (text, place) have it; copies of a text don't.
    own = F.xxhash64("_t1", "_t2", "at")
    # (Written, so that both sides of the join are dealt for it and a gram that many rows have can be split.)
    grams = staged(at.groupBy("h").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x != y").select("h"), "grams")
    marks = staged(at.join(grams, "h", "left_semi").select(*t, "at", "h").distinct(), "marks")
    texts = screened(docs, "_t1", marks, "_t1", "_maybe").where("_maybe").select(*t, "text").groupBy(*t).agg(F.first("text").alias("text"))
    listed = marks.groupBy(*t).agg(F.collect_list(F.struct("at", "h")).alias("marks"))  # of one text
    members = staged(_contexts(texts.join(listed, t), span), "contexts")
    contexts = members.where("n > 0").select("h", "f1", "f2", "n", "before", "after")
    sizes = contexts.groupBy("h").count().where(F.col("count") > group).select("h")
    solved = lambda c: _solved(c.repartition("h").sortWithinPartitions("h", "f1", "f2"), span)
    if sizes.limit(1).count():
        sizes = staged(sizes, "large-groups")
        done = solved(contexts.join(sizes, "h", "left_anti")).unionByName(_counted(contexts.join(sizes, "h", "left_semi"), span))
    else:
        done = solved(contexts)
    spans = (members.select(*t, "at", "f1", "f2").join(done, ["f1", "f2"])
                    .select(*t, (F.col("at") - F.col("lo")).alias("a"), (F.col("at") + F.col("hi")).alias("b")))
    settled = found.where("till >= 0").select(*t, F.col("at").alias("a"), F.col("till").alias("b")).distinct()
    copies = docs.groupBy(*t).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("b")).where("n > 1")
    spans = spans.unionByName(settled).unionByName(copies.select(*t, F.lit(0).alias("a"), "b"))
    return spans.groupBy(*t).agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def rest_of(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def _cut(df: DataFrame, kind: str) -> DataFrame:
    """(id, text, spans) -> the contract's columns."""
    def build():
        def step(b):
            rows = []
            for text, spans in zip(b.column(1), b.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                cut = merged([(s["a"], s["b"]) for s in spans.as_py() or ()])
                rest = rest_of(raw, cut)
                rows.append((len(raw), len(raw) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            a, c, d, e, f = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()),
                                              pa.array(e, pa.string()), pa.array(f, pa.string())],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
        return step

    return map_arrow(df, build, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def removed(df: DataFrame, id_col: str, text_col: str, group: int = GROUP, span: int = SPAN, with_text: bool = False) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` for each row, and if
    asked the ``text`` that is left (characters cut in two go whole; null is empty)."""
    spans = staged(repeated_spans(df, text_col, group, span), "spans")
    docs = df.select(F.col(id_col).alias("id"), *text_key(text_col), F.col(text_col).alias("text"))
    docs = screened(docs, "_t1", spans, "_t1", "_maybe")
    some = docs.where("_maybe").select("id", "_t1", "_t2", "text").join(spans, ["_t1", "_t2"], "left").select("id", "text", "spans")
    whole = F.coalesce("text", F.lit(""))
    none = docs.where("not _maybe").select("id", F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                           F.lit(0).cast("long").alias("n_spans"), F.sha2(whole.cast("binary"), 256).alias("kept_sha256"), whole.alias("text"))
    out = _cut(some, dict(df.dtypes)[id_col]).unionByName(none).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("text")


def without_repeats(df: DataFrame, text_col: str, group: int = GROUP, span: int = SPAN) -> DataFrame:
    """``df`` with the repeated strings cut out of its texts (characters cut in two
    go whole); rows of which nothing is left go, null texts and others stay."""
    from pyspark.sql.functions import pandas_udf
    spare = ["_suffix1_", "_suffix2_", "_suffix_spans_"]
    while any(c in {x.lower() for x in df.columns} for c in spare):
        spare = [f"_{c}" for c in spare]
    spans = staged(repeated_spans(df, text_col, group, span), "spans").select(*[F.col(c).alias(s) for c, s in zip(("_t1", "_t2", "spans"), spare)])

    @pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or s is None else rest_of(
            t.encode("utf-8", "surrogatepass"), merged([(x["a"], x["b"]) for x in s])).decode("utf-8", "ignore"))

    text = F.col(f"`{text_col}`")
    keyed = df.select("*", *[k.alias(f"{s}k") for k, s in zip(text_key(text), spare)])
    keyed = screened(keyed, f"{spare[0]}k", spans, spare[0], f"{spare[0]}m")
    own = [F.col(f"`{c}`") for c in df.columns]
    none = keyed.where(f"not {spare[0]}m").select(*own)
    same = (F.col(f"{spare[0]}k") == F.col(spare[0])) & (F.col(f"{spare[1]}k") == F.col(spare[1]))
    hit = keyed.where(f"{spare[0]}m").join(spans, same, "left")
    out = hit.withColumn(text_col, F.when(F.col(spare[2]).isNotNull(), cut(text, F.col(spare[2]))).otherwise(text))
    return none.unionAll(out.where(F.col(spare[2]).isNull() | (F.length(text) > 0)).select(*own))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings removed from every document."""
    return removed(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=True)

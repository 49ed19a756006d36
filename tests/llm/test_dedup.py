import collections
import hashlib
import random

import numpy as np
import pytest

from loanscope.llm import neardup, suffix
from llm_edges import PROSE, TEXTS, empty, frame


def planted(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    docs = [prose(rng.randrange(3, 260)) for _ in range(60)]
    shared = prose(90)
    for i in range(0, 24, 2):  # a passage many share
        docs[i][10:10] = shared
    for i in range(20, 45):  # near copies, chains of them, some moved apart
        base = list(docs[rng.randrange(20)])
        for _ in range(rng.randrange(1, 9)):
            base[rng.randrange(len(base))] = rng.choice(words)
        docs.append(base)
        docs.append(base[:-2])
    base = prose(120)
    for i in range(45):  # one large group: light and heavy edits of one text, some shortened
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(words) if i % 3 else f"only{i}"
        docs.append(copy[rng.randrange(0, 12):] if i % 5 == 0 else copy)
    return [" ".join(d) for d in docs]


def linked(texts, least=neardup.SIMILARITY):
    """Classes by comparing all pairs with a plain alignment."""
    seqs = [neardup.shingles(t).tolist() for t in texts]
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            x, y = seqs[i], seqs[j]
            same = texts[i] == texts[j]
            if not same and x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and len(set(x) & set(y)) * 2 > min(len(set(x)), len(set(y))):
                row = [0] * (len(y) + 1)
                for a in x:
                    new = [0]
                    for k, b in enumerate(y):
                        new.append(row[k] + 1 if a == b else max(row[k + 1], new[-1]))
                    row = new
                same = row[-1] / (len(x) + len(y) - row[-1]) >= least
            if same:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("block", [128, 2])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.class_id for r in neardup.classes(df, "doc_id", "text").collect()}
    assert got == linked(texts)


def test_similarity_is_exact_from_the_threshold_on():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
        y = list(x)
        for _ in range(rng.randrange(0, 5)):
            y[rng.randrange(len(y))] = rng.randrange(12)
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for k, b in enumerate(y):
                new.append(row[k] + 1 if a == b else max(row[k + 1], new[-1]))
            row = new
        true = row[-1] / (len(x) + len(y) - row[-1])
        got = neardup.similarity(np.array(x, np.uint64), np.array(y, np.uint64))
        assert got == pytest.approx(true) if true >= 0.8 else true - 1e-12 <= got < 0.8


def test_near_copy_of_a_text_with_a_repeated_line(spark):
    """Only one text of the pair has repeated shingles."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    line = " ".join(words[:9])
    twice = "\n".join([line, " ".join(words[9:]), line])
    edited = "\n".join([line, " ".join(words[9:]), line.replace(words[4], "other")])
    x, y = neardup.shingles(twice), neardup.shingles(edited)
    assert len(set(x.tolist())) < len(x) and len(set(y.tolist())) == len(y) and 0.95 < neardup.similarity(x, y) < 1
    assert len(np.intersect1d(neardup.labelled(x), neardup.labelled(y))) >= neardup._common(x, y)[0]
    df = spark.createDataFrame([(0, twice), (1, edited), (2, PROSE)], "doc_id long, text string")
    assert {r.id: r.class_id for r in neardup.classes(df, "doc_id", "text").collect()} == {0: 0, 1: 0, 2: 2}


def test_near_duplicate_edges(spark):
    rows = neardup.classes(frame(spark), "doc_id", "text").collect()
    got = {(r.id, r.class_id) for r in rows}
    assert {(0, 0), (1, 0), (12, 0), (2, 2), (11, 11), (3, 3), (4, 4), (None, None), (8, 8)} <= got
    assert len(rows) == len(TEXTS) + 1
    left = neardup.deduplicated(frame(spark), "doc_id", "text")
    assert left.columns == frame(spark).columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect())
    near = neardup.similarity(neardup.shingles(PROSE), neardup.shingles(PROSE + " Tail.")) >= 0.8
    assert near and ids == [-1, 0, 2, 3, 4, 6, 7, 8, 10, 11]
    assert neardup.classes(empty(spark), "doc_id", "text").collect() == []
    assert neardup.deduplicated(empty(spark), "doc_id", "text").collect() == []


def brute(texts, span):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i:i + span]] > 1:
                gone[i:i + span] = True
        rest = bytes(np.frombuffer(r, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffix.GROUP, 2])
@pytest.mark.parametrize("span", [400, 40])
def test_removed_bytes_equal_brute_force(spark, group, span):
    texts = planted(2) + ["ab " * 400, "ab " * 399 + "c", "é" * 300, "x" * 401, "y" * 400, "z" * 399, None, "", TEXTS[8], TEXTS[8][50:4000] + "!"]
    texts += [texts[3], texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(suffix.removed(df, "doc_id", "text", group, span).collect())
    assert [tuple(r)[1:] for r in rows] == brute(texts, span)


def test_colliding_hashes_do_not_change_the_order(monkeypatch):
    rng = random.Random(6)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    group = np.sort(np.array([rng.randrange(5) for _ in parts]))

    def check(s):
        order, common = s.sorted(group)
        keys = [(group[i], parts[i]) for i in order]
        assert keys == sorted(keys)
        for a, b, c in zip(order, order[1:], common[1:]):
            n = next((k for k, (p, q) in enumerate(zip(parts[a], parts[b])) if p != q), min(len(parts[a]), len(parts[b])))
            assert c == (n if group[a] == group[b] else -1)

    check(suffix.Suffixes(parts, 40))
    broken = suffix.Suffixes(parts, 40)
    broken.prefix[:] = 0  # every hash collides
    check(broken)


def test_suffix_edges(spark):
    df = frame(spark)
    rows = suffix.removed(df, "doc_id", "text", span=100).collect()
    assert len(rows) == len(TEXTS) + 1
    assert suffix.removed(empty(spark), "doc_id", "text").collect() == []
    left = suffix.without_repeats(df, "text", span=100)
    assert left.columns == df.columns
    texts = sorted((r.text for r in left.collect() if r.text is not None), key=len)
    assert PROSE not in texts and " Tail." in texts and "" in texts  # wholly repeated rows go, empty ones stay
    assert sum(r.text is None for r in left.collect()) == 2

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from conftest import SF001
from llm_edges import empty, frame
from loanscope.llm import periodic


def brute(words, least=6, times=4):
    """Every period, one scan each; a stretch counts if no smaller period fits it."""
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            part = words[s:i + q]
            if len(part) >= max(least, times * q) and all(any(part[j] != part[j + r] for j in range(len(part) - r)) for r in range(1, q)):
                out.add((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def generated(rng):
    few, n, words = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60), []
    while len(words) < n:
        if rng.random() < 0.3:
            unit = [str(rng.randrange(few)) for _ in range(rng.randint(1, 6))]
            words += unit * rng.randint(1, 7) + unit[:rng.randint(0, len(unit))]
        else:
            words.append(str(rng.randrange(few + 5)))
    return words


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(300):
        docs = [generated(rng) for _ in range(rng.randint(1, 4))]
        assert periodic.runs_of_texts(docs, least, times) == [brute(d, least, times) for d in docs]


def test_extensions_equal_a_scan():
    rng = np.random.default_rng(0)
    for size, few in ((1, 1), (40, 1), (90, 2), (700, 3)):
        text = (rng.integers(0, few, size) + 1).tolist()
        tree = periodic.SuffixTree(text)
        assert [i for _, i in sorted((text[i:], i) for i in range(size + 1))] == np.argsort(tree.rank).tolist()
        a, b = rng.integers(0, size + 1, (2, 400))
        a, b = a[a != b], b[a != b]
        want = [next((k for k in range(size) if max(i, j) + k >= size or text[i + k] != text[j + k]), 0) for i, j in zip(a, b)]
        assert tree.extension(a, b).tolist() == want


def test_long_and_degenerate_texts():
    assert periodic.runs_of_texts([["a"] * 50_000])[0] == [(0, 50_000, 1)]
    unit = [str(i) for i in range(999)]
    assert periodic.runs_of_texts([["x", *unit * 21, *unit[:5]]])[0] == [(1, 999 * 21 + 5, 999)]
    fib = ["a", "b"]
    while len(fib) < 5000:  # a string of the most runs, none of exponent 4
        fib = fib + fib[:len(fib) - len(fib) // 3]
    assert periodic.runs_of_texts([fib])[0] == brute(fib[:], 6, 4)


def digest(doc_id, text):
    """The contract, word by word."""
    words = periodic.words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_the_contract_on_whole_short_texts(spark, tmp_path):
    docs = spark.read.parquet(SF001 + "/documents.parquet").where("length(text) < 2500 or text is null").select("doc_id", "text")
    extra = spark.createDataFrame([(900 + i, " ".join(generated(random.Random(i)))) for i in range(300)] + [(901, "a\x0ba\fa a\ta\ra b"), (None, "x " * 9)], docs.schema)
    docs = docs.unionByName(extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = sorted((digest(*r) for r in docs.collect()), key=str)
    assert got == want and sum(r[1] > 0 for r in got) > 100
    assert periodic.op11_periodic_runs(spark, str(tmp_path)).columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_edge_rows(spark):
    rows = periodic.periodic_runs(frame(spark), "doc_id", "text").collect()
    assert len(rows) == frame(spark).count()
    assert all(r.runs == [] and r.collapsed == "" for r in rows if not r.n_words)
    assert periodic.periodic_runs(empty(spark), "doc_id", "text").collect() == []
    one = spark.createDataFrame([(1, "go " + "la di " * 5 + "end")], "doc_id long, text string")
    r = periodic.periodic_runs(one, "doc_id", "text").first()
    assert [tuple(x) for x in r.runs] == [(1, 10, 2)] and r.collapsed == "go la di end"

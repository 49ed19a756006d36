import hashlib
import math

import duckdb
import numpy as np
import pytest

from conftest import SF001
from loanscope.llm import centroids
from loanscope.llm.queries import QUERIES, SQL


def brute(rows, k, rounds, dimension, scale=1024, seed=3):
    """Lloyd's rounds in plain Python integers; rows: (id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(mine[i]) for x in zip(*mine[i])] if i in mine else c for i, c in enumerate(at)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), at


@pytest.mark.parametrize("seed, n, k", [(0, 60, 4), (1, 3, 8), (2, 200, 8)])
def test_rounds_equal_brute_force(spark, seed, n, k):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=3).tolist()) for i in rng.permutation(n)]
    rows += rows[:2] + [(5, [0.0, 0.0, 0.0])] * 3  # repeated rows, an id with two vectors, ties
    bad = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("-inf"), 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad + [(None, [-0.5, 0.25, 1e-9])]], "vec_id long, v array<float>, cluster int, distance int")
    rows = [(r.vec_id, r.v) for r in df.collect()]  # as floats hold them
    found, at = centroids.cluster(df, "vec_id", "v", k=k, rounds=5, dimension=3)
    want, centres = brute(rows, k, 5, 3)
    assert sorted(map(tuple, found.collect()), key=str) == want and at == centres


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, v array<float>")
    assert centroids.cluster(df, "vec_id", "v")[0].collect() == []


def test_empty_clusters_stay(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(20)], "vec_id long, v array<float>")
    found, at = centroids.cluster(df, "vec_id", "v", k=3, rounds=2, dimension=2)
    assert {r.cluster for r in found.collect()} == {0} and at == [[1024, 1024]] * 3


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "labels", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = QUERIES[name](spark, SF001)
    cur = con.execute(SQL[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=str)


def test_no_python_runs(spark):
    plan = QUERIES["op13_centroids"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

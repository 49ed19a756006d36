"""Operator 13: k-means over integer vectors with JVM-native expressions.

Components become whole numbers, ``floor(1024 x)``, so every distance, sum and mean is
exact and the same on any number of executors, in any order.  The distance to a
centroid is ``aggregate(zip_with(vector, literal array, (a - b)^2), +)``; ``array_min``
over (distance, number) structs picks the nearest, the smaller number on a tie.
Centroids move to the floor of the mean: one sum a component and a count, grouped by
cluster, added up in the scan's own tasks before at most k rows are shuffled.

The whole-number vectors are written once to the shared folder; a round is one job that
reads them and sends k rows of sums to the driver, the only thing that ever reaches
it.  A cluster that holds a third of all vectors is one row a task, and a lost executor
costs its tasks of one round.

Vectors that are null, of another length, or hold null or non-finite components take no
part.  The first centroids are the kept rows of smallest key; rows of one key go by their
components.  Fewer rows than k give as many centroids; an empty table gives no rows;
equal vectors and repeated ids are rows of their own; a null id is written as the empty text;
other columns are ignored.  Squared distances are longs: components beyond +-2^18 (scaled:
2^28) could overflow and raise an error instead of giving a wrong number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

SCALE, DIMENSION, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """``_id`` and ``_v``, whole-number components, of the vectors that take part."""
    v = F.col("_x")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_x"))
    rows = rows.where(v.isNotNull() & (F.size(v) == dimension) & F.forall(v, finite))
    return rows.select("_id", F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("_v"))


def nearest(vector: str, centroids: Sequence[Sequence[int]]) -> Column:
    """Struct (distance, cluster) of the centroid nearest to the column ``vector``."""
    # SQL text: one expression for all the literals, where functions would make thousands.
    def distance(c):
        return (f"aggregate(zip_with({vector}, array({', '.join(f'{int(x)}L' for x in c)}), (a, b) -> (a - b) * (a - b)), "
                f"0L, (s, x) -> s + x)")
    return F.expr(f"array_min(array({', '.join(f'struct({distance(c)} AS distance, {i} AS cluster)' for i, c in enumerate(centroids))}))")


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The k rows of smallest hash of (seed, id), in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    return [list(r._v) for r in rows.select(key.alias("key"), "_v").orderBy("key", "_v").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floor of its vectors' mean, where it has any."""
    parts = range(len(centroids[0]))
    sums = (rows.select(nearest("_v", centroids)["cluster"].alias("cluster"), "_v")
                .selectExpr("cluster", *[f"_v[{j}] AS x{j}" for j in parts])
                .groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(x{j}) AS x{j}") for j in parts]))
    out = list(centroids)
    for r in sums.collect():  # k rows at most
        out[r.cluster] = [x // r.n for x in r[2:]]
    return out


def cluster(df: DataFrame, id_col: str, vector_col: str, k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION,
            scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(``id``, ``cluster``, squared ``distance`` of every vector that takes part; the final centroids)."""
    rows = staged(kept_vectors(df, id_col, vector_col, dimension, scale), "whole-number-vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = rows.select("_id", nearest("_v", centroids).alias("_at"))
    return found.select(F.col("_id").alias(id_col), F.col("_at.cluster").alias("cluster"), F.col("_at.distance").alias("distance")), centroids


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """Ten rounds of eight clusters over the table's vectors of 64 components."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids] or [F.lit("")])
    sums = F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(max(len(centroids), 1))])
    at = F.col("cluster") + 1
    return found.select("vec_id", "cluster", "distance", F.element_at(sums, at).alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(digest, at).alias("centroid_sha256"))


def op13_sql() -> str:
    """The rounds written out one after the other; a repeated (id, vector) pair stays a row of its own by its number."""
    steps = [f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({DIMENSION})) AS j FROM kept),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept
  QUALIFY c < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT c, j, x FROM first JOIN parts USING (r))"""]
    assign = ("SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS d "
              "FROM parts p JOIN c{i} q USING (j) GROUP BY r, c) GROUP BY r")
    for i in range(ROUNDS):
        steps.append(f"""a{i} AS ({assign.format(i=i)}),
m{i} AS (SELECT a{i}.c AS c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN parts USING (r) GROUP BY a{i}.c, j),
c{i + 1} AS MATERIALIZED (SELECT o.c, o.j, CASE WHEN n IS NULL THEN o.x ELSE s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END END AS x
  FROM c{i} o LEFT JOIN m{i} USING (c, j))""")
    steps.append(f"""a AS MATERIALIZED ({assign.format(i=ROUNDS)}),
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a JOIN kept USING (r) JOIN digests USING (c)""")
    return ",\n".join(steps)

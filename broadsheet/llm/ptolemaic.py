"""Centroid clustering (11): Lloyd's rounds on integer vectors, with Ptolemaic lower bounds.

1. Pivots: fixed vectors, chosen once: where the centroids of a bounded sample (SAMPLE vectors, by hash of their ids) stand at
   the start, after the rounds PIVOT_ROUNDS and at the end. Each vector's distances to them are measured once and stored beside it.
2. Bounds: Ptolemy's inequality for a vector u, a centroid c and a pair of pivots p, s:
   |u c| |p s| >= | |u p| |c s| - |u s| |c p| |. Each centroid uses the pairs of its nearest pivot, where the bound is tightest.
3. Assignment: the centroid with the smallest bound is measured exactly; others are measured, in order of their bounds, only
   while the bound does not exceed the best distance so far. Bounds are made in floating point and lowered by far more than its error,
   so a centroid that could win or tie is always measured, in integers; of ties the smaller number wins.
4. Rounds: every round is one pass over the stored table. A task returns one row per cluster (count, 64 sums), the sums meet in
   one row per cluster, and floor(sum / count) is exact. Only the centroids, CLUSTERS rows, are held by the driver.

Vectors that are null, hold null or non-finite components or have another number of components take no part. Rows that repeat an id are
vectors of their own; if hashes tie at the start, the smaller vector goes first. Null ids come last there. A component
beyond 2**27 / scale in size raises, since squared distances would not fit 64 bits. Fewer vectors than clusters give fewer centroids;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import stored, table
from broadsheet.llm.voronoi import integers

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
SAMPLE = 8192
PIVOT_ROUNDS = (1, 3)
LARGEST = 1 << 27
#: Far above the rounding error of a bound, which takes a dozen operations of relative error 2**-53.
EASE = 2.0 ** -44


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of two integer matrices of one shape."""
    away = x - c
    return np.einsum("ij,ij->i", away, away)


def pivot_path(x: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Distinct centroids of Lloyd's rounds over a sample: at the start, after PIVOT_ROUNDS and at the end."""
    found = [centroids]
    for done in range(1, rounds + 1):
        near = np.stack([squared(x, c[None]) for c in centroids], 1).argmin(1)
        centroids = np.stack([x[near == j].sum(0) // (near == j).sum() if (near == j).any() else c for j, c in enumerate(centroids)])
        if done in (*PIVOT_ROUNDS, rounds):
            found.append(centroids)
    return np.unique(np.concatenate(found), axis=0)


class Bounds:
    """Lower bounds on the squared distances to ``centroids`` from distances to ``pivots``."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        apart = np.stack([np.sqrt(squared(pivots, p[None])) for p in pivots])
        off = np.stack([np.sqrt(squared(pivots, c[None])) for c in centroids])
        self.pairs = []
        for j in range(len(centroids)):
            p = int(off[j].argmin())
            s = np.flatnonzero(apart[p] > 0)
            self.pairs.append((p, s, off[j, p], off[j, s], apart[p, s]))

    def __call__(self, known: np.ndarray) -> np.ndarray:
        """Rows of ``known`` hold a vector's distances to the pivots."""
        out = np.zeros((len(known), len(self.pairs)))
        for j, (p, s, to_p, to_s, between) in enumerate(self.pairs):
            if not len(s):
                out[:, j] = np.maximum(np.abs(known[:, p] - to_p) - EASE * (known[:, p] + to_p), 0) ** 2  # all pivots are one point
                continue
            left, right = known[:, [p]] * to_s[None], known[:, s] * to_p
            least = (np.abs(left - right) - EASE * (left + right)) / between[None]
            out[:, j] = np.maximum(least.max(1), 0) ** 2
        return out * (1 - EASE)


def nearest(x: np.ndarray, known: np.ndarray, centroids: np.ndarray, bounds: Bounds):
    """(cluster, squared distance) of each row of ``x``, and how many distances were measured."""
    least = bounds(known)
    order = np.argsort(least, 1, kind="stable")
    cluster = order[:, 0].copy()
    best = squared(x, centroids[cluster])
    measured = len(x)
    for k in range(1, len(centroids)):
        j = order[:, k]
        open_ = np.flatnonzero(least[np.arange(len(x)), j] <= best)
        measured += len(open_)
        j = j[open_]
        found = squared(x[open_], centroids[j])
        wins = (found < best[open_]) | ((found == best[open_]) & (j < cluster[open_]))
        best[open_[wins]], cluster[open_[wins]] = found[wins], j[wins]
    return cluster, best, measured


def _unpacked(batch, dimensions: int, pivots: int):
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)
    return x, np.frombuffer(b"".join(batch.column("known").to_pylist()), "<f8").reshape(-1, pivots)


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = 3, sample: int = SAMPLE,
             measured: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of ``vectors`` (vec_id, v: array of long).

    ``measured``, if given, receives (exact distances measured, distances in all) of every pass.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    large = F.exists("v", lambda c: F.abs(c) > LARGEST)
    kept = vectors.filter((F.size("v") == dimensions) & F.when(large, F.raise_error(F.lit("components beyond 2**27 do not fit"))).isNull())
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = np.array([r.v for r in kept.orderBy(place.asc_nulls_last(), "v").select("v").limit(k).collect()], np.int64)
    if not len(start):
        return vectors.sparkSession.createDataFrame([], out)
    some = kept.orderBy(F.xxhash64("vec_id"), "v").select("v").limit(sample).collect()  # at most ``sample`` rows
    pivots = pivot_path(np.array([r.v for r in some], np.int64), start, rounds)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column(1).flatten(), np.int64).reshape(-1, dimensions)
            known = np.sqrt(np.stack([squared(x, p[None]) for p in pivots], 1))
            raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<i4"), known)]
            yield pa.RecordBatch.from_arrays([b.column(0), *raw], ["vec_id", "x", "known"])

    cached = stored(kept.select("vec_id", "v").mapInArrow(measure, f"vec_id {kind}, x binary, known binary"), "pivot-distances")
    sums = [f"s{i}" for i in range(dimensions)]

    def totals(centroids: np.ndarray) -> list:
        bounds = Bounds(pivots, centroids)

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            n, far, work, total = (np.zeros(len(centroids), np.int64) for _ in range(4))
            all_sums = np.zeros((len(centroids), dimensions), np.int64)
            for b in batches:
                x, known = _unpacked(b, dimensions, len(pivots))
                if not len(x):
                    continue
                cluster, distance, done = nearest(x, known, centroids, bounds)
                work[0], total[0] = work[0] + done, total[0] + len(x) * len(centroids)
                for j in np.unique(cluster):
                    mine = cluster == j
                    n[j], far[j] = n[j] + mine.sum(), far[j] + distance[mine].sum()
                    all_sums[j] += x[mine].sum(0)
            yield pd.DataFrame({"cluster": np.arange(len(centroids)), "n": n, "far": far, "done": work, "pairs": total, **dict(zip(sums, all_sums.T))})

        def arrow(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for frame in run(batches):
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

        columns = ("n", "far", "done", "pairs", *sums)
        per_task = cached.mapInArrow(arrow, "cluster long, " + ", ".join(f"{c} long" for c in columns))
        rows = per_task.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("cluster").collect()  # a row per cluster
        if measured is not None:
            measured.append((sum(r.done for r in rows), sum(r.pairs for r in rows)))
        return rows

    centroids = start
    for _ in range(rounds):
        centroids = np.array([[r[s] // r.n for s in sums] if r.n else centroids[r.cluster].tolist() for r in totals(centroids)], np.int64)
    inertia = np.array([r.far for r in totals(centroids)], np.int64)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    bounds = Bounds(pivots, centroids)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x, known = _unpacked(b, dimensions, len(pivots))
            if not len(x):
                continue
            cluster, distance, _ = nearest(x, known, centroids, bounds)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(inertia[cluster]),
                 pa.array(np.full(len(x), inertia.sum())), pa.array([digests[j] for j in cluster])],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return cached.mapInArrow(assign, out)


def op11_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings").select("vec_id", integers(F.col("embedding"), SCALE).alias("v")))


def _sql() -> str:
    """Lloyd's rounds, each a pair of tables."""
    steps = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
h AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS k FROM v),
c0 AS MATERIALIZED (SELECT k, v AS c FROM h WHERE k < {CLUSTERS})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': k}}) AS best FROM v, c{i} GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (
  SELECT a.best.k AS k, u.i, sum(v.v[u.i])::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM a{i} a JOIN v USING (r), range(1, {DIMENSIONS + 1}) u(i) GROUP BY 1, 2),
n{i} AS (SELECT k, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM m{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (k))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c ON c.k = a.best.k"""


QUERIES = {"op11_ptolemaic_clusters": op11_ptolemaic_clusters}
ORACLES = {"op11_ptolemaic_clusters": _sql()}
